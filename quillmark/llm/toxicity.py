"""Toxicity scores by a bidirectional gated recurrent network with attention over words and their characters.

A word enters with a learned vector of its own, the mean of learned vectors of its
character runs (runs of four, beginnings of four to eight, ends of four and five
bytes), and the log-odds, between toxic and other training texts, of the word and
of its runs. Two gated recurrent layers read a window of words forwards and
backwards, attention pools their states, and a logistic unit gives the window's
score. All overlapping windows of a text are scored, and the highest counts.

Words of more than ``LONG_WORD`` bytes, as in scripts without spaces, are read as
overlapping parts of whole characters, in training and scoring alike.

Training uses a bounded sample of labelled rows (``SAMPLE``, the smallest hashes of
the ids). Log-odds are counted on the executors over the sample's whole texts, each
text leaving itself out; per text, the windows of highest log-odds and a few others
come to the driver, where the network is trained in numpy from a fixed seed.

Defined cases: a null or empty text, or one without words, has the share of toxic
rows in the sample as score; with no labelled rows of both labels every score is
that share (0 without any); repeated rows score alike; labels that are null or of
null ids are left out; other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.bytekernel import FOLDED_WORDS, SPACE, mix, words
from quillmark.llm.runtime import checkpoint, lean, plainly_named, slices

#: Labelled rows that the network is fitted on, at most.
SAMPLE = 4000
#: Words of a window, and between the beginnings of two windows.
LENGTH, STRIDE = 32, 16
#: Windows of a training text: those of highest log-odds, and others.
BEST, OTHERS = 2, 1
WORD_BITS, RUN_BITS = 16, 17
EMBED, STATE, ATTEND = 4, 8, 8
#: Passes over the windows, at least, and steps, at least.
EPOCHS, STEPS, BATCH, RATE, SEED = 6, 400, 128, 0.01, 5
SLICE_BYTES, ROUND = 1 << 20, 2048
#: Bytes of a word, at most; longer ones are read as parts, of which two neighbours share at least SHARED bytes.
LONG_WORD, SHARED = 64, 16

_B = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Text:
    """Words of a list of texts: ``word`` numbers into the distinct words, whose buckets follow."""

    first: np.ndarray
    word: np.ndarray
    bucket: np.ndarray
    run: np.ndarray
    run_of: np.ndarray


def parts(word: bytes) -> list[bytes]:
    """A word as parts of whole characters, so that each of its runs is in one of them."""
    out, a = [], 0
    while len(word) - a > LONG_WORD:
        b = a + LONG_WORD
        while word[b] & 0xC0 == 0x80:
            b -= 1
        out.append(word[a:b])
        a = b - SHARED
        while word[a] & 0xC0 == 0x80:
            a -= 1
    return [*out, word[a:]]


def parted(text: bytes) -> list[bytes]:
    """The words of a text, long ones in parts."""
    found = text.translate(FOLDED_WORDS).split()
    return [p for w in found for p in parts(w)] if max(map(len, found), default=0) > LONG_WORD else found


def read(texts: list[bytes]) -> Text:
    """Buckets of the distinct words, long ones in parts, and of their character runs."""
    w = words(texts, FOLDED_WORDS)
    if len(w.length) and w.length.max() > LONG_WORD:
        texts = [b" ".join(parted(t)) for t in texts]
        w = words(texts, FOLDED_WORDS)
    distinct, at, word = np.unique(w.hash1, return_index=True, return_inverse=True)
    mapped = np.frombuffer(b" ".join([t.translate(FOLDED_WORDS) for t in texts]) + b" ", np.uint8)
    start = np.flatnonzero(np.diff((mapped != SPACE).astype(np.int8), prepend=0) == 1)[at]
    size = w.length[at]
    runs, of = [], []

    def add(begin: np.ndarray, owner: np.ndarray, n: int, salt: int) -> None:
        h = np.full(len(begin), np.uint64(salt))
        for k in range(n):
            h = h * _B + mapped[begin + k].astype(np.uint64) + np.uint64(1)
        runs.append(mix(h) >> np.uint64(64 - RUN_BITS))
        of.append(owner)

    number = np.arange(len(distinct))
    inner = np.maximum(size - 3, 0)
    owner = np.repeat(number, inner)
    add(np.repeat(start - (np.cumsum(inner) - inner), inner) + np.arange(len(owner)), owner, 4, 1)
    for n in range(4, 9):
        own = number[size >= n]
        add(start[own], own, n, 2)
    for n in (4, 5):
        own = number[size >= n]
        add(start[own] + size[own] - n, own, n, 3)
    run, of = np.concatenate(runs).astype(np.int64), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    bucket = (distinct >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    return Text(w.first, word, bucket, run[order], of[order])


def windows(n: int) -> np.ndarray:
    """Beginnings of the overlapping windows of a text of ``n`` words; the last ends with the text."""
    if n <= LENGTH:
        return np.zeros(min(n, 1), np.int64)
    return np.append(np.arange(0, n - LENGTH, STRIDE), n - LENGTH)


def odds(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Smoothed log-odds of a bucket from the texts that have it, drawn towards 0 where these are few."""
    toxic, other = np.maximum(toxic, 0), np.maximum(other, 0)
    ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
    return np.where(toxic + other > 0, ratio, 0) * (toxic + other) / (toxic + other + 3)


def pooled(t: Text, word_odds: np.ndarray, run_odds: np.ndarray) -> np.ndarray:
    """Log-odds of each distinct word, and the largest and the mean of its runs."""
    n = len(t.bucket)
    out = np.zeros((n, 3), np.float32)
    out[:, 0] = word_odds[t.bucket]
    value = run_odds[t.run]
    if len(value):
        begin = np.flatnonzero(np.diff(t.run_of, prepend=-1))
        out[t.run_of[begin], 1] = np.maximum.reduceat(value, begin)
    count = np.bincount(t.run_of, minlength=n)
    out[:, 2] = np.bincount(t.run_of, weights=value, minlength=n) / np.maximum(count, 1)
    return out / 3


def run_means(t: Text, vectors: np.ndarray) -> np.ndarray:
    n = len(t.bucket)
    count = np.maximum(np.bincount(t.run_of, minlength=n), 1)
    out = np.empty((n, vectors.shape[1]), np.float32)
    for k in range(vectors.shape[1]):
        out[:, k] = np.bincount(t.run_of, weights=vectors[:, k][t.run], minlength=n) / count
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gated(gates: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False):
    """States (time, row, STATE) of a gated recurrent layer over input gates (time, row, 3 * STATE)."""
    s = STATE
    h = np.zeros((gates.shape[1], s), gates.dtype)
    states, held = np.empty((*gates.shape[:2], s), gates.dtype), []
    for t in range(len(gates)):
        a = h @ u
        zr = sigmoid(gates[t, :, : 2 * s] + a[:, : 2 * s])
        z, r = zr[:, :s], zr[:, s:]
        n = np.tanh(gates[t, :, 2 * s :] + r * a[:, 2 * s :])
        new = np.where(mask[t][:, None], n + z * (h - n), h)
        if keep:
            held.append((h, z, r, n, a[:, 2 * s :]))
        h = states[t] = new
    return states, held


def gated_back(d_states, held, mask, u):
    """Gradients of the input gates and of ``u``."""
    s = STATE
    d_gates, d_u = np.zeros((*d_states.shape[:2], 3 * s), d_states.dtype), np.zeros_like(u)
    d_h = np.zeros_like(d_states[0])
    for t in range(len(d_states) - 1, -1, -1):
        h, z, r, n, a = held[t]
        d_h = d_h + d_states[t]
        live = np.where(mask[t][:, None], d_h, 0)
        d_n = live * (1 - z) * (1 - n * n)
        d_z = live * (h - n) * z * (1 - z)
        d_r = d_n * a * r * (1 - r)
        d_a = np.concatenate([d_z, d_r, d_n * r], axis=1)
        d_gates[t] = np.concatenate([d_z, d_r, d_n], axis=1)
        d_u += h.T @ d_a
        d_h = np.where(mask[t][:, None], live * z + d_a @ u.T, d_h)
    return d_gates, d_u


class Network:
    """Parameters, scores and training of the network."""

    def __init__(self, rng: np.random.Generator):
        width = 3 + 2 * EMBED
        draw = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
        self.p = {
            "word": draw(1 << WORD_BITS, EMBED) * 0.1,
            "run": draw(1 << RUN_BITS, EMBED) * 0.1,
            "w0": draw(width, 3 * STATE),
            "w1": draw(width, 3 * STATE),
            "b0": np.zeros(3 * STATE, np.float32),
            "b1": np.zeros(3 * STATE, np.float32),
            "u0": draw(STATE, 3 * STATE),
            "u1": draw(STATE, 3 * STATE),
            "attend": draw(2 * STATE, ATTEND),
            "focus": draw(ATTEND),
            "out": draw(2 * STATE),
            "bias": np.zeros(1, np.float32),
        }

    def inputs(self, t: Text, log_odds: np.ndarray) -> np.ndarray:
        """Input vector of each distinct word."""
        return np.concatenate([log_odds, self.p["word"][t.bucket], run_means(t, self.p["run"])], axis=1)

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["w0"] + self.p["b0"], x @ self.p["w1"] + self.p["b1"]

    def forward(self, ahead: np.ndarray, back: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows from their input gates (time, row, ...)."""
        p = self.p
        s0, k0 = gated(ahead, mask, p["u0"], keep)
        s1, k1 = gated(back[::-1], mask[::-1], p["u1"], keep)
        h = np.concatenate([s0, s1[::-1]], axis=2)
        a = np.tanh(h @ p["attend"])
        e = np.where(mask, a @ p["focus"], -1e9)
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pool = (e[:, :, None] * h).sum(axis=0)
        return pool @ p["out"] + p["bias"], (k0, k1, h, a, e, pool)

    def gradients(self, d_logit: np.ndarray, mask: np.ndarray, state):
        p, (k0, k1, h, a, e, pool) = self.p, state
        g = {"out": pool.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pool = d_logit[:, None] * p["out"]
        d_e = (h * d_pool).sum(axis=2)
        d_e = e * (d_e - (e * d_e).sum(axis=0))
        g["focus"] = np.einsum("tbk,tb->k", a, d_e)
        d_a = d_e[:, :, None] * p["focus"] * (1 - a * a)
        g["attend"] = np.einsum("tbh,tbk->hk", h, d_a)
        d_h = e[:, :, None] * d_pool + d_a @ p["attend"].T
        d0, g["u0"] = gated_back(d_h[:, :, :STATE], k0, mask, p["u0"])
        d1, g["u1"] = gated_back(d_h[::-1, :, STATE:], k1, mask[::-1], p["u1"])
        return g, d0, d1[::-1]

    def train(self, t: Text, log_odds: np.ndarray, row: np.ndarray, label: np.ndarray, rng: np.random.Generator) -> None:
        """Fit to windows: ``row`` (windows, LENGTH) numbers distinct words, -1 beyond the end."""
        dense = [k for k in self.p if k not in ("word", "run")]
        moment = {k: (np.zeros_like(self.p[k]), np.zeros_like(self.p[k])) for k in dense}
        squares = {k: np.full(len(self.p[k]), 1e-6, np.float32) for k in ("word", "run")}
        run_begin = np.searchsorted(t.run_of, np.arange(len(t.bucket) + 1))
        step = 0
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(row)))):
            order = rng.permutation(len(row))
            for a in range(0, len(order), BATCH):
                pick = order[a : a + BATCH]
                own, word = np.unique(np.maximum(row[pick].T, 0), return_inverse=True)
                word, mask = word.reshape(LENGTH, len(pick)), row[pick].T >= 0
                n = run_begin[own + 1] - run_begin[own]
                at = np.repeat(run_begin[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                part = Text(t.first, word, t.bucket[own], t.run[at], np.repeat(np.arange(len(own)), n))
                x = self.inputs(part, log_odds[own])
                ahead, back = self.gates(x)
                logit, state = self.forward(ahead[word], back[word], mask, True)
                d_logit = ((sigmoid(logit) - label[pick]) / len(pick)).astype(np.float32)
                g, d0, d1 = self.gradients(d_logit, mask, state)
                d0w, d1w = np.zeros_like(ahead), np.zeros_like(back)
                np.add.at(d0w, word, d0)
                np.add.at(d1w, word, d1)
                g["w0"], g["w1"], g["b0"], g["b1"] = x.T @ d0w, x.T @ d1w, d0w.sum(axis=0), d1w.sum(axis=0)
                d_x = d0w @ self.p["w0"].T + d1w @ self.p["w1"].T
                d_run = (d_x[:, 3 + EMBED :] / np.maximum(n, 1)[:, None])[part.run_of]
                for k, index, d in (("word", part.bucket, d_x[:, 3 : 3 + EMBED]), ("run", part.run, d_run)):
                    some, place = np.unique(index, return_inverse=True)
                    total = np.zeros((len(some), EMBED), np.float32)
                    np.add.at(total, place, d)
                    squares[k][some] += (total * total).mean(axis=1)
                    self.p[k][some] -= 5 * RATE * total / np.sqrt(squares[k][some])[:, None]
                step += 1
                for k in dense:
                    (m, v), d = moment[k], g[k]
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    self.p[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)


@dataclass
class Model:
    prior: float
    word_odds: np.ndarray | None = None
    run_odds: np.ndarray | None = None
    network: Network | None = None

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Score of each text: the highest of its windows'."""
        out = np.full(len(texts), self.prior)
        if self.network is None:
            return out
        t = read(texts)
        ahead, back = self.network.gates(self.network.inputs(t, pooled(t, self.word_odds, self.run_odds)))
        size = np.diff(t.first)
        begins = [windows(n) for n in size.tolist()]
        owner = np.repeat(np.arange(len(texts)), [len(b) for b in begins])
        if not len(owner):
            return out
        begin = np.concatenate(begins) + t.first[owner]
        logit = np.empty(len(owner))
        step = np.arange(LENGTH)[:, None]
        for a in range(0, len(owner), ROUND):
            at = begin[a : a + ROUND] + step
            mask = at < t.first[owner[a : a + ROUND] + 1]
            word = t.word[np.minimum(at, len(t.word) - 1)]
            logit[a : a + ROUND] = self.network.forward(ahead[word], back[word], mask)[0]
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, logit)
        return np.where(size > 0, sigmoid(best), out)


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have each bucket (words, then runs), toxic and other."""
    both = (1 << WORD_BITS) + (1 << RUN_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = np.zeros((2, both), np.int64)
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = read([text.encode()])
                count[toxic, np.unique(np.append(t.bucket, (1 << WORD_BITS) + t.run))] += 1
            some = np.flatnonzero(count.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, count[0, some], count[1, some])], names=["bucket", "other", "toxic"])

    found = rows.select("text", "toxic").mapInArrow(lean(run), "bucket bigint, other bigint, toxic bigint")
    found = found.groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toPandas()
    toxic, other = np.zeros(both), np.zeros(both)
    toxic[found["bucket"]], other[found["bucket"]] = found["toxic"], found["other"]
    return toxic, other


def _training_windows(rows: DataFrame, tables: tuple) -> list[tuple[str, int]]:
    """(window, toxic): the windows of each text with the highest log-odds, and a few by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, label = [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                t = read([raw])
                begins = windows(len(t.word))
                if not len(begins):
                    continue
                value = pooled(t, *tables[toxic])[:, :2].max(axis=1)[t.word]
                total = np.append(0.0, np.cumsum(np.maximum(value, 0) ** 2))
                ends = np.minimum(begins + LENGTH, len(t.word))
                order = np.argsort(total[begins] - total[ends], kind="stable")
                chosen = [*order[:BEST].tolist()]
                rest = order[BEST:]
                if not toxic and len(rest):
                    chosen += rest[:: max(1, len(rest) // OTHERS)][:OTHERS].tolist()
                elif toxic:
                    chosen = chosen[:1]
                split = parted(raw)
                for c in chosen:
                    found.append(b" ".join(split[begins[c] : ends[c]]))
                    label.append(toxic)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(label, pa.int32())], names=["window", "toxic"])

    return [(r[0], r[1]) for r in rows.select("text", "toxic").mapInArrow(lean(run), "window binary, toxic int").collect()]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` rows of ``labels`` (doc_id, toxic) with the texts of ``docs``."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")
    rows = checkpoint(rows.repartition(12))
    share = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = share.get(1, 0), share.get(0, 0)
    if not n_toxic or not n_other:
        return Model(float(n_toxic > 0))
    toxic, other = _counts(rows)

    def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[: 1 << WORD_BITS].astype(np.float32), x[1 << WORD_BITS :].astype(np.float32)

    # a training text is judged by the others: its own count is taken off
    without = (split(odds(toxic, other - 1, n_toxic, n_other - 1)), split(odds(toxic - 1, other, n_toxic - 1, n_other)))
    chosen = sorted(_training_windows(rows, without))
    label = np.array([y for _, y in chosen], np.float32)
    parts = []
    row = np.full((len(chosen), LENGTH), -1)
    t = read([w for w, _ in chosen])
    for i in range(len(chosen)):
        own = t.word[t.first[i] : t.first[i + 1]][:LENGTH]
        row[i, : len(own)] = own
    # distinct words twice: as other texts see them, then as toxic ones do
    n = len(t.bucket)
    parts = np.concatenate([pooled(t, *without[0]), pooled(t, *without[1])])
    twice = Text(t.first, t.word, np.tile(t.bucket, 2), np.tile(t.run, 2), np.append(t.run_of, t.run_of + n))
    row[label > 0] += np.where(row[label > 0] >= 0, n, 0)
    rng = np.random.default_rng(SEED)
    network = Network(rng)
    network.train(twice, parts, row, label, rng)
    return Model(n_toxic / (n_toxic + n_other), *split(odds(toxic, other, n_toxic, n_other)), network)


def _scores(texts: pa.Array, model: Model) -> np.ndarray:
    """Scores of a column of texts, of which only a slice is taken apart at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    found = [model.scores([(t or "").encode() for t in texts.slice(a, b - a).to_pylist()]) for a, b in slices(sizes, SLICE_BYTES)]
    return np.concatenate([np.empty(0), *found])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _scores(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(place), shared.value) < least))

    rows = plainly_named(docs, ("text",))
    return rows.mapInArrow(lean(run), rows.schema).toDF(*docs.columns)
