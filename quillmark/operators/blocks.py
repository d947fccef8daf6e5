"""Work on batches of texts inside tasks: hashes of their shingles, and blocks of texts that share very frequent ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from quillmark.params import PHRASE_LEAST_WORDS, PHRASE_SIZES, PHRASE_STEP, SHINGLE_WORDS, Scoring

#: Runs of inner words that a number has room for, three bits each; of a phrase of the shortest size, that many shingles.
MOST_RUNS, RUN_SHINGLES = 20, min(PHRASE_SIZES) - 2 - (SHINGLE_WORDS - 1)
assert 0 < RUN_SHINGLES <= min(7, PHRASE_STEP)
#: Odd numbers that words are multiplied by, by their place in a shingle; one for shingles of one word, one for ``within``.
FACTORS = np.random.default_rng(20240229).integers(1 << 40, 1 << 63, SHINGLE_WORDS + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class Shingled:
    """The shingles of a batch of texts: ``words`` by text, and by distinct shingle its text ``row``, hash ``h`` and runs ``m``."""

    def __init__(self, texts: pa.Array, within: np.ndarray | None):
        n = len(texts)
        lists = pc.split_pattern(texts, " ")
        lengths = np.asarray(pc.list_value_length(lists))
        coded = lists.flatten().dictionary_encode()
        known = np.array(coded.dictionary.to_pylist(), dtype=object)
        hashes = pd.util.hash_array(known, categorize=False) if len(known) else np.zeros(0, np.uint64)
        codes = np.asarray(coded.indices)
        row = np.repeat(np.arange(n), lengths)
        full = np.array([x != "" for x in known], bool)[codes] if len(codes) else np.zeros(0, bool)
        words, row = hashes[codes][full], row[full]
        self.words = np.bincount(row, minlength=n)
        first = np.cumsum(self.words) - self.words
        self.all = np.where(self.words >= SHINGLE_WORDS, self.words - SHINGLE_WORDS + 1, self.words)
        row = np.repeat(np.arange(n), self.all)
        place = np.arange(len(row)) - np.repeat(np.cumsum(self.all) - self.all, self.all)
        at, last = first[row] + place, max(len(words) - 1, 0)
        h = sum((words[np.minimum(at + k, last)] * FACTORS[k] for k in range(SHINGLE_WORDS)), np.zeros(len(row), np.uint64)) if len(row) else np.zeros(0, np.uint64)
        short = self.words[row] < SHINGLE_WORDS
        h[short] = words[at[short]] * FACTORS[SHINGLE_WORDS]
        if within is not None:
            h += _mixed(within.astype(np.int64).view(np.uint64))[row] * FACTORS[SHINGLE_WORDS + 1]
        h = _mixed(h).view(np.int64)
        self.h_all, self.row_all = h, row
        self.runs = np.where(self.words >= PHRASE_LEAST_WORDS, (self.words - min(PHRASE_SIZES)) // PHRASE_STEP + 1, 0)
        run = (place - 1) // PHRASE_STEP
        held = (place > 0) & ((place - 1) % PHRASE_STEP < RUN_SHINGLES) & (run < self.runs[row]) & (self.runs[row] <= MOST_RUNS)
        order = np.lexsort((place, h, row))
        row, h, run, held = row[order], h[order], run[order], held[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        again = np.zeros(len(row), bool)
        again[1:] = ~new[1:] & (run[1:] == run[:-1]) & held[1:] & held[:-1]
        m = np.where(held & ~again, np.int64(1) << (3 * np.clip(run, 0, MOST_RUNS - 1)), np.int64(0))
        starts = np.flatnonzero(new)
        self.row, self.h, self.m = row[new], h[new], (np.add.reduceat(m, starts) if len(starts) else np.zeros(0, np.int64))
        self.n = np.bincount(self.row, minlength=n)

    def full(self) -> np.ndarray:
        """By text the numbers of distinct shingles of its runs."""
        out = np.zeros(len(self.words), np.int64)
        np.add.at(out, self.row, self.m)
        return out

    def needs(self, size: int) -> np.ndarray:
        """By text the fewest distinct shingles of inner words among its phrases of ``size`` words."""
        inner = np.maximum(np.minimum(size, self.words) - 2 - (SHINGLE_WORDS - 1), 0)
        out = inner.copy()
        ends = np.cumsum(self.all)
        for i in np.flatnonzero(self.n < self.all):
            s = self.h_all[ends[i] - self.all[i] : ends[i]]
            starts = range(0, max(self.words[i] - size, 0) // PHRASE_STEP * PHRASE_STEP + 1, PHRASE_STEP)
            out[i] = min(len(set(s[j + 1 : j + 1 + inner[i]].tolist())) for j in starts)
        return out


def _of(batch: pa.RecordBatch) -> Shingled:
    within = batch.column("within").to_numpy(zero_copy_only=False) if "within" in batch.schema.names else None
    if within is not None and within.dtype.kind not in "iu":
        within = pd.util.hash_array(within.astype(str).astype(object), categorize=False).view(np.int64)
    return Shingled(batch.column("text").cast(pa.string()), within)


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text with its numbers of shingles."""
    for batch in batches:
        x = _of(batch)
        more = {"n": pa.array(x.n, pa.int32())} | {f"need{i}": pa.array(x.needs(size), pa.int32()) for i, size in enumerate(PHRASE_SIZES)}
        more |= {"full": pa.array(x.full(), pa.int64(), mask=x.runs > MOST_RUNS), "long": pa.array(x.words >= PHRASE_LEAST_WORDS)}
        yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])


POSTED = "h bigint, id bigint, asked boolean, known boolean, qo bigint, co bigint, m bigint, least int"


def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct shingle of each text."""
    for batch in batches:
        x = _of(batch)
        at = pa.array(x.row)
        own = {c: batch.column(c).take(at) for c in ("id", "asked", "known", "qo", "co", "least")}
        own |= {"h": pa.array(x.h), "m": pa.array(x.m)}
        names = [c.split()[0] for c in POSTED.split(", ")]
        whole = pa.RecordBatch.from_arrays([own[c] for c in names], names=names)
        for i in range(0, whole.num_rows, 1 << 17):
            yield whole.slice(i, 1 << 17)


LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def met_by_others(earlier: bool):
    """A function that gives the postings of a part, all of a shingle in it, that another text may share."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        h = t["h"].to_numpy()
        order = np.argsort(h, kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        rows = np.diff(np.append(starts, len(h)))
        # those that only one text has end here
        some = order[rows[group] > 1]
        if not len(some):
            return
        group = np.cumsum(np.diff(h[some], prepend=h[some[0]]) != 0)
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        t = t.take(pa.array(some))
        get = lambda c, fill: t[c].combine_chunks().fill_null(fill).to_numpy(zero_copy_only=False)
        asked, known = get("asked", False), get("known", False)
        over = lambda f, x: f.reduceat(x, starts)[group]
        low, high = {c: get(c, LOWEST) for c in ("qo", "co")}, {c: get(c, HIGHEST) for c in ("qo", "co")}
        ca, cb = over(np.minimum, np.where(known, low["co"], HIGHEST)), over(np.maximum, np.where(known, high["co"], LOWEST))
        qa, qb = over(np.minimum, np.where(asked, low["qo"], HIGHEST)), over(np.maximum, np.where(asked, high["qo"], LOWEST))
        df, asks = over(np.add, known.astype(np.int32)), over(np.add, asked.astype(np.int32))
        if earlier:
            q, c = ca < high["qo"], low["co"] < qb
        else:
            q, c = ~((ca == cb) & (ca == low["qo"]) & (low["qo"] == high["qo"])), ~((qa == qb) & (qa == low["co"]) & (low["co"] == high["co"]))
        q, c = q & asked & (df > 0), c & known & (asks > 0)
        out = t.select(["h", "id", "qo", "co", "m", "least"]).append_column("df", pa.array(df, pa.int32())).append_column("q", pa.array(q)).append_column("c", pa.array(c))
        yield from out.filter(pa.array(q | c)).to_batches(1 << 17)

    return kept


def _bonus(phrases: dict, runs: int, full: list[int], text: str, points: tuple) -> int:
    """The points of the longest phrase, of those whose run of inner words is shared, that the text contains."""
    for size, x in zip(PHRASE_SIZES, points, strict=True):
        for i, phrase in phrases[size]:
            if (full is None or (full[i] and (runs >> (3 * i)) & 7 == full[i])) and phrase in text:
                return x
    return 0


def hot_pairs(s: Scoring, best_only: bool, earlier: bool, owned: bool):
    """A function of a block of texts that ask and a block of candidates: (q, c, k, bonus) of the pairs that reach the threshold.

    Of a pair it sees the shared shingles that are very frequent, and with ``best_only`` gives those pairs that may be the
    best of a text: candidates are taken by the score that they may have, the preferred ones first, until none can be better.
    ``owned`` tells that candidates have owners, of which a row's own one doesn't count.
    """

    def found(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(c):
            size = c["hs"].map(len).to_numpy()
            hs = np.concatenate(c["hs"].to_numpy())
            order = np.argsort(hs, kind="stable")
            hs, of = hs[order], np.repeat(np.arange(len(c)), size)[order]
            ids, p, texts = c["id"].to_numpy(), c["n"].to_numpy().astype(np.int64), c["text"].to_numpy()
            one, co = c["co"].notna().to_numpy(), c["co"].fillna(0).to_numpy().astype(np.int64)
            plain = one | (not owned)
            tie1, tie2 = c["tie1"].to_numpy().astype(np.int64), c["tie2"].to_numpy().astype(np.int64)
            for x in q.itertuples():
                k, runs = np.zeros(len(c), np.int32), np.zeros(len(c), np.int64)
                keys = np.asarray(x.hs)
                for m, lo, hi in zip(x.ms, np.searchsorted(hs, keys), np.searchsorted(hs, keys, "right"), strict=True):
                    k[of[lo:hi]] += 1
                    runs[of[lo:hi]] += m
                meets = (co < x.qo) if earlier else (~one | (co != x.qo) if pd.notna(x.qo) else np.ones(len(c), bool))
                at = np.flatnonzero((k >= x.least) & (ids != x.id) & meets)
                if not len(at):
                    continue
                ka, pa_, ra = k[at].astype(np.int64), p[at], runs[at]
                full = None if pd.isna(x.full) else [(int(x.full) >> (3 * i)) & 7 for i in range(MOST_RUNS)]
                some = np.ones(len(at), bool) if full is None else np.zeros(len(at), bool)
                for i, f in enumerate(full or ()):
                    if f:
                        some |= (ra >> (3 * i)) & 7 == f
                n = int(x.n)
                most = np.select([some & x.long & (ka >= need) for need in (x.need0, x.need1, x.need2)], list(s.bonus), 0)
                d = n * (n + pa_)
                points = lambda b: np.minimum(ka * (s.coverage * (n + pa_) + 2 * s.dice * n) + b * d, 100 * d)  # noqa: B023, E731
                upper = points(most)
                reach = upper >= s.threshold * d
                single = not owned or (pd.notna(x.qo) and (not earlier or x.first == x.qo))
                if best_only:
                    sure = ~one[at] | ((co[at] < x.first) if earlier else bool(single))
                    lower = (points(0) / d)[sure & reach]
                    if len(lower):
                        reach &= upper / d >= max(lower.max(), s.threshold) - 0.02
                at, ka, ra, most, d, upper = at[reach], ka[reach], ra[reach], most[reach], d[reach], upper[reach]
                words = x.text.split(" ")
                phrases = {z: [(i, " ".join(words[i * PHRASE_STEP : i * PHRASE_STEP + z])) for i in range(max(len(words) - z, 0) // PHRASE_STEP + 1)] for z in PHRASE_SIZES}
                if not best_only or not single:
                    for j, kj, r, b in zip(at.tolist(), ka.tolist(), ra.tolist(), most.tolist(), strict=True):
                        out.append((x.id, ids[j], kj, _bonus(phrases, r, full, texts[j], s.bonus) if b else 0))
                    continue
                base = ka * (s.coverage * (n + p[at]) + 2 * s.dice * n)
                best = (-1.0, 0, 0)
                keep = None
                # scores in hundredths, with room for rounding
                up = np.rint(100 * upper / d + 1e-7)
                every = bool(plain[at].all())
                for j in np.lexsort((-tie2[at], -tie1[at], -up)).tolist():
                    if up[j] < best[0] or (every and (up[j], tie1[at[j]], tie2[at[j]]) <= best):
                        break
                    if plain[at[j]] and (up[j], tie1[at[j]], tie2[at[j]]) <= best:
                        continue
                    b = _bonus(phrases, int(ra[j]), full, texts[at[j]], s.bonus) if most[j] else 0
                    dj = int(d[j])
                    value = min(int(base[j]) + b * dj, 100 * dj)
                    if value < s.threshold * dj:
                        continue
                    whole, rest = divmod(100 * value, dj)
                    hundredths = whole + (2 * rest > dj or (2 * rest == dj and whole % 2 == 1))
                    row = (x.id, ids[at[j]], int(ka[j]), b)
                    if not plain[at[j]]:
                        out.append(row)  # of several owners: which one counts is seen later
                    elif (hundredths, tie1[at[j]], tie2[at[j]]) > best:
                        best, keep = (float(hundredths), tie1[at[j]], tie2[at[j]]), row
                if keep:
                    out.append(keep)
        return pd.DataFrame(out, columns=["q", "c", "k", "bonus"]).astype("int64")

    return found
