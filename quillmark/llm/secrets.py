"""Secrets in whole texts: three fixed patterns, and strings that character models call random.

Two first-order Markov models over characters, one of random strings and one of
ordinary identifiers, are trained from labelled samples. In runs of token characters
the stretch of at least ``SHORTEST`` with the largest log-likelihood ratio is a
further finding if that exceeds a threshold that is set on held-out identifiers by
the same statistic; what lies before and after it is judged again, however long the
run. A finding reaches to the separators around its stretch. Stretches without
letters, or of few different characters (rules and fillers), are not findings.
Findings of the patterns always stay; the models judge what is left of a run beside
them.

The labelled samples are drawn by rule from a seed, ``SAMPLES`` of each label:
random strings over the alphabets of common secrets; identifiers joined from
everyday words in the usual naming styles, with version numbers and dates.

Defined cases: a null text is an empty one and has no findings; findings are in
code points, end exclusive; repeated rows are scanned alike; other columns of the
input are left out.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns, and the least length of what they find.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "random")

#: Characters of a stretch that the models judge, at least; drawn random strings have up to LONGEST.
SHORTEST, LONGEST = 20, 64
#: Different characters of a finding, at least: of 20 random hex digits, fewer come once in some million.
DIFFERENT = 6
#: Labelled strings of each kind that the models are trained on, and as many to set the threshold.
SAMPLES, SEED = 4000, 11
#: Share of held-out identifiers that may exceed the threshold.
FALSE_SHARE = 0.001
#: Identifiers that are joined to a held-out run, at most.
JOINED = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LETTERS, DIGITS = 52, 10
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
WORDS = (
    "account action active address admin after alert all and answer api app area array asset async auth back base batch "
    "before block body book both bottom box branch build button cache call card case change channel check child city class "
    "clean client close code color column command commit common config content copy count country create current data date "
    "day default delete detail device dialog direction document domain done down draft edit email enable end engine entry "
    "error event every example export external face false father field file filter final find first flag folder font for "
    "form frame from front full function future gate general get global good grade graph group hand handler hash head "
    "height hello help high history home host hour house image import index info inner input insert install interface "
    "internal into invoice item job join keep key kind label language large last latest layer left length letter level "
    "library light like limit line link list little load local lock log long loop main make manager map market match member "
    "memory message method middle minute mode model module month more mother move multi name native network never new next "
    "night node normal note number object office offset old online only open option order other outer output owner page "
    "panel parent part pass path pattern pay people percent person phone place plan player plugin point policy pool port "
    "position post power present price print process product profile project property provider public query queue quick "
    "random range rate raw read real record red refresh region register release remote remove render report request reset "
    "resource response result retry return right role room root route rule run sample save scale schema school score script "
    "search second section select send sequence server service session set setting shape share short show side sign simple "
    "single size small sort source space special split stack stage standard start state static station status step stop "
    "storage store stream street string style submit success sum support switch sync system table target task team template "
    "test text the theme thread three time title today together toggle tool top total town track tree true type under unit "
    "update upload url user value vector version very view wait walk watch water week weight where white window with word "
    "work world write year young zone"
).split()


def random_string(rng: random.Random) -> str:
    n = rng.randint(SHORTEST, LONGEST)
    kind = rng.randrange(4)
    if kind == 0:
        return "".join(rng.choice("0123456789abcdef") for _ in range(n))
    if kind == 1:
        return "".join(rng.choice(ALPHABET[:62]) for _ in range(n))
    if kind == 2:
        return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def identifier(rng: random.Random) -> str:
    """Words and some numbers in one of the usual naming styles."""
    style, parts, size = rng.randrange(6), [], 0
    while size < rng.randint(SHORTEST, SHORTEST + 20):
        part = rng.choice(WORDS) if rng.random() < 0.85 else str(rng.choice([rng.randrange(10), rng.randrange(100), rng.randrange(1990, 2040)]))
        parts.append(part)
        size += len(part)
    if style == 0:
        return "_".join(parts)
    if style == 1:
        return "-".join(parts)
    if style == 2:
        return "/".join(parts)
    if style == 3:
        return parts[0] + "".join(p.capitalize() for p in parts[1:])
    if style == 4:
        return "_".join(parts).upper()
    return "".join(parts)


def identifiers(rng: random.Random) -> str:
    """A run of one to ``JOINED`` identifiers, as in paths and assignments."""
    return rng.choice("/_=-").join(identifier(rng) for _ in range(rng.randint(1, JOINED)))


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratio of each character after another, random against ordinary, and the threshold of a stretch's sum."""

    ratio: np.ndarray
    threshold: float

    def best(self, codes: np.ndarray) -> tuple[float, int, int]:
        """(sum, start, end) of the stretch of ``SHORTEST`` or more characters with the largest sum of ratios."""
        total = np.cumsum(np.append(0.0, self.ratio[codes[:-1], codes[1:]]))
        lowest = np.minimum.accumulate(total[: len(total) - SHORTEST + 1])
        gain = total[SHORTEST - 1 :] - lowest
        last = int(gain.argmax())
        return float(gain[last]), int(total[: last + 1].argmin()), last + SHORTEST


def _codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("latin-1"), np.uint8)]


_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))


@lru_cache(1)
def train(samples: int = SAMPLES, seed: int = SEED) -> Models:
    """Both models, smoothed, with the threshold that FALSE_SHARE of further runs of identifiers exceed.

    A character after itself, or a separator after another, speaks for neither: rules are drawn with them.
    """
    rng = random.Random(seed)
    n = len(ALPHABET)
    log = []
    for draw in (random_string, identifier):
        count = np.full((n, n), 0.5)
        for _ in range(samples):
            c = _codes(draw(rng))
            np.add.at(count, (c[:-1], c[1:]), 1)
        log.append(np.log(count / count.sum(axis=1, keepdims=True)))
    ratio = log[0] - log[1]
    neutral = np.eye(n, dtype=bool)
    neutral[LETTERS + DIGITS :, LETTERS + DIGITS :] = True
    models = Models(np.where(neutral, np.minimum(ratio, 0.0), ratio), 0.0)
    ordinary = np.array([models.best(_codes(identifiers(rng)))[0] for _ in range(samples)])
    return Models(models.ratio, max(0.0, float(np.quantile(ordinary, 1 - FALSE_SHARE))))


def stretches(text: str, models: Models) -> list[tuple[int, int]]:
    """(start, end), in order and apart, of the stretches of a run of token characters that are likelier random."""
    codes, open_, found = _codes(text), [(0, len(text))], []
    while open_:
        a, b = open_.pop()
        if b - a < SHORTEST:
            continue
        value, start, end = models.best(codes[a:b])
        if value <= models.threshold:
            continue
        start, end = a + start, a + end
        open_ += [(a, start), (end, b)]
        kinds = np.unique(codes[start:end])
        if len(kinds) >= DIFFERENT and kinds[0] < LETTERS:
            found.append((start, end))
    cuts = np.concatenate([[-1], np.flatnonzero(codes >= LETTERS + DIGITS), [len(text)]]) if found else None
    out: list[tuple[int, int]] = []
    for start, end in sorted(found):
        start = min(start, int(cuts[np.searchsorted(cuts, start, "right") - 1]) + 1)
        end = max(end, int(cuts[np.searchsorted(cuts, end - 1)]))
        if out and start <= out[-1][1]:
            start, end = out[-1][0], max(end, out.pop()[1])
        out.append((start, end))
    return out


def looks_random(text: str, models: Models) -> bool:
    """Whether any stretch of a run of token characters is likelier random."""
    return bool(stretches(text, models))


_TOKEN = np.zeros(256, bool)
_TOKEN[np.frombuffer(ALPHABET.encode(), np.uint8)] = True
_LOWER_HEX = np.zeros(256, bool)
_LOWER_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True


def longest_run(data: np.ndarray, member: np.ndarray, least: int) -> bool:
    """Whether ``least`` neighbouring bytes are members."""
    out = np.flatnonzero(~member[data])
    edges = np.diff(out, prepend=-1, append=len(data))
    return bool((edges > least).any())


def find(text: str, models: Models) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all findings in order; kinds are places in KINDS."""
    raw = text.encode()
    found = []
    folded = raw.lower()
    if any(k in folded for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    data = np.frombuffer(raw, np.uint8)
    if longest_run(data, _TOKEN, SHORTEST):
        if longest_run(data, _LOWER_HEX, 24):
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        base, i = sorted(found), 0
        near: list[tuple[int, int, int]] = []  # base spans that begin before the run's end and end after its start
        for m in RUN.finditer(text):
            at = m.start()
            first = i
            while i < len(base) and base[i][0] < m.end():
                i += 1
            near = [x for x in near + base[first:i] if x[2] > at]
            for a, _, b in [*near, (m.end(), 0, m.end())]:
                if a - at >= SHORTEST:
                    found += [(at + i, 3, at + j) for i, j in stretches(text[at:a], models)]
                at = max(at, b)
    return sorted(found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, findings array<struct<kind, start, end>>) of every row, in order of start and kind."""
    models = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(text.as_py(), models)]
                for text in batch.column(1)
            ]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[id_col, "findings"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    return rows.mapInArrow(run, f"`{id_col}` {id_kind}, findings array<struct<kind string, start int, end int>>")
