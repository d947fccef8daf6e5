"""Phrases whose words occur together more often than apart: a count-min prefilter, exact counts of what passes, scores.

Texts are folded (A-Z), cut into pieces at signs and line ends, and pieces into words at blanks; everything is counted
by language.

1. Each task counts all runs of one to ``longest`` words of its texts in a count-min sketch of two rows, whose counters
   stop at ``least``. Sketches are merged page by page; the bits of counters that reach ``least`` are broadcast. A counter
   is never below the count of a run that falls on it, so no frequent run is lost.
2. A run passes if its counters in both rows reach ``least``, and those of the two runs that are one word shorter did, as
   they occur at least as often. Runs that pass are counted exactly: in each task by 128 bits of hashes, then, as text,
   by a shuffle of the tasks' counts.
3. Frequent runs of two words or more are scored at each cut by the counts of both parts, which are frequent as well, and
   dropped if a longer one that holds them is as frequent.

The sketch grows with the input up to ``MOST_BITS``; beyond it more runs pass, and the results stay the same.

Defined cases: null and empty texts have no words; a null language is ``und``; ids and other columns are not looked at, so
they may be null or repeat, and rows that repeat count as often as they are there; no rows give no phrases.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.bytekernel import SPACE, mix, words
from quillmark.llm.runtime import met_by_groups, slices, stored

LEAST, LONGEST, LISTED = 100, 5, 2000
#: Percent of a phrase's count at which a longer one that holds it takes its place.
SUBSUMED = 100
#: Bits of the counter index of each of the sketch's two rows, at most: a task counts in 2 * 2^26 bytes.
LEAST_BITS, MOST_BITS = 12, 26
#: Bytes of text to a counter: about 50 runs fall on it, half of what makes it pass.
BYTES_A_COUNTER = 64
PAGE = 1 << 16
#: Bytes of text that are worked on at once.
SLICE_BYTES = 2 << 20
#: Bytes of text that one task counts, if the cluster has not twice as many cores: a task hands on each phrase once.
TASK_BYTES = 512 << 20
#: Phrases that a task holds with their counts before it hands them on.
HELD = 300_000

# Signs and line ends that end a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
FOLDED = bytes(10 if b in ENDS else SPACE if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
SAME = bytes(range(256))

_B1, _B2, _B3 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Runs:
    """Words of a list of texts, and hashes of their runs; a sign or the end of a text is a word ``\\n`` that no run holds."""

    def __init__(self, texts: list[bytes], seeds: np.ndarray, both: bool):
        texts = [t.translate(FOLDED).replace(b"\n", b" \n ") + b" \n" for t in texts]
        self.joined = b" ".join(texts) + b" "
        data = np.frombuffer(self.joined, np.uint8)
        edge = np.flatnonzero(np.diff((data != SPACE).astype(np.int8), prepend=0, append=0))
        self.start, self.end = edge[::2], edge[1::2]
        w = words(texts, SAME, both)
        place = np.arange(len(self.start))
        stop = np.where(data[self.start] == 10, place, len(place))
        self.room = np.minimum.accumulate(stop[::-1])[::-1] - place
        self.text = np.repeat(np.arange(len(texts)), np.diff(w.first))
        self.words = np.bincount(self.text[self.room > 0], minlength=len(texts))
        self.seed = seeds[self.text]
        self.hash1, self.hash2 = w.hash1, w.hash2

    def lengths(self, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """(k, key): hashes of the runs of k words at every word at which as many words are left before the text list ends."""
        run = self.hash1
        for k in range(1, longest + 1):
            if k > 1:
                if len(run) < 2:
                    return
                run = run[:-1] * _B1 + self.hash1[k - 1 :]
            yield k, mix(run ^ self.seed[: len(run)])

    def second(self, at: np.ndarray, k: int) -> np.ndarray:
        """Other hashes of the runs of k words at some words."""
        out = self.seed[at]
        for j in range(k):
            out = out * _B2 + self.hash2[at + j]
        return mix(out)

    def phrase(self, i: int, k: int) -> bytes:
        return b" ".join(self.joined[self.start[i] : self.end[i + k - 1]].split())


def _counters(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The counter of each key in both rows of the sketch."""
    shift = np.uint64(64 - bits)
    return (key >> shift).astype(np.uint32), (mix(key ^ _B3) >> shift).astype(np.uint32)


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray, pa.RecordBatch]]:
    """Texts and seeds of the rows (text, seed, …) in parts of about SLICE_BYTES, and the parts."""
    for a, b in slices(pc.binary_length(batch.column(0)).to_pylist(), SLICE_BYTES):
        part = batch.slice(a, b - a)
        yield part.column(0).cast(pa.binary()).to_pylist(), np.asarray(part.column(1)).view(np.uint64), part


def _pages(rows: DataFrame, bits: int, least: int, longest: int) -> DataFrame:
    """(page, bits): per page of the sketch's counters, whether each reaches ``least``; pages without any are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((2, 1 << bits), np.uint8)
        for batch in batches:
            for texts, seeds, _ in _sliced(batch):
                runs = Runs(texts, seeds, False)
                keys = np.concatenate([key[runs.room[: len(key)] >= k] for k, key in runs.lengths(longest)])
                for row, index in zip(sketch, _counters(keys, bits), strict=True):
                    at, times = np.unique(index, return_counts=True)
                    row[at] = np.minimum(row[at] + np.minimum(times, least), least)
        pages = sketch.reshape(-1, min(PAGE, 1 << bits))
        used = np.flatnonzero(pages.any(1))
        for a in range(0, len(used), 64):
            some = used[a : a + 64]
            packed = pa.array([zlib.compress(pages[i].tobytes(), 1) for i in some], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), packed], names=["page", "counters"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, total = None, None

        def done() -> pa.RecordBatch:
            packed = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([packed], pa.binary())], names=["page", "bits"])

        for batch in batches:
            for p, counters in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != page:
                    if page is not None and (total >= least).any():
                        yield done()
                    page, total = p, np.zeros(min(PAGE, 1 << bits), np.uint16)
                total = np.minimum(total + np.frombuffer(zlib.decompress(counters), np.uint8), least).astype(np.uint16)
        if page is not None and (total >= least).any():
            yield done()

    parts = rows.select("text", "seed").mapInArrow(count, "page int, counters binary")
    return parts.repartition("page").sortWithinPartitions("page").mapInArrow(merge, "page int, bits binary")


def frequent_bits(rows: DataFrame, least: int, longest: int, total: int) -> tuple[int, np.ndarray]:
    """Index bits of the merged sketch, and for each counter of its two rows whether it reaches ``least``: at most 2 * 2^MOST_BITS bits.

    ``total`` is the number of bytes of all texts, about.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, total / BYTES_A_COUNTER)))))
    out = np.zeros((2, (1 << bits) // 8), np.uint8)
    flat, size = out.reshape(-1), min(PAGE, 1 << bits) // 8
    for page, packed in _pages(rows, bits, least, longest).toLocalIterator():
        flat[page * size : (page + 1) * size] = np.frombuffer(packed, np.uint8)
    return bits, out


class _Held:
    """Phrases with their counts, by 128 bits of hashes."""

    def __init__(self):
        self.slot: dict[int, int] = {}
        self.second, self.count, self.rows = np.empty(0, np.uint64), np.empty(0, np.int64), []

    def add(self, runs: Runs, langs: list[str], at: np.ndarray, k: int, key: np.ndarray) -> list[tuple]:
        """Count the runs of k words at some words; rows whose first 64 bits are those of another phrase come back at once."""
        other = runs.second(at, k)
        order = np.lexsort((other, key))
        at, key, other = at[order], key[order], other[order]
        new = np.flatnonzero((np.diff(key, prepend=~key[:1]) != 0) | (np.diff(other, prepend=~other[:1]) != 0))
        times = np.diff(new, append=len(key))
        at, key, other = at[new], key[new].tolist(), other[new]
        found = np.fromiter((self.slot.get(x, -1) for x in key), np.int64, len(key))
        clash = (found >= 0) & (self.second[np.maximum(found, 0)] != other) if len(self.second) else np.zeros(len(found), bool)
        fresh = np.flatnonzero(found < 0)
        begin = len(self.rows)
        for i in fresh.tolist():
            if self.slot.setdefault(key[i], len(self.rows)) != len(self.rows):
                clash[i] = True  # two phrases of this call share 64 bits
                continue
            found[i] = len(self.rows)
            self.rows.append((langs[runs.text[at[i]]], runs.phrase(at[i], k), k))
        fresh = fresh[~clash[fresh]]
        if len(self.rows) > len(self.second):
            size = max(1024, 2 * len(self.rows))
            self.second, self.count = np.resize(self.second, size), np.append(self.count, np.zeros(size - len(self.count), np.int64))
        self.count[begin : len(self.rows)] = 0
        self.second[found[fresh]] = other[fresh]
        np.add.at(self.count, found[~clash], times[~clash])
        return [(langs[runs.text[at[i]]], runs.phrase(at[i], k), k, int(times[i])) for i in np.flatnonzero(clash).tolist()]

    def batch(self, more: list[tuple] = ()) -> pa.RecordBatch:
        """All rows (lang, phrase, m, f), after which nothing is held."""
        rows = [(*r, n) for r, n in zip(self.rows, self.count[: len(self.rows)].tolist())] + list(more)
        self.__init__()
        lang, phrase, m, f = ([r[i] for r in rows] for i in range(4))
        columns = [pa.array(lang, pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(m, pa.int32()), pa.array(f, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "m", "f"])


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, m, f): runs of m words that occur at least ``least`` times, and for m = 0 the number of all words of a language."""
    if not 1 <= least <= 255:
        raise ValueError("counters hold up to 255")
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(lang).alias("seed"), lang.alias("lang"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # fewer tasks than files: sketches and counts are made by task, and more of them would be merged
    rows = rows.coalesce(max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES)))
    bits, frequent = frequent_bits(rows, least, longest, total)
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def passes(seen: np.ndarray, key: np.ndarray) -> np.ndarray:
        one, two = _counters(key, bits)
        return (seen[0][one >> 3] >> (one & 7).astype(np.uint8)) & (seen[1][two >> 3] >> (two & 7).astype(np.uint8)) & np.uint8(1) != 0

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, totals = shared.value, _Held(), {}
        for batch in batches:
            for texts, seeds, part in _sliced(batch):
                langs, runs, apart, left = part.column(2).to_pylist(), Runs(texts, seeds, True), [], None
                for name, n in zip(langs, runs.words.tolist(), strict=True):
                    totals[name] = totals.get(name, 0) + n
                for k, key in runs.lengths(longest):
                    if left is None:
                        at = np.flatnonzero(runs.room >= 1)
                    else:  # runs whose first and last k - 1 words passed
                        at = left[:-1][np.diff(left) == 1]
                        at = at[runs.room[at] >= k]
                    left = at[passes(seen, key[at])]
                    if not len(left):
                        break
                    apart += held.add(runs, langs, left, k, key[left])
                if len(held.rows) >= HELD or apart:
                    yield held.batch(apart)
        yield held.batch([(name, b"", 0, n) for name, n in totals.items()])

    found = rows.mapInArrow(find, "lang string, phrase string, m int, f bigint")
    return found.groupBy("lang", "phrase", "m").agg(F.sum("f").alias("f")).where(f"f >= {least} or (m = 0 and f > 0)")


def _key(phrase: Column) -> Column:
    """Language and phrase as one value; no phrase holds a line end."""
    return F.concat("lang", F.lit("\n"), phrase)


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, m, a, k, l, r, n, score) of the phrases of two words or more in ``found``, as ``counts`` gives it.

    The score is floor(1000 a n / (l r)) at the cut, after k words, that makes it smallest, the first one among equals.
    Parts that very many phrases have, and languages, meet their counts by broadcast.
    """
    size = F.count("*").alias("size")
    freq = found.where("m > 0").select(_key(F.col("phrase")).alias("part"), F.col("f").alias("n_part"))
    words_ = F.split("phrase", " ")
    cuts = found.where("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"), F.explode(F.expr("sequence(1, m - 1)")).alias("k"))
    cuts = cuts.withColumn("left", _key(F.array_join(F.slice(words_, F.lit(1), F.col("k")), " ")))
    cuts = cuts.withColumn("right", _key(F.array_join(F.slice(words_, F.col("k") + 1, F.col("m")), " ")))
    for side, name in (("left", "l"), ("right", "r")):
        groups = cuts.groupBy(F.col(side).alias("part")).agg(size).join(freq, "part")
        groups = stored(groups.select(F.col("part").alias(side), F.col("n_part").alias(name), "size"))
        cuts = stored(met_by_groups(cuts, groups, side, "size").drop("size", side))
    totals = found.where("m = 0").select("lang", F.col("f").alias("n"))
    cuts = met_by_groups(cuts, stored(cuts.groupBy("lang").agg(size).join(totals, "lang")), "lang", "size")
    whole = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    # at most 38 digits, exactly; more are an error
    cuts = cuts.withColumn("over", F.lit(1000).cast("decimal(4,0)") * whole["a"] * whole["n"]).withColumn("under", whole["l"] * whole["r"])
    lowest = F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("x")
    return cuts.groupBy("lang", "phrase", "m", "a", "n").agg(lowest).select("lang", "phrase", "m", "a", "x.k", "x.l", "x.r", "n", "x.score")


def subsumed(phrases: DataFrame, percent: int = SUBSUMED) -> DataFrame:
    """``phrases`` without those whose words lie in a longer one that occurs at least ``percent`` percent as often."""
    starts = "flatten(transform(sequence(2, m - 1), n -> transform(sequence(1, m - n + 1), i -> array_join(slice(w, i, n), ' '))))"
    inner = phrases.where("m > 2").withColumn("w", F.split("phrase", " ")).select("lang", F.explode(F.expr(starts)).alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(longer, ["lang", "phrase"], "left")
    return kept.where(f"longer is null or 100 * longer < {percent} * a").drop("longer")


def top(phrases: DataFrame, most: int = LISTED) -> DataFrame:
    """The first ``most`` phrases of each language with ``rank``: by score and count, highest first, then by the phrase's bytes.

    Parts of a language are ranked first, so that one task at the end sees no more than ``most`` rows of each part.
    """
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    parts = int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
    some = phrases.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= most).drop("rank")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= most)


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = LISTED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, k, m): the best collocations of each language."""
    phrases = stored(scored(stored(counts(docs, text_col, lang_col))))
    return top(subsumed(phrases), most)
