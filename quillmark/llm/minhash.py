"""Near-duplicate documents by weighted MinHash: dart-throwing signatures, banded joining, exact verification.

A document is the multiset of its runs of five words (of all its words, if it
has one to four). Its weight for a run is the run's count. Darts are thrown at
the plane of (element weight, rank): an element's weight axis is split into
regions [2^v - 1, 2^(v+1) - 1), and every region has a Poisson stream of darts
over growing rank, all of it determined by hashes of element and region. Darts
within the element's weight count. A document takes the darts up to a rank that
yields a few for each of the ``K`` coordinates (and doubles it where one is left
empty) and keeps the earliest of each coordinate, so a coordinate agrees for two
documents with the chance of their weighted Jaccard similarity.

Documents with the same words form a class; only class representatives (smallest
ids) are compared. Signatures are cut into bands; documents that share a band are
candidates, and every link is verified on the full multisets. Candidates are
taken in two rounds, so that a group is never expanded into all its pairs: first
each document is held against one document of its bands. In bands that still hold
several components, a byte of each coordinate tells which may be linked; documents of
such components come together once, and pairs of different components whose
signatures agree often enough are verified there. Large bands and groups are dealt
out in blocks, of which every two meet, and a task returns a spanning forest.

Defined cases: words are lower-cased ASCII letters and digits and non-ASCII
characters. Documents without any word are copies of each other, save that a null
text is nobody's copy; a null id stays as it is, with itself as class. Rows that
repeat an id belong together. An empty table gives no rows; other columns are
left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.bytekernel import FOLDED_WORDS, mix, window_hashes, words
from quillmark.llm.components import connected
from quillmark.llm.runtime import checkpoint, lean, plainly_named, slices, stored

WORDS_A_SHINGLE, SIMILARITY = 5, 0.8
#: Coordinates, and those of a band. Two documents at 0.8 share none of 25 bands of 5 once in 20,000 cases.
K, ROWS = 125, 5
BANDS = K // ROWS
#: Agreeing coordinates under which a pair is taken to be below the threshold: 4 standard deviations.
LEAST_AGREEING = math.floor(K * SIMILARITY - 4 * math.sqrt(K * SIMILARITY * (1 - SIMILARITY)))
#: Documents of a band that one task compares with each other, and bytes of their texts, about.
BLOCK = 512
BLOCK_BYTES = 2 << 20
#: Repeated ids that are broadcast at most.
MOST_SHARED = 1_000_000
#: Bytes of text that are worked on at once.
SLICE_BYTES = 2 << 20

_B = np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of the distinct shingles of each text, in order."""
    w = words(texts, FOLDED_WORDS)
    first, n = w.first, WORDS_A_SHINGLE
    size = np.diff(first)
    number = np.where(size == 0, 0, np.maximum(size - n + 1, 1))
    h = window_hashes(np.append(w.hash1, np.zeros(n - 1, np.uint64)), n, _B)
    text = np.repeat(np.arange(len(texts)), number)
    at = np.repeat(first[:-1] - (np.cumsum(number) - number), number) + np.arange(len(text))
    value = h[at]
    for d in np.flatnonzero((size > 0) & (size < n)):  # a text of few words is one shingle
        own = w.hash1[first[d] : first[d + 1]]
        value[np.searchsorted(text, d)] = window_hashes(own, len(own), _B)[0]
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (value[1:] != value[:-1]))[: len(text)])
    return text[new], value[new], np.diff(new, append=len(text))


def signatures(n: int, text: np.ndarray, element: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(n, K) of uint32: the earliest dart of each coordinate, for weighted elements of n texts."""
    out = np.full((n, K), _NONE)
    total = np.bincount(text, weights=weight, minlength=n)
    regions = np.floor(np.log2(weight)).astype(np.int64) + 1
    regions += (np.exp2(regions) - 1 < weight).astype(np.int64)
    row = np.repeat(np.arange(len(text)), regions)
    level = np.arange(len(row)) - np.repeat(np.cumsum(regions) - regions, regions)
    seed = mix(element[row] ^ mix(level.astype(np.uint64) + np.uint64(1)))
    width = np.exp2(level)
    of, limit = text[row], weight[row]
    depth = K * (math.log(K) + 2)
    todo = total > 0
    reach = np.divide(depth, total, out=np.zeros(n), where=todo)
    while todo.any():
        live = np.flatnonzero(todo[of])
        rank = np.zeros(len(live))
        stream = seed[live]
        while len(live):
            stream = mix(stream + np.uint64(0x9E3779B97F4A7C15))
            rank = rank - np.log(((stream >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[live]
            on = rank <= reach[of[live]]
            live, rank, stream = live[on], rank[on], stream[on]
            spot = mix(stream ^ _B)
            place = np.exp2(level[live]) - 1 + (spot >> np.uint64(32)).astype(np.float64) * 2.0**-32 * width[live]
            hit = place < limit[live]
            dart = mix(stream[hit] ^ np.uint64(0x27D4EB2F165667C5))
            coordinate = ((dart >> np.uint64(32)) * np.uint64(K)) >> np.uint64(32)
            packed = (rank[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (
                dart & np.uint64(0xFFFFFFFF)
            )
            np.minimum.at(out, (of[live[hit]], coordinate.astype(np.int64)), packed)
        todo = todo & (out == _NONE).any(axis=1)
        reach = np.where(todo, 2 * reach, reach)
    return (out & np.uint64(0xFFFFFFFF)).astype("<u4")


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, same, signature, brief): ``same`` is equal for texts of the same words, the signature null if there are none.

    ``brief`` has one byte of each coordinate: coordinates that agree also agree in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(1)).to_pylist(), SLICE_BYTES):
                part = [t.encode() for t in batch.column(1).slice(a, b - a).to_pylist()]
                same = [xxhash.xxh3_128_digest(b" ".join(t.translate(FOLDED_WORDS).split())) for t in part]
                text, element, count = shingles(part)
                signed = signatures(len(part), text, element, count.astype(np.float64))
                some = np.bincount(text, minlength=len(part)) > 0
                packed, brief = (
                    pa.array([s.tobytes() if x else None for s, x in zip(rows, some, strict=True)], pa.binary())
                    for rows in (signed, signed.astype(np.uint8))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(same, pa.binary()), packed, brief],
                    names=["doc_id", "same", "signature", "brief"],
                )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id bigint, same binary, signature binary, brief binary")


def _similarities(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of a[i] and b[i]."""
    n = len(a)
    text, value, count = shingles(a + b)
    total = np.bincount(text, weights=count, minlength=2 * n)
    pair = text % n
    order = np.lexsort((value, pair))
    pair, value, count = pair[order], value[order], count[order]
    both = np.flatnonzero((pair[1:] == pair[:-1]) & (value[1:] == value[:-1]))
    shared = np.bincount(pair[both], weights=np.minimum(count[both], count[both + 1]), minlength=n)
    return shared / np.maximum(total[:n] + total[n:] - shared, 1)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the similarity; ``texts`` is (id, text), unique by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(pc.add(*(pc.binary_length(batch.column(c)) for c in (2, 3))).to_pylist(), SLICE_BYTES):
                part = batch.slice(a, b - a)
                left, right = ([t.encode() for t in part.column(c).to_pylist()] for c in (2, 3))
                yield part.select(["a", "b"]).filter(pa.array(_similarities(left, right) >= similarity))

    one, two = texts.select(F.col("id").alias("a"), F.col("text").alias("x")), texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(lean(run), "a bigint, b bigint")


def _dealt(rows: DataFrame, key: str, blocks: DataFrame) -> DataFrame:
    """``rows`` with columns i, j, own: every two blocks of a key's rows meet in one group (key, i, j)."""
    rows = rows.join(blocks, key).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")
    # dealt out by all three: the join leaves the rows dealt by the key alone, which a grouping would keep
    return rows.repartition(key, "i", "j")


class Group:
    """Rows of two blocks, or of one: which of them may be linked, and which are known to be in one component."""

    def __init__(self, rows: pd.DataFrame):
        self.component, self.label = np.unique(rows["component"].to_numpy(), return_inverse=True)
        self.number = self.label.copy()
        self.brief = np.frombuffer(b"".join(rows["brief"]), np.uint8).reshape(len(rows), K)
        across = rows["i"].iat[0] != rows["j"].iat[0]
        self.own = rows["own"].to_numpy() if across else np.arange(len(rows))

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """(x, others): rows of other components and blocks, after row x, that agree with it in LEAST_AGREEING coordinates."""
        for x in range(len(self.label) - 1):
            rest = x + 1 + np.flatnonzero((self.label[x + 1 :] != self.label[x]) & (self.own[x + 1 :] != self.own[x]))
            rest = rest[(self.brief[rest] == self.brief[x]).sum(axis=1) >= LEAST_AGREEING]
            if len(rest):
                yield x, rest

    def forest(self, x: int, others: np.ndarray) -> Iterator[int]:
        """Those of ``others``, one of each component, that are joined to row x."""
        while len(others := others[self.label[others] != self.label[x]]):
            yield int(others[0])
            self.label[self.label == self.label[others[0]]] = self.label[x]


def _maybe_linked(bands: DataFrame) -> DataFrame:
    """(a, b): components that may be linked; of each block of a band a spanning forest.

    ``bands`` is (band, id, component, brief).
    """
    sizes = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    sizes = sizes.where("lo <> hi").select("band", F.ceil(F.col("n") / BLOCK).alias("blocks"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        group = Group(rows)
        found = [(group.number[x], group.number[y]) for x, rest in group.candidates() for y in group.forest(x, rest)]
        return pd.DataFrame(group.component[np.array(found, np.int64).reshape(-1, 2)], columns=["a", "b"])

    return _dealt(bands, "band", sizes).groupBy("band", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def _linked(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): verified links between components of a group; of each block a spanning forest.

    ``rows`` is (part, id, component, brief, text).
    """
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sizes = sizes.select("part", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).alias("blocks"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        group, ids = Group(rows), rows["id"].to_numpy()
        text, value, count = shingles([t.encode() for t in rows["text"]])
        # each occurrence is an element of its own, so that multisets become sets
        row = np.repeat(np.arange(len(text)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        element = np.unique(mix(value[row] ^ mix(nth.astype(np.uint64))), return_inverse=True)[1]
        size = np.bincount(text[row], minlength=len(rows))
        begin = np.cumsum(size) - size
        found, mark = [], np.zeros(len(element) + 1, bool)
        for x, rest in group.candidates():
            own = element[begin[x] : begin[x] + size[x]]
            mark[own] = True
            first = np.cumsum(size[rest]) - size[rest]
            at = np.repeat(begin[rest] - first, size[rest]) + np.arange(int(size[rest].sum()))
            shared = np.add.reduceat(mark[element[at]].astype(np.int64), first)
            mark[own] = False
            linked = rest[shared >= similarity * (size[x] + size[rest] - shared)]
            found += [(ids[x], ids[y]) for y in group.forest(x, linked)]
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    return _dealt(rows, "part", sizes).groupBy("part", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, component_id, kept) of every row of ``docs`` (doc_id, text).

    ``class_id`` is the smallest id with the same words, ``component_id`` the smallest id that links of at
    least ``similarity`` reach, and ``kept`` tells whether the row is that one. The bands and the least
    agreement are made for ``SIMILARITY``; a smaller one is refused, as they would drop its pairs unseen.
    """
    if not similarity >= SIMILARITY:
        raise ValueError(f"similarity must be at least {SIMILARITY}, for which the bands are made: {similarity}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    live = rows.where("doc_id is not null and text is not null")
    signed = checkpoint(sign(live))
    classes = checkpoint(signed.groupBy("same").agg(F.min("doc_id").alias("rep")))
    member = signed.select("doc_id", "same").join(classes, "same").select("doc_id", F.col("rep").alias("class_id"))
    reps = signed.where("signature is not null").join(classes, "same").where("doc_id = rep")
    reps = reps.select(F.col("rep").alias("id"), "signature", "brief").dropDuplicates(["id"])
    number = F.posexplode_outer(
        F.expr(
            f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(substring(signature, {4 * ROWS} * b + 1, {4 * ROWS}), b))"
        )
    )
    bands = reps.select("id", number.alias("b", "h")).select(
        "id", F.col("h").bitwiseAND(F.lit(~31)).bitwiseOR(F.col("b").cast("long")).alias("band")
    )
    shared = bands.groupBy("band").agg(F.min("id").alias("m"), F.count("*").alias("n")).where("n > 1")
    bands = checkpoint(bands.join(shared, "band").select("band", "id", "m"))
    involved = bands.select("id").distinct()
    texts = live.select(F.col("doc_id").alias("id"), "text").join(involved, "id").dropDuplicates(["id"])
    texts = checkpoint(texts)
    stars = bands.where("id <> m").groupBy("id", "m").agg(F.count("*").alias("times"))
    stars = stars.groupBy("id").agg(F.expr("max_by(m, times)").alias("m")).select(F.col("m").alias("a"), F.col("id").alias("b"))
    links = checkpoint(verified(stars, texts, similarity))
    parts = connected(links)
    own = bands.join(parts, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    own = checkpoint(own.join(reps.drop("signature"), "id"))
    near = connected(_maybe_linked(own))
    near = near.union(near.select("component", "component").distinct()).toDF("component", "part")
    together = own.drop("band").dropDuplicates(["id"]).join(near, "component").join(texts, "id")
    parts = connected(links.union(_linked(checkpoint(together), similarity)))
    done = member.join(parts.withColumnRenamed("id", "class_id"), "class_id", "left").select(
        "doc_id", "class_id", F.coalesce("component", "class_id").alias("component_id")
    )
    apart = rows.where("doc_id is null or text is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id")
    )
    return done.union(apart).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, but for one of each group of near duplicates: that of the smallest id.

    Each row is judged by its own text. Rows whose id is null or repeated are written once, each with a number that no
    other row has, and stay only if their group has no row with an id of its own. Rows without a text stay.
    """
    rows = plainly_named(docs, ("text", "doc_id")).withColumn("doc_id", F.col("doc_id").cast("long"))
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    shared = checkpoint(ids.where("doc_id is null or n > 1").select("doc_id"))
    numbered = rows.withColumn("key", F.col("doc_id"))
    n = shared.count()
    if n:
        top = ids.agg(F.max("doc_id")).first()[0]
        room = top is None or top < 1 << 62
        if n <= MOST_SHARED:
            shared = F.broadcast(shared)
        same = rows["doc_id"].eqNullSafe(shared["doc_id"])
        # where there is no room above the ids, every row gets a number
        again = rows.join(shared, same, "left_semi") if room else rows
        again = stored(again.withColumn("key", F.monotonically_increasing_id() + F.lit((top or 0) + 1 if room else 0)))
        numbered = rows.join(shared, same, "left_anti").withColumn("key", F.col("doc_id")).unionByName(again) if room else again
    gone = near_duplicates(numbered.select(F.col("key").alias("doc_id"), "text"), similarity)
    gone = gone.where("not kept").select(F.col("doc_id").alias("gone"))
    kept = numbered.join(gone, F.col("key") == F.col("gone"), "left_anti").drop("key")
    kind = docs.schema["doc_id"].dataType
    return kept.withColumn("doc_id", F.col("doc_id").cast(kind)).toDF(*docs.columns)
