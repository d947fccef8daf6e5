"""Near-duplicate vectors by cross-polytope hashing, with multiprobe buckets and verified links.

Each table rotates a vector by random signs and fast Hadamard transforms, three
times; the signed axis nearest to the result is its hash. ``HASHES`` of these
make a bucket, and a vector also enters the buckets of its next-best axes. Equal
vectors of a label form a class and only one of them enters. In a bucket all
vectors are compared in double precision; large buckets are dealt out in blocks,
and every two blocks meet in one task. A pair is counted in the first bucket that
its vectors share. Tasks return each vector's number of links and a spanning
forest of its block's links, never the pairs.

Defined cases: vectors that are null, empty, zero or hold nulls or non-finite
numbers, and vectors without a label, link with nothing and stay alone; vectors
of different lengths do not link. Rows that repeat an id belong together as
vectors of one id. A null id is never a link's end. An empty table gives no rows;
other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.components import connected
from quillmark.llm.runtime import checkpoint

COSINE = 0.98
#: Tables, hashes of a bucket, and buckets that a vector enters in each table.
TABLES, HASHES, PROBES = 5, 2, 4
#: Vectors of a bucket that one task compares with each other.
BLOCK = 512
SEED = 20_240_601


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, d = x.shape
    width = 1
    while width < d:
        y = x.reshape(n, d // (2 * width), 2, width)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        width *= 2
    return x


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """(rows, tables * probes) bucket numbers of unit vectors: own bucket first, then those of the nearest misses."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    rng = np.random.default_rng(SEED)
    out = np.empty((n, tables, probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        axes, loss = [], []
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size)) / np.sqrt(size)
            near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
            value = np.take_along_axis(y, near, axis=1)
            axes.append(near * 2 + (value < 0))
            loss.append(np.abs(value[:, :1]) - np.abs(value))
        code, cost = axes[0], loss[0]
        for near, more in zip(axes[1:], loss[1:], strict=True):
            code = (code[:, :, None] * (2 * size) + near[:, None, :]).reshape(n, -1)
            cost = (cost[:, :, None] + more[:, None, :]).reshape(n, -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            code, cost = code[rows[:, None], best], cost[rows[:, None], best]
        out[:, t] = code * tables + t
    return out.reshape(n, -1)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision, also of very large or small numbers."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(classes: DataFrame, number: str) -> DataFrame:
    """(label, dim, rep, size, vector, keys): vectors, packed as given (``number`` is their type), with all their bucket numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.to_pydict()
            dims = np.array([len(v) for v in f["embedding"]])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.array([f["embedding"][i] for i in at], np.float64)
                keys = buckets(_units(x))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f["label"][i] for i in at], pa.int64()),
                        pa.array(dims[at], pa.int32()),
                        pa.array([f["rep"][i] for i in at], pa.int64()),
                        pa.array([f["size"][i] for i in at], pa.int64()),
                        pa.array([v.tobytes() for v in x.astype(number)], pa.binary()),
                        pa.array(list(keys), pa.list_(pa.int64())),
                    ],
                    names=["label", "dim", "rep", "size", "vector", "keys"],
                )

    return classes.mapInArrow(
        run, "label bigint, dim int, rep bigint, size bigint, vector binary, keys array<bigint>"
    )


def _compared(hashed: DataFrame, cosine: float, number: str) -> DataFrame:
    """(rep, links, other): links of each vector counted in a block, or (other not null) an edge of its forest."""
    bucket = ["label", "dim", "key"]
    keys = hashed.select("label", "dim", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = keys.groupBy(bucket).agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select(*bucket, F.ceil(F.col("n") / BLOCK).alias("blocks"))
    rows = hashed.withColumn("key", F.explode(F.array_distinct("keys"))).join(sizes, bucket)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = [*bucket, "i", "j"]
    rows = rows.select(
        *bucket, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "size", "vector", "keys"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            part = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            begin = _begins(part, group)
            yield _links(part, begin, cosine, number)
            held = part.slice(int(begin[-1]))  # its group may go on in the next batch
        if held is not None:
            yield _links(held, np.array([0, len(held)]), cosine, number)

    dealt = rows.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(run, "rep bigint, links bigint, other bigint")


def _begins(part: pa.RecordBatch, group: list[str]) -> np.ndarray:
    """First rows of the groups of sorted rows; the last group's comes last."""
    new = np.zeros(len(part), bool)
    new[0] = True
    for c in group:
        v = part.column(c).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _links(part: pa.RecordBatch, at: np.ndarray, cosine: float, number: str) -> pa.RecordBatch:
    """Links and forest edges within the groups at[k] .. at[k + 1] of the rows."""
    label = {c: part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "own", "rep", "size", "dim")}
    vectors = part.column("vector")
    first_byte = np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset : vectors.offset + len(part) + 1]
    values = np.frombuffer(vectors.buffers()[2], np.uint8)
    keys = part.column("keys").flatten().to_numpy().reshape(len(part), TABLES, PROBES)
    out: tuple[list, list, list] = ([], [], [])
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo < 2:
            continue
        x = _units(values[first_byte[lo] : first_byte[hi]].view(number).astype(np.float64).reshape(hi - lo, label["dim"][lo]))
        link = x @ x.T >= cosine
        if label["i"][lo] != label["j"][lo]:
            own = label["own"][lo:hi]
            link &= own[:, None] != own[None, :]
        a, b = np.nonzero(np.triu(link, 1))
        if not len(a):
            continue
        rep, size = label["rep"][lo:hi], label["size"][lo:hi]
        flip = rep[a] > rep[b]
        a, b = np.where(flip, b, a), np.where(flip, a, b)
        counted = _first_shared(keys[lo:hi], a, b, label["key"][lo])
        link = np.zeros((hi - lo, hi - lo), bool)
        link[a[counted], b[counted]] = link[b[counted], a[counted]] = True
        links = link @ size
        some = links > 0
        out[0].append(rep[some])
        out[1].append(links[some])
        out[2].append(np.full(int(some.sum()), -1))
        unseen = some.copy()
        for root in np.flatnonzero(some).tolist():
            if not unseen[root]:
                continue
            unseen[root], todo = False, [root]
            while todo:
                p = todo.pop()
                new = np.flatnonzero(link[p] & unseen)
                unseen[new] = False
                todo += new.tolist()
                out[0].append(np.full(len(new), rep[p]))
                out[1].append(np.zeros(len(new), np.int64))
                out[2].append(rep[new])
    own, links, other = (np.concatenate(c) if c else np.empty(0, np.int64) for c in out)
    edge = links == 0
    return pa.RecordBatch.from_arrays(
        [pa.array(own, pa.int64()), pa.array(links, pa.int64()), pa.array(other, pa.int64(), mask=~edge)],
        names=["rep", "links", "other"],
    )


def _first_shared(keys: np.ndarray, a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
    """Whether ``key`` is the first bucket, in the order of a's keys, that rows a and b share.

    Keys of one table are equal to those of the same table only.
    """
    table = int(key) % keys.shape[1]
    out = np.empty(len(a), bool)
    for s in range(0, len(a), 8192):
        ka, kb = keys[a[s : s + 8192], : table + 1], keys[b[s : s + 8192], : table + 1]
        shared = (ka[:, :, :, None] == kb[:, :, None, :]).any(axis=3)
        here = ka[:, table][np.arange(len(ka)), shared[:, table].argmax(axis=1)] == key
        out[s : s + 8192] = here & ~shared[:, :table].any(axis=(1, 2))
    return out


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    ``n_links`` counts the other vectors of the label with at least that cosine, ``component_id`` is the
    smallest id that links reach, and ``kept`` tells whether it is the row's own.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    sound = F.coalesce(
        F.expr(f"vec_id is not null and label is not null and {finite} and exists(embedding, x -> x <> 0)"), F.lit(False)
    )
    live = rows.where(sound)
    classes = live.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    classes = checkpoint(classes)
    # vectors travel to each of their buckets: as single numbers, if they came as these
    number = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    found = checkpoint(_compared(checkpoint(_hashed(classes, number)), cosine, number))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected(found.where("other is not null").select("rep", "other"))
    of_class = (
        classes.join(links, "rep", "left")
        .join(parts.withColumnRenamed("id", "rep"), "rep", "left")
        .select(
            "label",
            "embedding",
            (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    linked = live.join(of_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
