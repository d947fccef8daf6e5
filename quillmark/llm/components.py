"""Connected components of an edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.runtime import checkpoint

#: Edges that a task writes, about.
EDGES = 250_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of every id that is not its component's smallest; ``edges`` holds two integer columns.

    In turn, each id's larger neighbours are tied to its smallest neighbour, and
    its smaller neighbours and itself likewise, until nothing changes. Neighbours
    are never gathered: only their minimum is, so hubs pre-aggregate, and each
    round is written to the shared checkpoint folder, in as many parts as its
    edges need: a round makes no more edges than it got. Null ends, loops and
    repeated edges count for nothing; no edges give no rows.
    """
    a, b = (F.col(c).cast("long") for c in edges.columns[:2])
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = checkpoint(edges.where("u <> v").distinct())
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        parts = -(-int(before[0]) // EDGES)
        edges = checkpoint(small.union(least).distinct().coalesce(parts))
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
