"""Session helpers shared by the operators: reading tables and cutting lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.sources import tables
from quillmark.sources.tables import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(tables.table(spark, sf_dir, name))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Only where neither the setting nor a checkpoint folder exists (as in local
    tests) is a folder of our own set; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return named or context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table of its own in the shared folder, and read again: compressed, and read by column."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tables-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plainly_named(df: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """``df`` with other columns than ``own`` named by their place, so that no name of the caller's clashes or needs quoting.

    ``toDF`` gives the names back, whatever they are.
    """
    return df.toDF(*[c if c in own else f"c{i}" for i, c in enumerate(df.columns)])


#: Caches that a worker process keeps between its tasks, by the function that fills them.
HELD: list[Callable] = []


def held(cached: Callable) -> Callable:
    """Marks a function with an ``lru_cache`` as one whose values go when a task of another operator begins."""
    HELD.append(cached)
    return cached


def lean(run: Callable, keep: bool = False) -> Callable:
    """``run`` for ``mapInArrow``, so that a worker process, which tasks of all operators share, holds what this one needs.

    What earlier tasks cached goes first, unless this operator is the one that uses it (``keep``). Arrow's pool keeps
    the pages of what it has freed, a hundred megabytes after batches of texts; they are given back after each batch.
    """

    def leanly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep and any(f.cache_info().currsize for f in HELD):
            for f in HELD:
                f.cache_clear()
            gc.collect()
        for batch in run(batches):
            yield batch
            del batch
            pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()

    return leanly


#: A key with more than this share of all rows is hot; there can be no more than its inverse of them.
HOT_SHARE = 1e-4


def met_by_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, one row of each key with its number of rows.

    Rows of hot keys meet them by broadcast, at most 1 / HOT_SHARE rows of ``groups``, and stay where they are; others
    are shuffled by key. ``rows`` is read three times.
    """
    hot = F.col(size) > F.lit(HOT_SHARE * rows.count())
    few = F.broadcast(groups.where(hot))
    rest = rows.join(few.select(key), key, "left_anti").join(groups.where(~hot), key)
    return rows.join(few, key).unionByName(rest)


def slices(sizes, most: int):
    """Consecutive [a, b) ranges whose sizes add up to at most ``most`` (or hold a single item)."""
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)
