"""Tables that a plan writes for itself in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only in local mode, where none is named."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return named or context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` written once and read again: what comes after neither makes them anew nor depends on how they were made."""
    path = new_folder(rows.sparkSession, "tables")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def bucketed(rows: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """``rows`` written once as a table in buckets, sorted in each: joins by these columns don't shuffle it, whatever meets it."""
    spark, path = rows.sparkSession, new_folder(rows.sparkSession, "buckets")
    name = f"bucketed_{uuid.uuid4().hex}"
    rows = rows.repartition(buckets, *by)  # as the buckets are dealt, so that each is one file
    rows.write.format("parquet").bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(name)
    return spark.table(name)
