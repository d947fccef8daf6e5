"""Tables of the session's files."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of files a core under which rows are dealt out: a file of one row group is read by one task, however many cores there are.
SMALL = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` of files; those of few and small files over all cores, others as Spark splits the files."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= 2 * cores:  # before any names are listed
        return rows
    files = rows.inputFiles()
    if not files or len(files) >= cores:
        return rows
    # names come encoded, and are taken as patterns
    names = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(f)) for f in files]
    total = spark.read.format("binaryFile").load(names).agg(F.sum("length")).first()[0]
    return rows.repartition(2 * cores) if total < SMALL * cores else rows
