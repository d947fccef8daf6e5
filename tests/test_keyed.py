"""Rows replaced by key on storage."""

from __future__ import annotations

import os
from collections import Counter

import pytest

from quillmark.sources import keyed

SCHEMA = "report bigint, rank int, note string, `a.b` int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)


def keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "report bigint")


def now(spark, path):
    return Counter((r.report, r["rank"], r.note) for r in keyed.read(spark, path, table(spark, []).schema).collect())


def test_a_run_replaces_the_rows_of_its_keys_only(spark, tmp_path):
    path = str(tmp_path / "t")
    assert now(spark, path) == Counter()
    first = [(i, k, "first") for i in range(40) for k in range(3)]
    keyed.replace(table(spark, first), keys(spark, *range(40)), path, "report", 8)
    assert now(spark, path) == Counter(first)
    before = {n: os.stat(f"{path}/{n}").st_mtime_ns for n in os.listdir(path) if n.startswith("__bucket")}
    # one report has other rows, one has none left, one is new, and a row of a key that is not the run's
    run = [(5, 9, "second"), (5, 9, "second"), (77, 0, "new"), (8, 0, "stray"), (None, 1, "no key")]
    keyed.replace(table(spark, run), keys(spark, 5, 6, 77, None), path, "report", 8)
    want = Counter(r for r in first if r[0] not in (5, 6)) + Counter([(5, 9, "second")] * 2 + [(77, 0, "new")])
    assert now(spark, path) == want
    after = {n: os.stat(f"{path}/{n}").st_mtime_ns for n in before}
    assert 0 < sum(before[n] != after[n] for n in before) <= 3
    keyed.replace(table(spark, run), keys(spark, 5, 6, 77, None), path, "report", 8)
    assert now(spark, path) == want
    keyed.replace(table(spark, []), keys(spark, *range(40), 77), path, "report", 8)
    assert now(spark, path) == Counter()


def test_a_failed_run_is_repeated(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "t")
    first = [(i, 0, "first") for i in range(20)]
    keyed.replace(table(spark, first), keys(spark, *range(20)), path, "report", 4)
    new = table(spark, [(i, 1, "second") for i in range(10)])
    broken = new.withColumn("note", F.when(F.col("report") == 7, F.raise_error(F.lit("half-way")).cast("string")).otherwise(F.col("note")))
    with pytest.raises(Exception, match="half-way"):
        keyed.replace(broken, keys(spark, *range(10)), path, "report", 4)
    assert now(spark, path) == Counter(first)
    for _ in range(2):
        keyed.replace(new, keys(spark, *range(10)), path, "report", 4)
        assert now(spark, path) == Counter([(i, 1, "second") for i in range(10)] + first[10:])


def test_no_keys_change_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.replace(table(spark, [(1, 0, "x")]), keys(spark, 1), path, "report")
    keyed.replace(table(spark, [(1, 0, "y")]), keys(spark), path, "report")
    assert now(spark, path) == Counter([(1, 0, "x")])


def test_bucketed_tables_are_met_where_they_are(spark):
    """The plan of a join with a bucketed table shuffles what arrives, to the table's buckets, and not the table."""
    from pyspark.sql import functions as F

    from quillmark.sources.scratch import bucketed

    bank = bucketed(spark.range(3000).select((F.col("id") % 700).alias("h1"), (F.col("id") % 3).cast("int").alias("h2"), "id"), ["h1", "h2"], 7)
    arriving = spark.range(500).select(F.col("id").alias("h1"), (F.col("id") % 2).cast("int").alias("h2"), F.col("id").alias("own"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        met = arriving.join(bank, ["h1", "h2"])
        assert met.count() == sum(1 for i in range(3000) if i % 700 < 500 and i % 3 == i % 700 % 2)
        plan = met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange ") == 1 and "hashpartitioning(h1" in plan.split("Exchange ")[1].split("\n")[0] and ", 7)" in plan.split("Exchange ")[1].split("\n")[0]
    assert "Bucketed: true" in plan
