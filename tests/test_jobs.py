"""States of jobs as a stream against the states of the whole log."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from quillmark.operators import records
from quillmark.sources import keyed
from quillmark.streaming import jobs

SCHEMA = "job_id bigint, at timestamp, seq bigint, kind string, step string, message string"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, old)


def run(spark, tmp_path, parts, **options):
    source = str(tmp_path / "log")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        jobs.follow(stream, str(tmp_path / "states"), str(tmp_path / "checkpoint"), **options).awaitTermination()
    columns = records.job_states(spark.createDataFrame([], SCHEMA)).schema
    return {r.job_id: tuple(r) for r in keyed.read(spark, str(tmp_path / "states"), columns).collect()}


def test_shuffled_batches_end_in_the_states_of_the_log(rocks, tmp_path):
    rng = random.Random(3)
    begin = dt.datetime(2024, 1, 1)
    log = []
    for n in range(400):
        kind = rng.choice(["start", "step", "step", "success", "failure"])
        log.append((rng.randrange(40), begin + dt.timedelta(minutes=rng.randrange(300)), n, kind, f"step {n}", f"message {n} " * 200))
    whole = {r.job_id: tuple(r) for r in records.job_states(rocks.createDataFrame(log, SCHEMA)).collect()}
    rng.shuffle(log)
    assert run(rocks, tmp_path, [log[i::3] for i in range(3)]) == whole


def test_silent_jobs_fail(rocks, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    first = [(1, at(0), 1, "start", "s", ""), (2, at(0), 2, "start", "s", ""), (2, at(1), 3, "success", "s", ""), (3, at(2), 4, "step", "s", "")]
    later = [(4, at(500), 5, "start", "s", "")]
    got = run(rocks, tmp_path, [first, later, [(4, at(501), 6, "step", "t", "")]], patience=dt.timedelta(minutes=30), late="10 minutes")
    assert {i: r[1] for i, r in got.items()} == {1: "FAILED", 2: "SUCCESS", 3: "PENDING", 4: "RUNNING"}
    assert got[1][5] == at(30) and got[1][7] == jobs.TIMED_OUT
