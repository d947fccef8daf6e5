"""What worker processes keep between tasks, and into how many parts small results are written."""

from __future__ import annotations

import json

import pyarrow as pa

from quillmark.llm import bpe, components
from quillmark.llm.runtime import lean


def test_vocabularies_go_when_another_operator_begins(tmp_path):
    path = tmp_path / "bytes.json"
    path.write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": [["a", "b"]]}, "added_tokens": []}))
    assert bpe.encoder(str(path)).encode(["abab"])[0].tolist() == [2, 2]
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["x"])
    assert list(lean(iter, keep=True)(iter([rows, rows]))) == [rows, rows]
    assert bpe.encoder.cache_info().currsize
    assert list(lean(iter)(iter([rows, rows]))) == [rows, rows]
    assert not bpe.encoder.cache_info().currsize
    assert bpe.decode_ids(bpe.encoder(str(path)).encode(["abba"])[0], str(path)) == "abba"


def test_small_rounds_are_written_in_few_parts(spark, monkeypatch):
    chain = [(i, i + 1) for i in range(30)] + [(100 + i, 130) for i in range(30)]
    truth = {i: 0 for i in range(1, 31)} | {i: 100 for i in range(101, 131)}
    edges = spark.createDataFrame(chain, "a bigint, b bigint")
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = components.connected(edges)
        assert got.rdd.getNumPartitions() == 1
        assert {r.id: r.component for r in got.collect()} == truth
        monkeypatch.setattr(components, "EDGES", 10)
        got = components.connected(edges)
        assert 1 < got.rdd.getNumPartitions() <= 16
        assert {r.id: r.component for r in got.collect()} == truth
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
