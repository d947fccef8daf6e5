"""The pipeline's stages on a small corpus with planted cases."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from quillmark.llm.minhash import drop_near_duplicates, near_duplicates


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = [f"{a}{b}" for a in "ka lo mi nu pe ra so ti be du".split() for b in "bel dor fin gam hil jun kip".split()]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randint(30, 120))) for i in range(60)]
    docs += [(100, docs[3][1]), (101, docs[5][1].upper() + "!"), (102, text(20) + " the leaked passage x1 x2 x3 x4 x5 x6 x7 x8 x9 x10")]
    docs += [(200 + i, text(40) + " zorgblat quimfle zorgblat") for i in range(12)] + [(300, None), (301, "")]
    labels = [(i, int(200 <= i < 300)) for i, _ in docs]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "X1 x2 x3 x4 x5 x6 x7 x8 x9 x10")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = frame
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, str(tmp_path))
        path = str(tmp_path / name)
        rows.write.parquet(path)
        rows = spark.read.parquet(path)
        ids[name] = {r.doc_id for r in rows.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert rows.columns == frame.columns
    start = {i for i, _ in docs}
    assert {i for i in start if 200 <= i < 300}.isdisjoint(ids["toxicity"]) and len(start - ids["toxicity"]) < 16
    assert ids["line_dedup"] == ids["toxicity"]
    gone = ids["line_dedup"] - ids["minhash_near_dedup"]
    stage_input = spark.read.parquet(str(tmp_path / "line_dedup"))
    assert gone == {r.doc_id for r in near_duplicates(stage_input).where("not kept").collect()} and {100, 101} <= gone
    assert ids["minhash_near_dedup"] - ids["benchmark_decontamination"] == {102}
    final = {r.doc_id: r for r in rows.collect()}
    before = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "benchmark_decontamination")).collect()}
    assert {i: r.text for i, r in final.items()} == {i: t or "" for i, t in before.items()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(final)


def test_rows_with_null_and_repeated_ids_are_judged_by_their_text(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(f"{x}{rng.randrange(500)}" for _ in range(60)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (None, a), (None, c), (None, c), (9, c + " more"), (7, None), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = drop_near_duplicates(docs)
    assert got.schema == docs.schema
    assert Counter(map(tuple, got.collect())) == Counter([(1, a), (5, b), (9, c + " more"), (7, None), (7, None), (8, "")])
    # no room above the ids, and none but null ones
    high = [(2**62 + 5, a), (None, a), (3, b), (3, b), (4, c)]
    got = drop_near_duplicates(spark.createDataFrame(high, "doc_id bigint, text string")).collect()
    assert Counter(r.text for r in got) == Counter([a, b, c])
    got = drop_near_duplicates(spark.createDataFrame([(None, a), (None, a), (None, b)], "doc_id bigint, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(None, a), (None, b)])


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    names = ["a.b", "n_lines", "n_removed", "digest", "key", "hash", "row", "left", "keys", "c1", "we`ird", "gone"]
    rows = [(i, f"text number {i} of a few\nwith two lines\nand a third", 10 + i, *range(len(names))) for i in range(6)] + [(None, "no id here", 9, *range(len(names)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, " + ", ".join(f"`{n.replace('`', '``')}` bigint" for n in names))
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "not in there at all")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        assert all(tuple(r)[3:] == tuple(range(len(names))) for r in got.collect())
    assert corpus_pipeline.encode(spark, docs, "").columns == ["doc_id", "n_tokens", "ids", "text"]
