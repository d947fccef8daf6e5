"""Thresholds on both sides, and properties, of the originality operators, on literals."""

from __future__ import annotations

import io
import random
import time
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import access, chunks, intervals, reports, sections, similarity, style, webqueries
from quillmark.params import BANK, INTERNAL, Windowing
from quillmark.sources import files, pages


def words(n: int, stem: str = "w") -> str:
    return " ".join(f"{stem}{i}" for i in range(n))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_tokens_reject_words_with_foreign_characters(spark):
    text = "garçon foo_bar m² cafés año pingüino A1 ½ 3½ 😀 fin"
    got = chunks.tokens(frame(spark, [text])).orderBy("ix").collect()
    assert [r.token for r in got] == ["cafés", "año", "pingüino", "A1", "fin"]
    assert all(text[r.start_offset : r.end_offset] == r.token for r in got)


@pytest.mark.parametrize("n", [27, 34, 35, 45, 79, 80, 85, 86, 90, 130, 400])
def test_windows(spark, n):
    text = "«" + words(n) + "»"
    got = chunks.chunks(frame(spark, [text, None, ""]), BANK).orderBy("chunk_ix").collect()
    expected = [(i, min(85, n - 45 * i)) for i in range(n) if n - 45 * i >= 35]
    assert [(r.chunk_ix, r.word_count) for r in got] == expected
    for r in got:
        assert r.text_excerpt.split() == [f"w{k}" for k in range(45 * r.chunk_ix, 45 * r.chunk_ix + r.word_count)]


def test_windows_of_texts_with_other_words(spark):
    """Words that are no tokens stand between tokens: windows keep them, wherever they are counted."""
    other = ["garçon", "x²", "日本語", "foo_bar", "—", "naïve-"]
    texts = [" ".join(f"{other[i % 6]}, w{i}" if i % every == 0 else f"Ñw{i}." for i in range(190)) + tail for every in (1, 7, 500) for tail in ("", " garçon")]
    rows = chunks.chunks(frame(spark, texts), Windowing(85, 45, 30)).collect()
    plain = spark.createDataFrame([(texts[r.doc_id][r.start_offset : r.end_offset],) for r in rows], "x string").select(T.normalized(F.col("x")))
    assert [r.normalized_text for r in rows] == [r[0] for r in plain.collect()] and len({r.doc_id for r in rows}) == 6
    assert all(r.text_excerpt == texts[r.doc_id][r.start_offset : r.end_offset] for r in rows)


def test_normalized(spark):
    got = frame(spark, ["  Él ÑANDÚ, pingüino—99! ", "___"]).select(T.normalized(F.col("text")).alias("x")).collect()
    assert [r.x for r in got] == ["el nandu pinguino 99", ""]


def test_half_even(spark):
    for n, d, want in [(5, 2, 2), (7, 2, 4), (1, 2, 0), (3, 2, 2), (10, 3, 3), (11, 3, 4), (0, 7, 0)]:
        assert spark.sql(f"select {T.half_even(str(n), str(d))} x").first().x == want


@pytest.mark.parametrize(("run", "points"), [(9, 0), (10, 8), (14, 12), (18, 18)])
def test_phrase_bonus(spark, run, points):
    chunk = words(40).split()
    pairs = spark.createDataFrame([(" ".join(chunk), "x " + " ".join(chunk[5 : 5 + run]) + " y")], "q_text string, c_text string")
    assert similarity.with_bonus(pairs, INTERNAL).first().bonus == points


def test_copies_score_all(spark):
    d = frame(spark, [words(120), words(120), words(60, "other")])
    w = Windowing(85, 45, 30)
    q = chunks.chunks(d, w).select("doc_id", "chunk_ix", "start_offset", "end_offset", "normalized_text")
    c = q.select(F.col("doc_id").alias("cand_doc"), F.col("chunk_ix").alias("cand_chunk"), "normalized_text")
    scores = similarity.class_scores(similarity.classes(q, "q", "doc_id"), similarity.classes(c, "c", "cand_doc"), INTERNAL, False)
    got = similarity.every_pair(scores, q, c).where("doc_id <> cand_doc and chunk_ix = cand_chunk").collect()
    assert {(r.doc_id, r.chunk_ix, r.hundredths) for r in got} == {(d, i, 10000) for d in (0, 1) for i in (0, 1)} | {
        (d, i, 10000) for d in (0, 1) for i in {r.chunk_ix for r in got}
    }


def test_merged_ranges(spark):
    rows = [(1, 0, 10), (1, 10, 12), (1, 3, 5), (1, 20, 30), (1, 20, 30), (1, 40, 40), (2, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id int, start_offset int, end_offset int")
    got = {tuple(r) for r in intervals.merged(df).collect()}
    assert got == {(1, 0, 12), (1, 20, 30), (2, 5, 6)}
    assert {tuple(r) for r in intervals.covered(df).collect()} == {(1, 22), (2, 1)}


def test_segments_give_the_text_back(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, "xyz")], "doc_id int, text string")
    found = spark.createDataFrame(
        [(1, 2, 5, "SIMILARITY", 0), (1, 4, 8, "AI_GENERATED", 1), (1, 5, 99, "AI_GENERATED", 1), (1, 10, 12, "SIMILARITY", 0)],
        "doc_id int, start_offset int, end_offset int, finding_type string, priority int",
    )
    got = [(r.doc_id, r.text, r.finding_type) for r in intervals.segments(docs, found).orderBy("doc_id", "seg_ix").collect()]
    assert got == [(1, "ab", None), (1, "cde", "SIMILARITY"), (1, "fghij", "AI_GENERATED"), (2, "xyz", None)]


def test_reference_tail(spark):
    late, early = "x" * 60 + " Referencias " + "y" * 20, "x" * 20 + " anexo " + "y" * 60
    inside = "x" * 60 + " prereferencias2 " + "y" * 20
    got = [r.cut for r in sections.reference_tail(frame(spark, [late, early, inside])).orderBy("doc_id").collect()]
    assert got == ["x" * 60, early, inside]


def test_covers_and_low_value(spark):
    two, three = "Tesis de la Universidad " + "x" * 60, "Tesis de la Facultad, Universidad " + "x" * 60
    contents = "\n".join(["Capítulo uno ... 1", "Capítulo dos 22"] + ["línea corta de texto"] * 3)
    rows = spark.createDataFrame(
        [(two, 3), (three, 3), (three, 4), (three + "x" * 1200, 0), ("x" * 39, 9), ("x" * 40, 9), (contents, 9), ("Índice\n" + "x" * 60, 9)],
        "p string, ix int",
    )
    got = rows.select(sections.looks_like_cover(F.col("p"), F.col("ix")).alias("c"), sections.low_value(F.col("p")).alias("v")).collect()
    assert [r.c for r in got] == [False, True, False, False, False, False, False, False]
    assert [r.v for r in got] == [False, False, False, False, True, False, True, True]


def test_filtered_falls_back_to_the_text(spark):
    got = sections.filtered(frame(spark, ["short", "a" * 50 + "\n\n" + "b" * 20])).orderBy("doc_id").collect()
    assert [(r.content, r.excluded) for r in got] == [("short", [sections.LOW_LABEL]), ("a" * 50, [sections.LOW_LABEL])]


def test_style(spark):
    sentence = "Además resulta fundamental cada palabra larga dentro del texto que tenemos para probar esta cosa nueva. "
    p = (sentence * 4).strip()
    got = style.scores(frame(spark, [f"intro\n\n  {p}", "x" * 119, words(44, "palabra")])).collect()
    assert [r.paragraph for r in got if r.doc_id == 0] == [p]
    r = next(r for r in got if r.doc_id == 0)
    assert f"intro\n\n  {p}"[r.start_offset : r.end_offset] == p
    # equal sentences 20, their length 13 or 7, connectors 18, generic phrases 18, punctuation 0, repeats 8
    assert r.score == 20 + 18 + 18 + 8 + (13 if 16 <= len(re.findall(r"\w{3,}", sentence)) <= 28 else 7)


@pytest.mark.parametrize(
    ("similarity_percent", "style_percent", "level"),
    [(1499, 0, "LOW"), (1500, 0, "MEDIUM"), (2999, 3499, "MEDIUM"), (3000, 0, "HIGH"), (0, 6000, "HIGH"), (5000, 0, "CRITICAL"), (0, 8000, "CRITICAL"), (0, 3500, "MEDIUM")],
)
def test_risk(spark, similarity_percent, style_percent, level):
    assert spark.range(1).select(reports.risk_level(F.lit(similarity_percent), F.lit(style_percent)).alias("x")).first().x == level


def test_pages(spark):
    body = "palabra &amp; más " * 40
    html = f"<html><title>T &quot;x&quot;</title><nav>no<script>no</script></nav><p>{body}</p><!-- no --><script>no</script></html>"
    rows = [(1, "https://www.a.com:80/x", html), (2, "http://b.www.c/d.PDF?x", "<p>short</p>"), (3, "http://e.f/g.JPG?y=1", html), (4, None, None)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = pages.page_texts(df).collect()
    assert [(r.page_id, r.domain, r.title) for r in got] == [(1, "a.com:80", 'T "x"')]
    assert " no" not in got[0].text and "& más" in got[0].text
    assert [r.b for r in df.select(pages.blocked(F.col("url")).alias("b")).collect()] == [False, False, True, False]


def test_search_phrases(spark):
    ten = " ".join(["palabra"] * 10) + "."
    p = f"{ten} {words(34, 'larga')}. {words(35, 'demasiado')}. fin"
    got = webqueries.phrases(frame(spark, [p, p.upper() + "\n\n" + p, "índice " + p])).orderBy("doc_id").collect()
    assert got[0].phrases == [f"{words(34, 'larga')}."[:260]] and len(got[1].phrases) == 1 and got[2].phrases == []
    queries = webqueries.queries(webqueries.phrases(frame(spark, [p]))).first().queries
    assert len(queries) == 14 and queries[0].startswith('"') and queries[-1].endswith("filetype:pdf")


def test_scopes_and_search(spark):
    d = spark.createDataFrame([(1, 7, 1), (2, 8, 1), (3, 8, 2)], "doc_id int, owner_id int, institution_id int")
    seen = lambda *a: sorted(r.doc_id for r in access.visible_to(d, *a).collect())
    assert seen(7, "STUDENT", True, 1) == [1]
    assert seen(9, "TEACHER", False, 1) == [1, 2]
    assert seen(9, "ADMIN", True, None) == [1, 2, 3]
    assert seen(9, "TEACHER", False, None) == []


def test_upserts_and_identities(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in reports.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    row = spark.range(1).select(
        reports.verification_url(F.lit("https://x//"), F.lit("/v/1")).alias("url"),
        reports.display_name(F.lit(" "), F.lit(""), F.lit("u")).alias("name"),
        reports.percent_text(F.lit(1205)).alias("percent"),
    ).first()
    assert tuple(row) == ("https://x/v/1", "u", "12.05")


def test_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>{'uno ' * 40}</w:t></w:r></w:p><w:p/><w:tbl><w:tr>{cell.format('a')}{cell.format('b')}</w:tr></w:tbl></w:body></w:document>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "c.txt").write_bytes(b"text")
    found = files.read_files(spark, str(tmp_path))
    kinds = {r.path[-5:]: r.k for r in found.select("path", files.mime_type(F.col("content")).alias("k")).collect()}
    assert kinds == {".docx": files.DOCX, "b.pdf": files.PDF, "c.txt": None}
    row = files.extract_docx(found).first()
    assert row.content == ("uno " * 40).strip() + "\na b" and row.word_count == 42


def test_files_that_cannot_be_read(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/workbook.xml", "<x/>")
    broken = buffer.getvalue().replace(b"xl/workbook", b"word/no_doc")
    for name, content in {"a.zip": buffer.getvalue(), "b.docx": broken, "c.docx": broken[:40], "d.pdf": b"%PDF-", "e.txt": b"x"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path[-6:]: r.error for r in files.extract(files.read_files(spark, str(tmp_path))).collect()}
    assert got == {"/a.zip": "unsupported", "b.docx": "unreadable", "c.docx": "unreadable", "/d.pdf": "unsupported", "/e.txt": "unsupported"}


def test_bank_stream_sees_what_arrived_earlier(spark, tmp_path):
    from quillmark.streaming.bank import grow_bank

    source, bank, seen = str(tmp_path / "in"), str(tmp_path / "bank"), []
    for ids in ([1, 2], [3]):
        spark.createDataFrame([(i, words(120, f"w{i}")) for i in ids], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id bigint, text string").parquet(source)
        look = lambda batch, known: seen.append(({r.doc_id for r in batch.collect()}, {r.doc_id for r in known.collect()}))
        grow_bank(stream, bank, str(tmp_path / "log"), look).awaitTermination()
    assert seen == [({1, 2}, set()), ({3}, {1, 2})]
    assert {r.doc_id for r in spark.read.parquet(bank).collect()} == {1, 2, 3}


def test_needs_bound_bonuses(spark):
    """No phrase of a size is contained without as many shared shingles as the bound says, words repeated or not."""
    rng, rows = random.Random(4), []
    for _ in range(60):
        chunk = [f"v{rng.randrange(rng.choice([2, 6, 60]))}" for _ in range(rng.randint(12, 60))]
        at, n = rng.randrange(len(chunk)), rng.randint(8, 30)
        rows.append((" ".join(chunk), "x" + " ".join(chunk[at : at + n]) + "y"))
    pairs = similarity.with_needs(spark.createDataFrame(rows, "q_text string, c_text string"), "q_text")
    shingles = lambda t: {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)}
    for r in similarity.with_bonus(pairs, INTERNAL).collect():
        k = len(shingles(r.q_text) & shingles(r.c_text))
        assert r.bonus <= max([0, *(p for p, need in zip(INTERNAL.bonus, (r.need0, r.need1, r.need2)) if k >= need)])


def test_small_files_are_dealt_over_all_cores(spark, tmp_path):
    from quillmark.sources.tables import dealt, table

    folder = str(tmp_path / "a b{c}%20é")
    spark.range(100).coalesce(1).write.parquet(f"{folder}/t.parquet")
    rows = dealt(table(spark, folder.replace("{", "\\{").replace("}", "\\}"), "t"))
    assert rows.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism and rows.count() == 100
    assert dealt(spark.range(5)).count() == 5


@pytest.mark.parametrize("best_only", [False, True])
def test_left_out_shingles_lose_nothing(spark, monkeypatch, best_only):
    """Texts of few words share frequent shingles; with every shingle taken for frequent, all pairs and counts stay."""
    monkeypatch.setattr(similarity, "LEAST_FREQUENT", 0)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    texts = set()
    for _ in range(60):
        at, n = rng.randrange(30), rng.randint(3, 25)
        texts.add(" ".join(rng.choices(base[:3], k=rng.randint(0, 20)) + base[at : at + n] + rng.choices(base, k=rng.randint(0, 30))))
    texts = sorted(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, normalized_text string").withColumn("chunk_ix", F.lit(0))
    c = rows.select(F.col("doc_id").alias("cand_doc"), F.lit(0).alias("cand_chunk"), "normalized_text")
    scores = similarity.class_scores(similarity.classes(rows, "q", "doc_id"), similarity.classes(c, "c", "cand_doc"), INTERNAL, best_only)
    got = {(r.doc_id, r.cand_doc): (r.k, r.hundredths) for r in similarity.every_pair(scores, rows, c).collect()}
    shingles = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} or {(w,) for w in t.split()} for t in texts]
    pairs = [(i, j, len(a & b), a, b) for i, a in enumerate(shingles) for j, b in enumerate(shingles) if i != j and a & b]
    frame_ = spark.createDataFrame([(i, j, k, len(a), len(b), texts[i], texts[j]) for i, j, k, a, b in pairs], "doc_id int, cand_doc int, k int, c int, p int, q_text string, c_text string")
    want = {(r.doc_id, r.cand_doc): (r.k, r.hundredths) for r in similarity.scored(similarity.with_bonus(frame_, INTERNAL), INTERNAL).collect()}
    if best_only:
        assert all(want[x] == got[x] for x in got)
        assert {i: max(h for (a, _), (_, h) in want.items() if a == i) for i, _ in want} == {i: max(h for (a, _), (_, h) in got.items() if a == i) for i, _ in got}
    else:
        assert got == want


def test_segments_match_a_scan_and_take_many_findings(spark):
    rng = random.Random(5)
    docs, found = [], []
    for d in range(30):
        text = "".join(rng.choice("ab é日🎉") for _ in range(rng.choice([0, 1, 50, 9000])))
        docs.append((d, text))
        for _ in range(rng.choice([0, 1, 5, 60])):
            a = rng.randint(0, len(text) + 3)
            found.append((d, a, a + rng.randint(-1, rng.choice([3, 40, 5000])), rng.choice(["S", "A"]), rng.randint(0, 1)))
    docs.append((99, "x y " * 100_000))
    found += [(99, 3 * i, 3 * i + rng.randint(1, 9), "S", 0) for i in range(100_000)]
    schema = "doc_id int, start_offset int, end_offset int, finding_type string, priority int"
    began = time.time()
    got: dict = {}
    for r in intervals.segments(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(found, schema)).collect():
        got.setdefault(r.doc_id, []).append((r.seg_ix, r.text, r.finding_type))
    assert time.time() - began < 60
    for d, text in docs:
        cursor, want = 0, []
        for _, a, _, b, kind in sorted((x[0], x[1], x[4], x[2], x[3]) for x in found if x[0] == d):
            if a < b and cursor <= a < len(text):
                want += [(text[cursor:a], None)] * (cursor < a) + [(text[a : min(b, len(text))], kind)]
                cursor = min(b, len(text))
        want += [(text[cursor:], None)] * (cursor < len(text))
        assert [x[1:] for x in sorted(got.get(d, []))] == want


def test_indexed_search_finds_what_a_scan_finds(spark):
    from quillmark.operators import access

    rng = random.Random(3)
    rows = [(i, *("".join(rng.choice("abcAB é") for _ in range(rng.randint(0, 12))) for _ in range(2))) for i in range(300)] + [(300, None, "abcab"), (301, None, None)]
    df = spark.createDataFrame(rows, "id int, one string, two string")
    index = access.trigram_index(df, "id", ["one", "two"])
    for terms in ("abc", "ABC ba", "a b", "abca cab", "zzz", "", "é a"):
        want = sorted(r.id for r in access.search(df, terms, ["one", "two"]).collect())
        assert sorted(r.id for r in access.indexed_search(df, index, terms, "id", ["one", "two"]).collect()) == want
    counts = {(r.facet, r.value): r.n for r in access.faceted(df.selectExpr("id % 2 = 0 as even", "id div 100 as century"), ["even", "century"]).collect()}
    assert counts == {("even", "true"): 151, ("even", "false"): 151, ("century", "0"): 100, ("century", "1"): 100, ("century", "2"): 100, ("century", "3"): 2}


def test_scopes_go_through_the_document(spark):
    from quillmark.operators import access

    documents = spark.createDataFrame([(1, 7, 3), (2, 8, 3), (3, 8, 4), (4, 9, None)], "id int, owner_id int, institution_id int")
    reports = spark.createDataFrame([(10, 1), (20, 2), (30, 3), (40, 4), (50, None)], "report_id int, document_id int")
    certificates = spark.createDataFrame([("a", 10), ("b", 20), ("c", 20), ("d", 40), ("e", 99)], "code string, report_id int")
    parents = [(reports, "report_id", "report_id"), (documents, "document_id", "id")]
    seen = lambda *who: sorted(r.code for r in access.visible_through(certificates, parents, *who).collect())
    assert seen(7, "STUDENT") == ["a"] and seen(1, "TEACHER", False, 3) == ["a", "b", "c"] and seen(1, "TEACHER", False, None) == []
    assert seen(1, "ADMIN", True) == ["a", "b", "c", "d"] and seen(9, "STUDENT", True) == ["d"]


def test_a_passage_of_many_texts_gives_each_its_best_only(spark, monkeypatch):
    """Texts that share one passage and nothing else: each gets the newest of its best, and no row for every two of them."""
    rng = random.Random(5)
    passage = " ".join(f"pasaje{i}" for i in range(13))
    texts = []
    for i in range(120):
        own = [f"w{i}x{j}" for j in range(rng.choice((40, 41, 42)))]
        at = rng.randrange(len(own))
        texts.append((i, 0, " ".join([*own[:at], passage, *own[at:]])))
    monkeypatch.setattr(similarity, "LEAST_FREQUENT", 16)
    rows = spark.createDataFrame(texts, "doc_id bigint, chunk_ix int, normalized_text string")
    c = rows.select(F.col("doc_id").alias("cand_doc"), F.col("chunk_ix").alias("cand_chunk"), "normalized_text")
    both = similarity.sides(rows, c, "doc_id", "cand_doc", (F.col("cand_doc"), F.col("cand_chunk")))
    found = similarity.scores(both, INTERNAL, True).persist()
    assert 0 < found.count() <= len(texts)
    best = {r.doc_id: (r.cand_doc, r.hundredths) for r in similarity.best_of_others(found, rows, c, "cand_doc", "cand_chunk").collect()}
    pairs = similarity.every_pair(similarity.scores(both, INTERNAL, False), rows, c).where("doc_id <> cand_doc").collect()
    want: dict = {}
    for r in pairs:
        want[r.doc_id] = max(want.get(r.doc_id, (0, 0)), (r.hundredths, r.cand_doc))
    assert best == {d: (c, h) for d, (h, c) in want.items()}
