"""Line dedup, benchmark decontamination and URL filters against plain Python."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
import re

from quillmark.llm import decontam, line_dedup, url_filters


def chunked(text):
    lines = (text or "").split("\n")
    h = [hashlib.md5(x.encode()).hexdigest() for x in lines]
    roll = [None] + [hashlib.md5((a + b).encode()).hexdigest() for a, b in zip(h, h[1:])]
    out = []
    for i, line in enumerate(lines):
        if i == 0 or (i > 2 and roll[i - 1] < roll[i - 2] and roll[i - 1] < roll[i]):
            out.append([])
        out[-1].append(line)
    return ["\n".join(c) for c in out]


def test_line_dedup(spark):
    rng = random.Random(2)
    pool = [f"line {i} é" for i in range(40)]
    block = [rng.choice(pool) + str(i) for i in range(12)]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        if i % 3 == 0:
            lines[len(lines) // 2 : len(lines) // 2] = block
        rows.append((i, "\n".join(lines)))
    rows += [(100, rows[3][1]), (101, ""), (102, None), (103, "\n\n\n"), (104, "\n\n\n"), (105, "x" * 9000)]
    seen, expected = set(), {}
    for i, text in rows:
        kept = []
        for c in chunked(text):
            many = "\n" in c and re.search(r"[^ \t\n\x0b\f\r]", c)
            if not (many and c in seen):
                kept.append(c)
            if many:
                seen.add(c)
        expected[i] = "\n".join(kept)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n_lines int").repartition(4)
    got = {r.doc_id: r for r in line_dedup.drop_repeats(df).collect()}
    assert {i: r.text or "" for i, r in got.items()} == expected
    assert got[102].text is None and any(r.n_removed for r in got.values())
    assert line_dedup.drop_repeats(df.limit(0)).collect() == []
    alone = spark.createDataFrame([(None, rows[3][1]), (5, rows[3][1]), (5, rows[3][1])], "doc_id bigint, text string")
    assert [r.n_removed for r in line_dedup.drop_repeats(alone).collect()] == [0, 0, 0]


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["chunks", "__id", "__keys", "__line", "keys", "row", "whole", "left", "hash", "a.b", "id"]
    text = "one\ntwo\nthree"
    rows = [(i, text, *[f"{c}{i}" for c in names]) for i in range(3)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = sorted(line_dedup.drop_repeats(df).collect())
    assert [tuple(r)[2:-2] for r in got] == [r[2:] for r in rows]
    assert [(r.text, r.n_removed) for r in got] == [(text, 0), ("", 3), ("", 3)]


def test_line_dedup_splits_hot_hashes(spark):
    """Shares decide between the two ways of meeting, not results."""
    from quillmark.llm import runtime

    rows = [(i, "hot a\nhot b\nhot c" if i % 2 else f"cold {i // 4}\nx\ny") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = []
    for share in (0.0, 0.1, 1.0):
        old, runtime.HOT_SHARE = runtime.HOT_SHARE, share
        found.append(sorted((r.doc_id, r.text, r.n_removed) for r in line_dedup.drop_repeats(df).collect()))
        runtime.HOT_SHARE = old
    assert found[0] == found[1] == found[2] and sum(n > 0 for _, _, n in found[0]) == 149


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_decontamination(spark):
    rng = random.Random(3)
    vocabulary = [f"W{i}" for i in range(30)] + ["é", "日本"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([3, 9, 10, 11, 25, 1])]
    items += [(6, None), (7, " .!"), (8, items[3][1]), (9, "unique words never met anywhere else at all in this text")]
    docs = []
    for i in range(80):
        w = [rng.choice(vocabulary[:29]) for _ in range(rng.randint(0, 50))]
        if i % 2:
            w[5:5] = words(rng.choice(items)[1])[: rng.randint(5, 25)]
        docs.append((i, ", ".join(w)))
    docs += [(100, None), (101, ""), (102, items[4][1].upper())]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, words string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for r in decontam.contamination(df, bench).collect():
        w, hit, met = words(docs[[d[0] for d in docs].index(r.doc_id)][1]), set(), set()
        for item, text in items:
            g = words(text)
            n = min(10, len(g))
            grams = {tuple(g[i : i + n]) for i in range(len(g) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    met.add(str(item))
        assert (r.n_words, r.n_hit, r.items, r.contaminated) == (len(w), len(hit), sorted(met), bool(hit)), r.doc_id
    clean = {r.doc_id for r in decontam.clean_documents(df, bench).collect()}
    assert clean == {r.doc_id for r in decontam.contamination(df, bench).where("not contaminated").collect()}
    assert decontam.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(df.limit(0), bench).collect() == []


def test_clean_documents_judges_each_row(spark):
    leaked = " ".join(f"w{i}" for i in range(12))
    rows = [(None, leaked), (None, "clean text"), (5, leaked), (5, "clean too"), (6, leaked), (7, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame([(1, leaked)], "item_id bigint, text string")
    got = {(r.doc_id, r.text) for r in decontam.clean_documents(df, bench).collect()}
    assert got == {(None, "clean text"), (5, "clean too"), (7, None)}


def test_url_filters(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    entries = [("Bad.org", "add", day(5)), ("bad.org", "remove", day(9)), ("bad.org", "add", day(15)), ("a.bad.org", "add", day(7)), (None, "add", day(1)), ("tie.net", "add", day(3)), ("tie.net", "remove", day(3))]
    urls = ["http://bad.org/x", "https://U@a.BAD.org:80/?q", "http://notbad.org", "http://tie.net/", "no url", None]
    rows = [(i * 100 + d, u, day(d) if d else None) for i, u in enumerate(urls) for d in (0, 4, 5, 8, 9, 20)]
    captures = spark.createDataFrame(rows, "page_id int, url string, fetched timestamp")
    listed = spark.createDataFrame(entries, "domain string, action string, since timestamp")
    got = {r.page_id: (r.host, r.blocked, r.entry) for r in url_filters.judge(captures, listed).collect()}
    b = {0: None, 4: None, 5: "bad.org", 8: "bad.org", 9: None, 20: "bad.org"}
    a = {0: None, 4: None, 5: "bad.org", 8: "a.bad.org", 9: "a.bad.org", 20: "a.bad.org"}
    for d in b:
        assert got[d] == ("bad.org", b[d] is not None, b[d])
        assert got[100 + d] == ("a.bad.org", a[d] is not None, a[d])
        assert got[200 + d][1:] == got[300 + d][1:] == got[400 + d][1:] == got[500 + d][1:] == (False, None)
    assert url_filters.judge(captures.limit(0), listed).collect() == []
    assert not any(r.blocked for r in url_filters.judge(captures, listed.limit(0)).collect())
