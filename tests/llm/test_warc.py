"""Archives: round trips, digests, revisits, and archives that are not whole."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import random
from collections import Counter

import duckdb
import pytest

from quillmark.llm import queries, warc


def pages():
    rng = random.Random(2)
    texts = [None, "", "a", "<p>é日本</p>\r\n\r\n" * 40, "x" * 5000] + ["".join(rng.choice("abc \n\r<>é") for _ in range(rng.randint(0, 900))) for _ in range(30)]
    urls = ["http://a.org/x y?q=é\r\nWARC-Type: response", None, "http://b.org/"]
    rows = [(i, urls[i % 3], texts[i % len(texts)]) for i in range(200)]
    rows += [(1000 + i, "http://hot.org", "hot page") for i in range(150)]
    return rows + [(None, "http://n.org", "hot page"), (None, None, "only without an id"), (None, None, "only without an id"), (3, "http://b.org/", "other"), (1149, "u", "hot page"), (1149, "u", "hot page")]


def expected(rows):
    largest: dict = {}
    for i, _, t in rows:
        if i is not None:
            largest[t or ""] = max(largest.get(t or "", i), i)
    out = Counter()
    for i, _, t in rows:
        data = (t or "").encode()
        chosen = largest.get(t or "")
        again = chosen is not None and i != chosen
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out[i, len(data), digest, "revisit" if again else "response", chosen if again else None] += 1
    return out


def frame(spark, rows):
    extra = "payload string, data int, size int, digest int, finger int, `a.b` int, chunk_no int"
    return spark.createDataFrame([(*r, "p", *range(6)) for r in rows], f"page_id bigint, url string, html string, {extra}").repartition(3)


def test_query_matches_plain_python_and_sql(spark, tmp_path):
    rows = pages()
    frame(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter(map(tuple, queries.op12_warc(spark, str(tmp_path)).collect()))
    assert got == expected(rows)
    sound = [r for r in rows if r[0] is not None and r[0] != 1149]
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, html varchar)")
    c.executemany("insert into pages values (?, ?)", [(i, t) for i, _, t in sound])
    assert Counter(c.sql(queries.ORACLE_SQL["op12_warc"]).fetchall()) == expected(sound)


def test_payloads_come_back_in_chunks_with_running_digests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MOST_DECISIONS", 0)  # joined, not broadcast
    rows, path = pages(), str(tmp_path / "archives")
    warc.write(frame(spark, rows), path, "page_id", "url", "html", least=100, size=64)
    assert all(n.endswith(".warc.gz") for n in os.listdir(path))
    found: dict = {}
    for r in warc.read(spark, path, size=50).collect():
        found.setdefault((r.record_id, r.kind), []).append(r)
    payloads = Counter()
    for (_, kind), parts in found.items():
        parts.sort(key=lambda r: r.chunk_no)
        if kind == "response" and len({r.chunk_no for r in parts}) == len(parts):
            data = b""
            for r in parts:
                assert len(r.data) <= 50
                data += r.data
                assert (r.n_bytes, r.digest) == (len(data), warc.base32(hashlib.sha1(data).digest()))
            assert parts[-1].is_last and parts[-1].declared_digest == parts[-1].digest
            payloads[data] += 1
    # payloads of 100 bytes and more once, smaller ones for each row
    large = {t.encode() for _, _, t in rows if t and len(t.encode()) >= 100}
    assert {p for p in payloads if len(p) >= 100} == large and all(payloads[p] == 1 for p in large)
    kinds = Counter(r.kind for r in warc.records(warc.read(spark, path, data=False)).collect())
    assert kinds["response"] + kinds["revisit"] == len(rows) and kinds["revisit"] == sum(1 for _, _, t in rows if t and len(t.encode()) >= 100) - len(large)


def test_records_are_what_the_format_says(spark, tmp_path):
    path = str(tmp_path / "archives")
    warc.write(frame(spark, [(1, "http://a.org/é", "same"), (2, "http://b.org", "same")]), path, "page_id", "url", "html")
    text = b"".join(gzip.open(f"{path}/{n}").read() for n in os.listdir(path)).decode()
    assert text.count("WARC/1.1\r\n") == 2 and text.count("WARC-Profile: ") == 1 and text.count("\r\n\r\nsame\r\n\r\n") == 1
    assert "WARC-Target-URI: http://a.org/%C3%A9\r\n" in text and text.endswith("\r\n\r\n")


def test_a_repeated_write_adds_whole_archives_and_a_failed_one_nothing(spark, tmp_path):
    path = str(tmp_path / "archives")
    warc.write(frame(spark, pages()), path, "page_id", "url", "html")
    before = sorted(os.listdir(path))
    spark.dataSource.register(warc.WarcSource)
    wrong = spark.createDataFrame([("<r>", "1", "u", "response", None, "DIGEST", 2, 0, b"ab")], "record_id string, row_id string, target string, kind string, refers_to string, digest string, n_bytes bigint, chunk_no int, data binary")
    with pytest.raises(Exception, match="not the one that was announced"):
        wrong.write.format("warc").mode("append").save(path)
    assert sorted(os.listdir(path)) == before


def test_cut_archives_and_missing_responses_are_seen(spark, tmp_path):
    path = tmp_path / "archives"
    warc.write(frame(spark, [(i, "u", "same") for i in range(9)]).coalesce(1), str(path), "page_id", "url", "html")
    (name,) = os.listdir(path)
    whole = (path / name).read_bytes()
    (path / name).write_bytes(whole[:-9])
    with pytest.raises(Exception, match="the archive ends within"):
        warc.read(spark, str(path)).collect()
    text = gzip.decompress(whole)
    parts = [b"WARC/1.1" + x for x in text.split(b"WARC/1.1")[1:]]
    (path / name).unlink()
    (path / "plain.warc").write_bytes(b"".join(p for p in parts if b"WARC-Type: revisit" in p))
    found = warc.records(warc.read(spark, str(path))).collect()
    assert len(found) == 8 and all(r.intact is None and r.n_bytes is None for r in found)


def test_no_rows(spark, tmp_path):
    frame(spark, pages()).limit(0).write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.op12_warc(spark, str(tmp_path)).collect() == []
