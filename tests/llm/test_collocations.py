"""Collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from quillmark.llm import collocations, queries


def brute(rows, least=100, longest=5, most=2000):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    kept, longer = [], Counter()
    frequent = {p: a for p, a in f.items() if a >= least}
    for (lang, w), a in frequent.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    for (lang, w), a in frequent.items():
        if len(w) > 1 and longer[lang, w] < a:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            kept.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right, total in sorted(kept):
        rank[lang] += 1
        if rank[lang] <= most:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, total, -score))
    return Counter(out)


def corpus():
    rng = random.Random(8)
    words = "the of New york CITY ÉTÉ été naïve 日本 x=1 a-b\x1c co\xa0op".split(" ")
    draw = lambda n: " ".join(rng.choices(words, [9, 6, 3, 3, 3, 1, 1, 1, 1, 1, 1, 1], k=n))
    rows = [(draw(rng.randint(0, 40)), rng.choice(["en", "en", "en", "de", None, "und"])) for _ in range(900)]
    rows += [("in the New York City hall\tof fame, " * 40 + "in the", "en")] * 3 + [("in the new york city hall", "en")] * 120
    rows += [("the the the the the the the the " * 400, "de"), ("x " * 30_000, "xx"), ("", "en"), (None, "en"), (None, None), (" \t. ,\n", "fr")]
    return rows + [("a b\nc\x0bd\x0ce\rf;g:h!i?j.k,l", "en")] * 150


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    extra = "m int, a bigint, `a.b` int, seed int, part string, size int, `left` int, k int, rank int, n int, longer int"
    return spark.createDataFrame([(t, g, *range(4), "p", *range(6)) for t, g in rows], f"text string, lang string, {extra}").repartition(5)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_query_matches_brute_force(spark, rows, tmp_path):
    frame(spark, rows).withColumnRenamed("m", "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_collocations(spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("held", [1, 50])
def test_crowded_sketch_and_few_held_phrases_change_nothing(spark, rows, monkeypatch, held):
    """A sketch of 16 counters a row lets nearly everything pass; the exact counts stay."""
    monkeypatch.setattr(collocations, "LEAST_BITS", 4)
    monkeypatch.setattr(collocations, "MOST_BITS", 4)
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 2000)
    got = collocations.mine(frame(spark, rows), most=5).select(*COLUMNS)
    assert Counter(map(tuple, got.collect())) == brute(rows, most=5)


def test_sketch_keeps_rare_runs_out(spark):
    """Runs that occur once are not let through, but for few."""
    rng = random.Random(1)
    rows = [(" ".join(f"w{rng.randrange(10**9)}" for _ in range(200)), "en") for _ in range(300)] + [("as well as", "en")] * 100
    docs = frame(spark, rows).selectExpr("text", "xxhash64(lang) as seed", "lang")
    bits, seen = collocations.frequent_bits(docs, 100, 5, 700_000)
    assert seen.shape == (2, (1 << bits) // 8) and int(np.unpackbits(seen).sum()) <= 2 * 6 + 4
    got = collocations.mine(frame(spark, rows)).collect()
    assert [(r.phrase, r.a) for r in got] == [("as well as", 100)]


def test_hashes_that_meet_are_told_apart():
    """Phrases of the same first 64 bits are counted apart."""
    runs = collocations.Runs([b"one two one three", b"two"], np.zeros(2, np.uint64), True)
    held, at = collocations._Held(), np.flatnonzero(runs.room > 0)
    same = np.zeros(len(at), np.uint64)
    apart = held.add(runs, ["en", "en"], at, 1, same) + held.add(runs, ["en", "en"], at, 1, same)
    found = Counter()
    for r in held.batch(apart).to_pylist():
        found[r["phrase"]] += r["f"]
    assert found == {"one": 4, "two": 4, "three": 2}


def test_products_beyond_64_bits_are_exact(spark):
    a, n, left, right = 9_876_543_210_123, 9_000_000_000_000_000_001, 9_999_999_999_999, 98_765_432_109_876
    found = [("en", "p q", 2, a), ("en", "p", 1, left), ("en", "q", 1, right), ("en", "", 0, n)]
    r = collocations.scored(spark.createDataFrame(found, "lang string, phrase string, m int, f bigint")).first()
    assert r.score == 1000 * a * n // (left * right) and 1000 * a * n > 2**64


def test_no_rows(spark):
    assert collocations.mine(frame(spark, corpus()).limit(0)).collect() == []
