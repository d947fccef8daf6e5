"""Windows of words: the operator against a dictionary of all windows."""

from __future__ import annotations

import random
import re

import pytest

from quillmark.llm.substring_dedup import remove_repeats


def brute(rows, size):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k : k + size]), (i, k))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (i, k):
                gone.update(range(k, k + size))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("size", [20, 3])
def test_matches_brute_force(spark, size):
    rng = random.Random(size)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    rows = []
    for i in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            a = rng.randint(0, 30)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + rng.randint(15, 40)]
        if i % 10 == 0:
            w += ["same"] * rng.randint(15, 60)
        rows.append((i * 3 - 5, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(1001, rows[3][1]), (1002, rows[3][1]), (1003, ""), (1004, None), (1005, " \n"), (1006, "x" * 5000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(df, size).collect()}
    assert got == brute(rows, size)


def test_empty_null_ids_and_clashing_columns(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(None, text, 1), (5, text, 2), (6, text, 3), (5, text, 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in remove_repeats(df).collect())
    assert got == [(-1, 0), (5, 0), (5, 0), (6, 30)]
    assert remove_repeats(df.limit(0)).collect() == []
