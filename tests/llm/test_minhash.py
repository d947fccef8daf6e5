"""Near duplicates: the operator against all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from quillmark.llm import minhash
from quillmark.llm.minhash import near_duplicates


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"wört{i}" for i in range(400)]
    rows, base = [], []
    for i in range(n):
        if base and rng.random() < 0.6:
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = [x.upper() + "," for x in w]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 80, 200, 400]))]
        base.append(w)
        rows.append((i * 2 + 1, " ".join(w)))
    return rows


def expected(rows):
    rows = [(i, t) for i, t in rows if i is not None and t is not None]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, s) in enumerate(rows):
        for j, t in rows[:x]:
            if similarity(s, t) >= 0.8 or not (shingles(s) or shingles(t)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def test_components_match_all_pairs(spark):
    rows = corpus(7, 150) + [(5000, ""), (5001, " .!"), (5002, None), (5003, "one two"), (5004, "One, two")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    truth = expected(rows)
    assert {i: got[i].component_id for i in truth} == truth
    assert got[5002].component_id == 5002 and got[5002].kept
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_empty_repeated_and_null_rows(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (None, "a b c d e f", 2), (2, "A b c. d e f", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component int")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_agreement_follows_weighted_similarity():
    rng = np.random.default_rng(3)
    n = 60
    a = rng.integers(1, 9, n).astype(float)
    b = np.where(rng.random(n) < 0.4, rng.integers(1, 9, n), a).astype(float)
    element = rng.integers(0, 1 << 62, n).astype(np.uint64)
    agree = []
    for shift in range(40):
        e = element + np.uint64(shift)
        s = minhash.signatures(2, np.repeat([0, 1], n), np.append(e, e), np.append(a, b))
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02


def test_similarities_below_the_bands_are_refused(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    for similarity in (0.6, 0.0, float("nan")):
        with pytest.raises(ValueError):
            near_duplicates(df, similarity)
    assert [r.kept for r in near_duplicates(df, 0.9).collect()] == [True]
