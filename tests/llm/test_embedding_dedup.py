"""Vector links: the operator against all pairs."""

from __future__ import annotations

import numpy as np

from quillmark.llm import embedding_dedup
from quillmark.llm.embedding_dedup import near_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def expected(rows, cosine=0.98):
    out = {i: [0, i] for i, _, _ in rows}
    good = [
        (i, np.array(v, float), l) for i, v, l in rows
        if v and l is not None and None not in v and np.isfinite(v).all() and np.any(v)
    ]
    for _ in range(len(rows)):
        moved = False
        for x, (i, v, l) in enumerate(good):
            n = 0
            for y, (j, w, m) in enumerate(good):
                if x != y and l == m and len(v) == len(w):
                    if v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= cosine - 1e-12:
                        n += 1
                        if out[j][1] < out[i][1]:
                            out[i][1], moved = out[j][1], True
            out[i][0] = n
        if not moved:
            break
    return {i: tuple(v) for i, v in out.items()}


def test_links_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        centre = rng.normal(size=64)
        for _ in range(int(rng.integers(1, 30))):
            v = centre + rng.normal(size=64) * rng.choice([0.08, 0.12, 0.16])
            rows.append((len(rows), v.astype(np.float32).tolist(), int(c % 3)))
    rows += [(1000 + k, rows[5][1], rows[5][2]) for k in range(40)]
    rows += [(2000, rows[5][1], None), (2001, None, 1), (2002, [0.0] * 64, 1), (2003, [float("nan")] + [1.0] * 63, 1)]
    rows += [(2004, [None, 1.0], 1), (2005, [], 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [1e30] * 64, 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == expected(rows)


def test_empty_null_and_repeated_rows(spark):
    v = [1.0, 0.0, 0.5]
    df = spark.createDataFrame([(1, v, 1, 7), (1, v, 1, 7), (None, v, 1, 8)], SCHEMA + ", n_links int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect())
    assert got == [(0, 0, None, True), (1, 1, 1, True), (1, 1, 1, True)]
    assert near_vectors(df.limit(0)).collect() == []


def test_double_vectors(spark):
    """Numbers that single precision would not tell apart, and ones beyond its range."""
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, [x * 1e200 for x in v], 1), (3, [1.0, 2.0, -3.0], 1), (4, [x + 1e-12 for x in v], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1)}


def test_recall_of_buckets():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * y
    a, b = embedding_dedup.buckets(x), embedding_dedup.buckets(y)
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() > 0.999
