"""Toxicity: windows, gradients against differences, held-out accuracy, defined cases."""

from __future__ import annotations

import random

import numpy as np

from quillmark.llm import toxicity
from quillmark.llm.toxicity import Network, fit, score

BAD = ["zorgblat", "quimfle", "Vexnarg"]


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "ka lo mi nu pe ra so ti".split() for b in "bel dor fin gam hil jun".split()]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 300))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(BAD) + rng.choice(["", "s", "ed"])
        docs.append((i, " ".join(w)))
        labels.append((i, toxic))
    return docs, labels


def test_windows_cover_every_word():
    for n in [0, 1, 31, 32, 33, 47, 48, 49, 200]:
        begins = toxicity.windows(n)
        covered = {w for b in begins for w in range(b, min(n, b + toxicity.LENGTH))}
        assert covered == set(range(n))
        assert (np.diff(begins) <= toxicity.STRIDE).all()


def test_held_out_accuracy_and_defined_cases(spark):
    docs, labels = corpus(400, 1)
    extra = [(1000, None), (1001, ""), (1002, " .,"), (1003, docs[3][1]), (1004, docs[3][1])]
    df = spark.createDataFrame(docs + extra, "doc_id bigint, text string")
    known = spark.createDataFrame([x for x in labels if x[0] % 4] + [(None, 1), (7777, None)], "doc_id bigint, toxic int")
    model = fit(df, known)
    got = {r.doc_id: r.score for r in score(df, model).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, y in labels if i % 4 == 0]
    assert sum(right) / len(right) > 0.9
    assert got[1000] == got[1001] == got[1002] == model.prior
    assert got[1003] == got[1004] == got[3]
    assert all(0 <= s <= 1 for s in got.values())
    kept = {r.doc_id for r in toxicity.drop_toxic(df, model).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5}
    assert score(df.limit(0), model).collect() == []


def test_long_words_are_trained_on_whole(spark):
    text = "東京都は日本の首都です" * 9 + "zorgblat" + "é" * 150
    t, whole = toxicity.read([text.encode()]), text.encode()
    assert len(t.word) > 1 and all(any(whole[i : i + 8] in p for p in toxicity.parts(whole)) for i in range(len(whole) - 7))
    none = (np.zeros(1 << toxicity.WORD_BITS, np.float32), np.zeros(1 << toxicity.RUN_BITS, np.float32))
    rows = spark.createDataFrame([(text, 1), ("a b", 0)], "text string, toxic int")
    sent = [w for w, y in toxicity._training_windows(rows, (none, none)) if y]
    assert any(b"zorgblat" in w for w in sent) and "é".encode() in sent[0]
    assert all(p.decode() and len(p) <= toxicity.LONG_WORD for w in sent for p in w.split())
    again = toxicity.read(sent)
    assert set(again.run.tolist()) == set(t.run.tolist()) and set(again.bucket.tolist()) == set(t.bucket.tolist())


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert score(df, fit(df, none)).collect()[0].score == 0.0


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = Network(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items() if k not in ("word", "run")}
    x = rng.normal(size=(6, 3, 3 + 2 * toxicity.EMBED))
    mask = np.arange(6)[:, None] < np.array([6, 4, 1])
    label = np.array([1.0, 0.0, 1.0])

    def loss():
        ahead, back = net.gates(x)
        z = net.forward(ahead, back, mask)[0]
        return float((np.log1p(np.exp(z)) - label * z).sum())

    ahead, back = net.gates(x)
    z, state = net.forward(ahead, back, mask, True)
    g, d0, d1 = net.gradients(toxicity.sigmoid(z) - label, mask, state)
    g |= {"w0": np.einsum("tbi,tbj->ij", x, d0), "b1": d1.sum(axis=(0, 1))}
    for k, d in g.items():
        at = tuple(rng.integers(0, n) for n in net.p[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-5
        up = loss()
        net.p[k][at] = old - 1e-5
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-5 - d[at]) < 1e-4 * max(1, abs(d[at])), k
