"""Cross-tokenizer alignment against the libraries and a walk over token ends."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
import tokenizers

from quillmark.llm import alignment, queries

PATHS = queries.tokenizer(queries.BYTE_BPE), queries.tokenizer(queries.PIECE_BPE)
PIECES = ["a", "bc", " ", "  ", "\n", "\t", "'s", "don't", "Été", "日本", "　", "▁", "<|endoftext|>", "<s>", "1234", ".", "\r\n", "\x1c", "\xa0", "🎉", "\x00", "ﬁ"]


@pytest.fixture(scope="module")
def libraries():
    a, b = tokenizers.Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    return a, b


def walked(libraries, text):
    """n_a, n_b, n_groups, n_links, groups and linked id pairs of one text."""
    a, b = libraries
    none = 0, 0, 0, 0, "", Counter()
    if not text:
        return none
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    size_a = [len(x) for x in map(alignment.aligner(*PATHS).a.bytes.__getitem__, ids_a)]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_b) != (" " + text).encode():
        return none
    i = j = end_a = end_b = 0
    end_a, end_b, groups, links, ga, gb = size_a[0], len(bytes_b[0]), [], Counter(), [], []
    while True:
        links[ids_a[i], ids_b[j]] += 1
        to_a, to_b = end_a <= end_b, end_b <= end_a
        if to_a:
            ga.append(str(ids_a[i]))
        if to_b:
            gb.append(str(ids_b[j]))
        if to_a and to_b:
            groups.append(",".join(ga) + "|" + ",".join(gb))
            ga, gb = [], []
        if to_a and i + 1 == len(ids_a):
            break
        if to_a:
            i += 1
            end_a += size_a[i]
        if to_b:
            j += 1
            end_b += len(bytes_b[j])
    return len(ids_a), len(ids_b), len(groups), sum(links.values()), ";".join(groups), links


def expected(libraries, rows):
    found = [(i, walked(libraries, t)) for i, t in rows]
    corpus = Counter()
    for _, w in found:
        corpus.update(w[5])
    best = Counter()
    for (_, b), n in corpus.items():
        best[b] = max(best[b], n)
    out = Counter()
    for i, w in found:
        n_best = sum(n for p, n in w[5].items() if corpus[p] == best[p[1]])
        digest = hashlib.sha256(w[4].encode()).hexdigest() if w[0] else ""
        out[i, *w[:4], n_best, sum(n * corpus[p] for p, n in w[5].items()), digest] += 1
    return out


def texts():
    rng = random.Random(3)
    words = "the cat sat on a mat naïve Straße información 日本語 tokenization <unk> http://x.org/y?z=1 l'été".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100 + i, "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14)))) for i in range(300)]
    rows += [(500, None), (501, ""), (502, " "), (503, "a "), (504, "a\n  b"), (None, "no id"), (7, "the id repeats"), (7, "the id repeats")]
    return rows + [(600, "ab the cat " * 9000), (601, "x" * 30_000), (602, "語" * 3000), (603, ("line\n" * 9000)), (604, "▁")]


def columns(r):
    return r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


@pytest.mark.parametrize("most", [alignment.MOST_PAIRS, 64])
def test_query_matches_the_walk(spark, libraries, tmp_path, monkeypatch, most):
    """With few pairs in the broadcast table, the others are joined."""
    monkeypatch.setattr(alignment, "MOST_PAIRS", most)
    rows = texts()
    extra = "n_a string, pair int, links string, groups int, `a.b` int, __row int"
    spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4) for r in rows], f"doc_id bigint, text string, {extra}").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(columns(r) for r in queries.op11_cross_tokenizer_alignment(spark, str(tmp_path)).collect())
    assert got == expected(libraries, rows)


def test_parts_and_forgetting_change_nothing(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "PART", 500)
    monkeypatch.setattr(alignment, "UNITS", 300)
    monkeypatch.setattr(alignment, "LONG_UNIT", 40)
    a = alignment.Aligner(*PATHS)
    for _, text in texts()[:380]:
        row = alignment._Row()
        for part in alignment._parts(text) if text else ():
            row.add(*next(alignment._align_parts(a, [part])))
        *sums, groups, pairs, times = row.values()
        want = walked(libraries, text)
        assert (*sums, groups) == want[:5]
        assert dict(zip(map(int, pairs), map(int, times), strict=True)) == {p * a.size_b + q: n for (p, q), n in want[5].items()}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op11_cross_tokenizer_alignment(spark, str(tmp_path)).collect() == []
