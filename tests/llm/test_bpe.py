"""Tokenizers: encoding, decoding and prefix counts against the library."""

from __future__ import annotations

import random

import pytest
from tokenizers import Tokenizer

from quillmark.llm import bpe, token_counts
from quillmark.llm.queries import BYTE_BPE, WORD_BPE, tokenizer

PARTS = [*"abcTHE \n\t'.,!?09½²éñüßÄΣσİ中文😀", "\x1c", "\x85", "́", "<|", "<|endoftext|>", "<|startoftext|>", " the", "'re", " \n", "thereupon"]


def texts():
    rng = random.Random(6)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    return [*made, "", " ", "  x", "x  ", "\n\n", "a" * 3000, "<|endoftext|>", "x <|endoftext|> y", made[0]]


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(tokenizer(BYTE_BPE))


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(tokenizer(WORD_BPE))


def test_round_trip(spark, byte_library):
    path, given = tokenizer(BYTE_BPE), [*texts(), None]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id bigint, text string").repartition(3)
    for rows in (bpe.decode(bpe.encode(df, path), path), bpe.round_trip(df, path)):
        for r in rows.collect():
            ids = byte_library.encode(given[r.doc_id] or "", add_special_tokens=False).ids
            assert r.ids == ids
            assert r.text == byte_library.decode(ids, skip_special_tokens=False)
    assert bpe.round_trip(df.limit(0), path).collect() == []


def test_counts_and_cuts(spark, word_library):
    path, given = tokenizer(WORD_BPE), [*texts(), None]
    count = lambda t: len(word_library.encode(t or "", add_special_tokens=False).ids)
    df = spark.createDataFrame(list(enumerate(given)), "doc_id bigint, text string")
    for r in token_counts.count_tokens(df, path).collect():
        assert (r.n_tokens, r.n_bytes) == (count(given[r.doc_id]), len((given[r.doc_id] or "").encode()))
        assert r.prefix_tokens[-1] == r.n_tokens
    for t in ["the quick brownish fox jumps", "thereupon, unbelievably"]:
        for budget in range(count(t) + 1):
            cut = token_counts.cut_to_budget(t, budget, path)
            fits = [t[:n] for n in range(len(t) + 1) if count(t[:n]) <= budget]
            assert count(cut) <= budget and len(cut) >= len(max(fits, key=len)) - 1


def test_cuts_are_the_longest_from_sums_at_every_word(spark, word_library, monkeypatch):
    path = tokenizer(WORD_BPE)
    count = lambda t: len(word_library.encode(t, add_special_tokens=False).ids)
    given = ["first line\nsecond, they're unbelievably\nlong; don't", "東京都は日本の首都です", "caf\u0065\u0301 İstanbul  ΣΑΣ x",
             "a !<|endoftext|>b <|endoftext|> end", "'s're 'r ''s 12 3½", "  lead and trail  "]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id int, text string")
    kept = {r.doc_id: r.prefix_tokens for r in token_counts.count_tokens(df, path).collect()}
    assert [len(kept[i]) for i in (0, 1)] == [12, 2]
    for i, t in enumerate(given):
        for budget in range(count(t) + 1):
            longest = max((t[:n] for n in range(len(t) + 1) if count(t[:n]) <= budget), key=len)
            assert token_counts.cut_to_budget(t, budget, path) == longest, (t, budget)
            assert token_counts.cut_to_budget(t, budget, path, kept[i]) == longest, (t, budget)
    # with the kept sums, nothing but the one word is looked up
    monkeypatch.setattr(token_counts.PrefixCounter, "running", None)
    monkeypatch.setattr(token_counts.PrefixCounter, "learn", None)
    assert given[0].startswith(token_counts.cut_to_budget(given[0], 6, path, kept[0]))


def test_prefix_tables(word_library):
    model = token_counts.counter(tokenizer(WORD_BPE)).model
    import numpy as np

    word = b"thereuponunbelievably"
    flat = np.frombuffer(word, np.uint8).astype(np.int64)
    last, n = model.prefix_tables(flat, np.array([0]), np.array([len(word)]))
    for j in range(1, len(word)):
        ids = model.merged(word[:j] + b"!")  # the ending mark falls on the last byte, so the prefix before is plain
        assert n[j - 1] >= 1 and last[j - 1] >= 0 and len(ids) <= n[j - 1] + 1
