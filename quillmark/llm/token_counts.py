"""Exact token counts at every prefix of a text, for a lower-casing BPE with word ends.

For each word a table over its prefixes holds the last token and the count of
the prefix's encoding. The encoding of a prefix is the encoding of a shorter
prefix and one more token that is compatible with the shorter one's last token;
exactly one shorter prefix and token fit. The same step with tokens that carry
the word-end mark gives the count of the prefix taken as a whole word. Running
sums at every word, which are kept, then answer how many tokens any prefix of the
text has, and where it must be cut to fit a budget, from these sums and the table
of the one word that is cut. Only where folding changes the number of characters
of a piece between spaces (or composes some) are that piece's prefixes counted anew.

Defined cases: a null text is an empty one with no tokens; repeated rows count
alike; the text of a special token counts as one token; other columns of the
input are left out. White space never belongs to a token.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.bpe import SPACES
from quillmark.llm.bpe_model import MergeModel
from quillmark.llm.runtime import slices

#: Pieces that a worker remembers; bytes of text, and of distinct words, that are counted at once.
PIECES, SLICE_BYTES, WORD_BYTES = 400_000, 8 << 20, 1 << 19

# The word pattern of this vocabulary, with white space spelled out.
SIGNS = regex.compile(rf"[^{SPACES}\p{{L}}\p{{N}}]*\Z")
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")


def folded(text: str) -> str:
    """NFC, then each character lower-cased by itself."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()


class PrefixCounter:
    """Prefix tables of words, and counts of texts. Remembers the counts of pieces between texts."""

    def __init__(self, path: str):
        self.model = MergeModel(path)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.model.specials)) + ")")
        self.often: dict[str, tuple[int, ...]] = {}
        self.once: dict[str, tuple[int, ...]] = {}

    def words(self, words: list[bytes]) -> np.ndarray:
        """Token count of each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        end = np.cumsum(size)
        return self.model.whole_words(flat, end - size, end)

    def learn(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Token counts of the words of distinct pieces of text between spaces."""
        index: dict[str, int] = {}
        part, size = [], []
        for piece in pieces:
            found = WORD.findall(folded(piece))
            part.extend([index.setdefault(w, len(index)) for w in found])
            size.append(len(found))
        encoded = [w.encode() for w in index]
        count = np.concatenate([self.words(encoded[a:b]) for a, b in slices([len(w) for w in encoded], WORD_BYTES)] or [[]])
        of_word = count[part].astype(np.int64).tolist() if part else []
        ends = np.cumsum(np.array(size, np.int64)).tolist()
        return [tuple(of_word[end - n : end]) for n, end in zip(size, ends, strict=True)]

    def pieces(self, text: str) -> list[str]:
        if "<|" not in text:
            return text.split(" ")
        found: list[str] = []
        for part in self.special.split(text):
            found.extend([part] if part in self.model.specials else part.split(" "))
        return found

    def known(self, texts: list[str]) -> list[list[tuple[int, ...]]]:
        """For each text, the token counts of the words of each of its pieces."""
        pieces = [self.pieces(t) for t in texts]
        new: dict[str, tuple[int, ...] | None] = dict.fromkeys(
            p for found in pieces for p in found if p not in self.often and p not in self.once
        )
        plain = [p for p in new if p not in self.model.specials]
        new.update(zip(plain, self.learn(plain), strict=True))
        new.update((p, (1,)) for p in new if p in self.model.specials)
        often, once, out = self.often, self.once, []
        for found in pieces:
            known = list(map(often.get, found))
            if None in known:
                for i, p in enumerate(found):
                    if known[i] is None:
                        n = once.pop(p, None)
                        if n is None:
                            n = new[p] if p in new else often[p]
                            if p not in often:
                                once[p] = n
                        else:
                            often[p] = n
                        known[i] = n
            out.append(known)
        if len(once) > PIECES // 2:
            once.clear()
        if len(often) > PIECES // 2:
            often.clear()
        return out

    def running(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the token count before its first word and after each of its words."""
        return [np.cumsum(np.fromiter(chain((0,), chain.from_iterable(k)), np.int64)) for k in self.known(texts)]

    def count(self, text: str) -> int:
        return int(self.running([text])[0][-1])

    def cut(self, piece: str, ix: int, budget: int) -> int:
        """Characters of ``piece`` that fit: all before its word number ``ix`` does, and ``budget`` tokens of that word."""
        low = folded(piece)
        if len(low) != len(piece) or not unicodedata.is_normalized("NFC", piece):
            sums = [sum(x) for x in self.learn([piece[:n] for n in range(1, len(piece) + 1)])]
            budget += sum(self.learn([piece])[0][:ix])
            return max((n for n, count in enumerate(sums, 1) if count <= budget), default=0)
        start, end = next(islice(WORD.finditer(low), ix, None)).span()
        word = low[start:end]
        if word[0] == "'" and word[-1].isalpha():  # a part of a contraction is a quote and a word
            counts = [sum(x) for x in self.learn([word[:n] for n in range(1, len(word))])]
        else:
            counts = self.model.end_counts(word.encode())[np.cumsum([len(c.encode()) for c in word]) - 1][:-1].tolist()
        return start + max((n for n, count in enumerate(counts, 1) if count <= budget), default=0)


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, prefix_tokens) for every row.

    ``prefix_tokens`` holds the exact count before the first word and after every
    word, so that any budget question on a text needs one binary search and the
    prefix table of one word (see ``cut_to_budget``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            size, total, prefix = [len(t.encode()) for t in texts], [], []
            for a, b in slices(size, SLICE_BYTES):
                for after in counter(path).running(texts[a:b]):
                    total.append(int(after[-1]))
                    prefix.append(after)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))],
                names=[id_col, "n_bytes", "n_tokens", "prefix_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, prefix_tokens array<bigint>")


def cut_to_budget(text: str, budget: int, path: str, prefix_tokens: Sequence[int] | None = None) -> str:
    """The longest prefix of the text, cut after a character, that has at most ``budget`` tokens.

    ``prefix_tokens`` are the text's sums, if they were kept; nothing before the word that is cut is encoded then.
    """
    c = counter(path)
    after = c.running([text])[0] if prefix_tokens is None else np.asarray(prefix_tokens)
    if after[-1] <= budget:
        return text
    first = int(np.searchsorted(after, budget, "right")) - 1  # words that fit
    at = words = 0
    before = ""
    for piece in c.pieces(text):
        at = text.index(piece, at)
        special = piece in c.model.specials
        n = 1 if special else sum(1 for _ in WORD.finditer(folded(piece)))
        if words + n > first:
            break
        at, words, before = at + len(piece), words + n, piece
    left = budget - int(after[first])
    if not special:
        return text[: at + c.cut(piece, first - words, left)]
    # part of a special is no special, and may go on from the signs before it
    signs = SIGNS.search(folded(before))[0] if text.endswith(before, 0, at) else ""
    counts = [sum(x) for x in c.learn([signs, *(signs + piece[:n] for n in range(1, len(piece)))])]
    return text[: at + max((n for n, count in enumerate(counts) if count - counts[0] <= left), default=0)]
