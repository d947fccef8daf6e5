"""Byte-level BPE encoding and decoding of whole texts.

Texts are cut into pre-tokens (contractions, letter runs, number runs, other
runs, white space); distinct pre-tokens are encoded together: longest matches
propose tokens, an array check tests every adjacent pair, and only words with an
incompatible pair are merged one by one. Each worker remembers pieces that it
has met, up to ``PIECES``, so that a text costs a lookup a word.

Defined cases: a null text is an empty one; an empty text has no tokens; rows
and texts that repeat are encoded alike; the text of a special token becomes
that token; other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.bpe_model import MergeModel
from quillmark.llm.runtime import held, lean, slices

#: Pieces that a worker remembers before it forgets those met once.
PIECES = 200_000
#: Bytes of text encoded at once.
SLICE_BYTES = 1 << 20

# The pre-token pattern of this vocabulary, with white space spelled out.
SPACES = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+"
    rf"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)


class _Known(dict):
    """Index of each piece; a new one is queued. Index 0 is for pieces that can't be cut from their surroundings."""

    def __init__(self, owner: Encoder, prefix: str):
        self.owner, self.prefix = owner, prefix

    def __missing__(self, piece: str) -> int:
        if self.prefix and (not piece or piece[0].isspace() or piece[-1].isspace()):
            self[piece] = 0
            return 0
        i = self[piece] = self.owner.queue(self.prefix + piece)
        return i


class Encoder:
    """Encodes batches of texts and remembers pieces between them."""

    def __init__(self, path: str):
        self.model = MergeModel(path)
        special = sorted(self.model.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.forget()

    def forget(self) -> None:
        self.after_space, self.plain = _Known(self, " "), _Known(self, "")
        self.waiting: list[str] = []
        self.known = 1
        self.start = np.zeros(1, np.int64)
        self.count = np.zeros(1, np.int64)
        self.used = np.zeros(1, np.int64)
        self.flat = np.empty(0, np.int32)

    def queue(self, text: str) -> int:
        self.waiting.append(text)
        self.known += 1
        return self.known - 1

    def _learn(self) -> None:
        """Encode the queued pieces."""
        if not self.waiting:
            return
        index: dict[str, int] = {}
        parts, size = [], []
        for piece in self.waiting:
            if piece in self.model.specials:
                found = [piece]
            else:
                found = PRE_TOKEN.findall(piece)
            size.append(len(found))
            parts.extend([index.setdefault(x, len(index)) for x in found])
        self.waiting = []
        count, token, _ = self.model.encode_words([x.encode() for x in index])
        special = [(i, self.model.specials[x]) for x, i in index.items() if x in self.model.specials]
        first = np.cumsum(count) - count
        part = np.array(parts, np.int64)
        if special:
            extra = np.array([t for _, t in special], np.int64)
            rows = np.array([i for i, _ in special])
            first[rows], count[rows] = len(token) + np.arange(len(rows)), 1
            token = np.concatenate([token, extra])
        size = np.array(size, np.int64)
        of_piece = np.repeat(np.arange(len(size)), size)
        n = np.bincount(of_piece, weights=count[part], minlength=len(size)).astype(np.int64)
        begin = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate([self.flat, ragged(first[part], count[part], token).astype(np.int32)])
        self.start = np.concatenate([self.start, begin])
        self.count = np.concatenate([self.count, n])
        self.used = np.concatenate([self.used, np.zeros(len(n), np.int64)])

    def _trim(self) -> None:
        if self.known <= PIECES:
            return
        kept = self.used >= 2
        kept[0] = True
        if kept.sum() > PIECES // 2:
            self.forget()
            return
        new = np.cumsum(kept) - 1
        for known in (self.after_space, self.plain):
            old = list(known.items())
            known.clear()
            known.update((p, int(new[i])) for p, i in old if kept[i])
        self.flat = ragged(self.start[kept], self.count[kept], self.flat)
        self.count = self.count[kept]
        self.start = np.cumsum(self.count) - self.count
        self.used = np.zeros(len(self.count), np.int64)
        self.known = len(self.count)

    def _pieces(self, text: str) -> list[int]:
        found = []
        for part in self.special.split(text) if self.special else [text]:
            if not part:
                continue
            if part in self.model.specials:
                found.append(self.plain[part])
                continue
            pieces = part.split(" ")
            ids = [self.plain[pieces[0]]] if pieces[0] else [0] if len(pieces) > 1 else []
            if pieces[0] and pieces[0][-1].isspace():
                ids = [0]
            ids.extend(map(self.after_space.__getitem__, pieces[1:]))
            if 0 in ids:
                ids = list(map(self.plain.__getitem__, PRE_TOKEN.findall(part)))
            found.extend(ids)
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids (int32) of each text."""
        pieces, n = [], []
        for text in texts:
            found = self._pieces(text)
            pieces.extend(found)
            n.append(len(found))
        self._learn()
        piece = np.array(pieces, np.int64)
        self.used += np.bincount(piece, minlength=len(self.used))
        ids = ragged(self.start[piece], self.count[piece], self.flat)
        ends = np.concatenate([[0], np.cumsum(self.count[piece])])[np.cumsum(n)]
        self._trim()
        return np.split(ids, ends[:-1]) if texts else []


def ragged(start: np.ndarray, count: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + count[i]] of all i, joined."""
    shift = start - (np.cumsum(count) - count)
    return values[np.repeat(shift, count) + np.arange(int(count.sum()))]


@held
@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@held
@lru_cache(2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text = encoder(path).model.bytes
    size = np.fromiter(map(len, text), np.int64, len(text))
    return np.cumsum(size) - size, size, np.frombuffer(b"".join(text), np.uint8)


def decode_ids(ids: np.ndarray, path: str) -> str:
    start, size, flat = _token_bytes(path)
    return ragged(start[ids], size[ids], flat).tobytes().decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row; ``path`` is a byte-level BPE tokenizer file that workers can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(pc.binary_length(texts).to_pylist(), SLICE_BYTES):
                ids = encoder(path).encode(texts.slice(a, b - a).to_pylist())
                at = np.cumsum([0] + [len(x) for x in ids])
                column = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), column], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    return rows.mapInArrow(lean(run, keep=True), f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, text): the text that the token ids of each row stand for; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = [x or 0 for x in lists.value_lengths().to_pylist()]
            for a, b in slices(sizes, SLICE_BYTES):
                part = lists.slice(a, b - a)
                flat = np.asarray(part.flatten())
                at = np.cumsum([0, *sizes[a:b]])
                texts = [decode_ids(flat[at[i] : at[i + 1]], path) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), part, pa.array(texts, pa.string())],
                    names=[id_col, "ids", "text"],
                )

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(lean(run, keep=True), f"`{id_col}` {kind}, ids array<int>, text string")


def round_trip(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False
) -> DataFrame:
    """(id, n_tokens, ids, text): token ids and their decoded text.

    ``ids`` is an array, or if ``packed`` the ids as little-endian unsigned 32-bit integers.

    Encoding and decoding share a worker process, so that an executor holds one vocabulary a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for a, b in slices(pc.binary_length(column).to_pylist(), SLICE_BYTES):
                ids = encoder(path).encode(column.slice(a, b - a).to_pylist())
                n = [len(x) for x in ids]
                if packed:
                    found = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
                else:
                    flat = pa.array(np.concatenate(ids), pa.int32())
                    found = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n, pa.int64()),
                        found,
                        pa.array([decode_ids(x, path) for x in ids], pa.string()),
                    ],
                    names=[id_col, "n_tokens", "ids", "text"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    ids_kind = "binary" if packed else "array<int>"
    return rows.mapInArrow(lean(run, keep=True), f"`{id_col}` {kind}, n_tokens bigint, ids {ids_kind}, text string")
