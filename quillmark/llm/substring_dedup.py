"""Removal of word windows that occur earlier in the corpus, by a count-min prefilter and exact grouping.

Every window of ``size`` words has a *key*: the smallest hash among its 8-word
runs. Consecutive windows with the same occurrence of a key form a *block*.
Equal windows have equal keys, so a key's count is at least its windows' counts.

1. Each partition counts the key occurrences of its texts in a count-min sketch;
   sketches are merged page by page, and the bits of counters of two or more are
   broadcast. Their size follows the input up to ``MOST_BITS``; beyond it more
   windows pass the filter and the results stay the same.
2. Only blocks whose key is estimated as repeated are kept, with their window
   hashes. Blocks of the same key and the same windows are grouped first. Where
   all blocks of a key agree nothing is left to do; elsewhere the windows of one
   block of each kind are grouped. Groups are keyed by 128 bits of hashes and only
   their smallest document id is taken, so hot windows pre-aggregate.
3. Runs of marked windows return to the documents (broadcast if they are few), which
   add the windows that repeat within themselves and drop every covered word.

Defined cases: words are runs of anything but space and \\t..\\r; a null or empty
text has no words; texts shorter than a window keep all words. A row without an
id keeps all words and is nobody's earlier copy. Rows that share an id do not
precede each other. Other columns of the input are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.bytekernel import PLAIN_WORDS, mix, powers, window_hashes, words
from quillmark.llm.runtime import checkpoint, slices, stored

SIZE, INNER = 20, 8
#: Bits of the counter index of each of the sketch's two rows, at most; 2 * 2^29 bits are 128 MB.
LEAST_BITS, MOST_BITS = 16, 29
#: Bytes of text to a counter of a row: about six to an occurrence of a key.
BYTES_A_COUNTER = 8
PAGE = 1 << 16
#: Bytes of text that are worked on at once.
SLICE_BYTES = 2 << 20
#: Key occurrences that a task holds before it writes out what it has counted.
HELD = 1 << 20
#: Runs of marked windows that are broadcast at most: about 50 MB.
MOST_RUNS = 4_000_000

_B1, _B2, _B3 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25), np.uint64(0x165667B19E3779F9)
_PLACE = np.uint64((1 << 28) - 1)


def _sliced(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE_BYTES of its column ``text``."""
    for a, b in slices(pc.binary_length(batch.column(text)).to_pylist(), SLICE_BYTES):
        yield batch.slice(a, b - a)


def _bytes(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).to_pylist()


class Blocks:
    """Blocks of a list of texts: text, first window and number of windows of each, and its key."""

    def __init__(self, texts: list[bytes], size: int, both: bool):
        w = words(texts, PLAIN_WORDS, both)
        self.hash2, first = w.hash2, w.first
        n = len(w.hash1)
        self.start = self.count = self.text = np.empty(0, np.int64)
        self.key = np.empty(0, np.uint64)
        if n < size:
            return
        inner = min(INNER, size)
        g = window_hashes(w.hash1, inner, _B1)
        low = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
        width, span = 1, size - inner + 1
        while width * 2 <= span:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        change = np.zeros(n + 1, np.int64)
        enough = np.diff(first) >= size
        np.add.at(change, first[:-1][enough], 1)
        np.add.at(change, first[1:][enough] - size + 1, -1)
        windows = np.flatnonzero(np.cumsum(change)[: n - size + 1])
        if not len(windows):
            return
        place = low[windows] & _PLACE
        new = np.flatnonzero(np.diff(place, prepend=place[0] + np.uint64(1)))
        self.count = np.diff(new, append=len(windows))
        self.start = windows[new]
        self.text = np.searchsorted(first, self.start, "right") - 1
        self.key = g[place[new]]
        self.first = first

    def window_hash(self, size: int) -> np.ndarray:
        return window_hashes(self.hash2, size, _B2)


def _counters(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The counter of each key in both rows of the sketch."""
    one = mix(key)
    two = mix(one ^ _B3)
    shift = np.uint64(64 - bits)
    return (one >> shift).astype(np.int64), (two >> shift).astype(np.int64) + (1 << bits)


def _sketch_pages(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """(page, bits): per sketch page, the bits of counters of two or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            index, times = np.unique(np.concatenate(held), return_counts=True)
            page = index // PAGE
            begin = np.flatnonzero(np.diff(page, prepend=-1))
            code = ((index % PAGE) * 2 + (times > 1)).astype("<u4")
            at = np.append(begin, len(index))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(page[begin], pa.int32()),
                    pa.array([code[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()),
                ],
                names=["page", "counters"],
            )

        for batch in batches:
            for texts in _sliced(batch, 0):
                key = Blocks(_bytes(texts.column(0)), size, False).key
                held.extend(_counters(key, bits))
                n += len(key)
                if n >= HELD:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, total = None, None

        def done() -> pa.RecordBatch:
            packed = np.packbits(total > 1, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([packed])], names=["page", "bits"])

        for batch in batches:
            for p, counters in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != page:
                    if page is not None and (total > 1).any():
                        yield done()
                    page, total = p, np.zeros(PAGE, np.uint8)
                code = np.frombuffer(counters, "<u4")
                at = code >> 1
                total[at] = np.minimum(total[at] + 1 + (code & 1), 2)
        if page is not None and (total > 1).any():
            yield done()

    parts = docs.select("text").mapInArrow(count, "page int, counters binary")
    return parts.repartition("page").sortWithinPartitions("page").mapInArrow(merge, "page int, bits binary")


def repeated_bits(docs: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """Index bits of the merged sketch and its repeated-counter bits, at most 2 * 2^MOST_BITS of them."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, total / BYTES_A_COUNTER)))))
    out = np.zeros((2 << bits) // 8, np.uint8)
    for page, packed in _sketch_pages(docs, size, bits).toLocalIterator():
        out[page * (PAGE // 8) : (page + 1) * (PAGE // 8)] = np.frombuffer(packed, np.uint8)
    return bits, out


def _repeats_within(b: Blocks, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, window) of windows that begin earlier in the same text."""
    order = np.lexsort((b.key, b.text))
    text, key = b.text[order], b.key[order]
    same = (text[1:] == text[:-1]) & (key[1:] == key[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    some = order[twice]
    n = b.count[some]
    window = np.repeat(b.start[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    text = np.repeat(b.text[some], n)
    order = np.lexsort((window, h[window], text))
    text, window = text[order], window[order]
    again = np.flatnonzero((text[1:] == text[:-1]) & (h[window[1:]] == h[window[:-1]])) + 1
    return text[again], window[again]


def candidates(docs: DataFrame, size: int) -> DataFrame:
    """Blocks with a key estimated as repeated: (key, kind, windows, doc_id, start).

    ``windows`` holds the hashes of the block's windows, eight bytes each, and ``kind`` is a hash of them.
    """
    bits, repeated = repeated_bits(docs, size)
    shared = docs.sparkSession.sparkContext.broadcast(repeated)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            for part in _sliced(batch, 1):
                ids, b = np.asarray(part.column(0)), Blocks(_bytes(part.column(1)), size, True)
                one, two = _counters(b.key, bits)
                kept = np.flatnonzero((seen[one >> 3] >> (one & 7)) & (seen[two >> 3] >> (two & 7)) & np.uint8(1))
                if not len(kept):
                    continue
                h = b.window_hash(size)
                n, start = b.count[kept], b.start[kept]
                at = np.cumsum(n) - n
                within = np.arange(int(n.sum())) - np.repeat(at, n)
                hashes = h[np.repeat(start, n) + within]
                kind = mix(np.add.reduceat(hashes * powers(_B3, int(n.max()))[within], at) + n.astype(np.uint64))
                offset = pa.py_buffer(np.append(at, len(hashes)).astype(np.int32) * np.int32(8))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b.key[kept].view(np.int64)),
                        pa.array(kind.view(np.int64)),
                        pa.Array.from_buffers(pa.binary(), len(kept), [None, offset, pa.py_buffer(hashes.byteswap())]),
                        pa.array(ids[b.text[kept]]),
                        pa.array(start - b.first[b.text[kept]], pa.int32()),
                    ],
                    names=["key", "kind", "windows", "doc_id", "start"],
                )

    return docs.mapInArrow(find, "key bigint, kind bigint, windows binary, doc_id bigint, start int")


def marks(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, runs): runs (start, n) of n windows, from word ``start``, that occur in a document of a smaller id."""
    blocks = candidates(docs, size)
    kinds = stored(blocks.groupBy("key", "kind").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")))
    mixed = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key", F.lit(True).alias("mixed"))
    wanted = kinds.join(mixed, "key", "left").where("times > 1 or mixed").select("key", "kind", "first", "mixed")
    found = blocks.join(wanted, ["key", "kind"]).where("doc_id > first or (doc_id = first and mixed)")
    n = F.expr("cast(octet_length(windows) div 8 as int)")
    copy = F.col("doc_id") > F.col("first")
    found = stored(found.select("key", F.when(~copy, F.col("windows")).alias("windows"), "doc_id", "start", n.alias("n")))
    copies = found.where("windows is null").select("doc_id", "start", "n")
    # one block of each kind stands for its windows, where the blocks of a key differ
    own = found.where("windows is not null").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    hashed = F.expr("cast(conv(hex(substring(windows, 8 * i + 1, 8)), 16, -10) as bigint)").alias("hash")
    each = own.select("key", hashed, "doc_id", (F.col("start") + F.col("i")).alias("start"))
    earliest = each.groupBy("key", "hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    windows = each.join(earliest.where("first < last").drop("last"), ["key", "hash"]).where("doc_id > first")
    runs = copies.union(windows.select("doc_id", "start", F.lit(1).alias("n")))
    return runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs")).mapInArrow(
        _merge_runs, "doc_id bigint, runs array<struct<start int, n int>>"
    )


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjoining and overlapping runs become one."""
    for batch in batches:
        out = []
        for runs in batch.column(1):
            start = np.asarray(runs.values.field("start"), np.int64)
            order = np.argsort(start, kind="stable")
            start = start[order]
            end = np.maximum.accumulate(start + np.asarray(runs.values.field("n"))[order])
            new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
            last = end[np.append(new[1:] - 1, len(end) - 1)]
            out.append([{"start": int(a), "n": int(b - a)} for a, b in zip(start[new], last, strict=True)])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "runs"])


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of ``docs`` (doc_id, text).

    ``kept`` joins with single spaces the words that no window covers whose words also start earlier.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    runs = checkpoint(marks(rows.where("doc_id is not null"), size))
    if (runs.agg(F.sum(F.size("runs") + 2)).first()[0] or 0) <= MOST_RUNS:
        runs = F.broadcast(runs)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _sliced(batch, 1):
                total, gone, kept = [], [], []
                texts = _bytes(part.column(1))
                b = Blocks(texts, size, True)
                text, window = _repeats_within(b, b.window_hash(size)) if len(b.key) else (b.text, b.start)
                order = np.argsort(text, kind="stable")
                text, window = text[order], window[order]
                for d in range(len(texts)):
                    found = texts[d].split()
                    lo, hi = np.searchsorted(text, [d, d + 1])
                    start = window[lo:hi] - b.first[d] if hi > lo else np.empty(0, np.int64)
                    end = start + size
                    runs = part.column(2)[d]
                    if runs.is_valid:
                        own = np.asarray(runs.values.field("start"), np.int64)
                        start = np.append(start, own)
                        end = np.append(end, own + np.asarray(runs.values.field("n")) + size - 1)
                    left = found
                    if len(start):
                        cover = np.zeros(len(found) + 1, np.int64)
                        np.add.at(cover, start, 1)
                        np.add.at(cover, end, -1)
                        left = [w for w, c in zip(found, np.cumsum(cover)[:-1].tolist(), strict=True) if not c]
                    total.append(len(found))
                    gone.append(len(found) - len(left))
                    kept.append(b" ".join(left))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    return rows.join(runs, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(drop, schema)
