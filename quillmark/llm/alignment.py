"""Alignment of two tokenizers over the bytes of a text, and how often their tokens meet in the corpus.

A is a byte-level BPE tokenizer, B a sentencepiece one; both see a space and the text, without special tokens. Every byte
has a label: no token ends there, one of A, one of B, or one of each. A regular expression cuts the labels into spans up
to each byte of the last kind; the labels of a span tell how many tokens of A and of B its group has. A token of A and
one of B are *linked* if their bytes overlap; as at each labelled byte one of the two changes, there is one link for
each labelled byte.

A space after a character that is no white space begins a token in both. Texts are cut there into units; each worker
aligns the units that it has not met in one label string, and remembers up to ``UNITS``. Whole texts are made of their units,
in parts of ``PART`` characters.

Counts of linked pairs are summed over the corpus. Pairs with more than 1 / MOST_PAIRS of all links, and so fewer than
MOST_PAIRS of them, are looked up in a broadcast table; others meet their count in a join, in which none of them can be
hot.

Defined cases: null and empty texts, and texts that either tokenizer does not give back byte for byte (such as those with
U+2581), have no tokens: zeros and ''. Each row is aligned by itself, so ids may be null or repeat; without rows there
are no pairs. Columns other than the id are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.bpe import PRE_TOKEN, ragged
from quillmark.llm.bpe_model import MergeModel
from quillmark.llm.runtime import stored

#: Units that a worker remembers before it begins anew.
UNITS = 200_000
#: Characters of text that are aligned at once; longer texts are cut where a unit begins.
PART = 1 << 20
#: Characters of a unit above which B encodes it line by line.
LONG_UNIT = 1 << 14
#: The broadcast table has fewer pairs than this: 17 MB.
MOST_PAIRS = 1 << 20

UNIT_START = re.compile(r"(?<=\S) ")
LINE_START = re.compile(r"(?=\n)")
#: Labels: none, end of a token of A, of B, of both.
LABELS = np.frombuffer(b"nabx", np.uint8)
GROUP = re.compile(rb"[nab]*x")
SEPARATORS = ",|;"


class _Units(dict):
    """Index of each unit; a new one is queued. Index 0 tells that a piece between two spaces need not be a unit."""

    def __init__(self, owner: Aligner, any_text: bool):
        self.owner, self.any_text = owner, any_text

    def __missing__(self, piece: str) -> int:
        if not self.any_text and (not piece or piece[-1].isspace()):
            self[piece] = 0
            return 0
        i = self[piece] = self.owner.queue(piece)
        return i


def _text_bytes(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and joined bytes of tokens by id."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.cumsum(size) - size, size, np.frombuffer(b"".join(tokens), np.uint8)


def _piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:-1], 16)]) if is_byte else piece.replace("▁", " ").encode()


class Aligner:
    """Units of texts with their tokens, groups and links."""

    def __init__(self, path_a: str, path_b: str):
        self.a = MergeModel(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁|\n", p) for p in pieces):
            raise ValueError("the pieces of B must not reach over the start of a word or a line")
        self.space = self.b.piece_to_id("▁")
        self.bytes_a = _text_bytes(self.a.bytes)
        self.bytes_b = _text_bytes([_piece_bytes(p, self.b.is_byte(i)) for i, p in enumerate(pieces)])
        self.size_b = len(pieces)
        most = max(len(self.bytes_a[1]), self.size_b)
        #: decimal ids with each separator: id * 3 + separator
        self.shown = _text_bytes([f"{i}{s}".encode() for i in range(most) for s in SEPARATORS])
        self.forget()

    def forget(self) -> None:
        self.between, self.any = _Units(self, False), _Units(self, True)
        self.waiting: list[str] = []
        self.known = 1
        self.groups: list[bytes] = [b""]
        #: by unit: tokens of A, of B, groups, links, and whether the tokens give the text back
        self.sums = np.zeros((1, 5), np.int64)
        self.sums[0, 4] = 1
        self.start = np.zeros(1, np.int64)
        self.used = np.zeros(1, np.int64)
        self.pairs = np.empty(0, np.int64)

    def queue(self, piece: str) -> int:
        self.waiting.append(piece)
        self.known += 1
        return self.known - 1

    def units(self, part: str) -> list[int]:
        """Units of a part of a text, which follows a space."""
        found = list(map(self.between.__getitem__, part.split(" ")))
        return list(map(self.any.__getitem__, UNIT_START.split(part))) if 0 in found else found

    def _encode_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of A of a space and each unit, joined, and how many each unit has."""
        index: dict[str, int] = {}
        words, size = [], []
        for unit in units:
            found = [" " + unit] if unit.isalpha() else PRE_TOKEN.findall(" " + unit)
            size.append(len(found))
            words += [index.setdefault(w, len(index)) for w in found]
        count, token, _ = self.a.encode_words([w.encode() for w in index])
        word, first = np.array(words), np.cumsum(size) - size
        return ragged((np.cumsum(count) - count)[word], count[word], token), np.add.reduceat(count[word], first)

    def _encode_b(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of B of a space and each unit, joined, and how many each unit has."""
        out = self.b.encode([u if len(u) <= LONG_UNIT else "" for u in units], num_threads=1)
        for i, unit in enumerate(units):
            if not unit:
                out[i] = [self.space]
            elif len(unit) > LONG_UNIT:
                lines = LINE_START.split(unit)
                # each call puts a space before its line; of those after the first it goes again
                out[i] = self.b.encode(lines[0]) if lines[0] else [self.space]
                for line in lines[1:]:
                    out[i] += self.b.encode(line)[1:]
        n = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.int64, int(n.sum())), n

    def learn(self) -> None:
        """Align the queued units: label every byte, scan the labels, keep groups and links by unit."""
        if not self.waiting:
            return
        units, self.waiting = self.waiting, []
        (flat_a, n_a), (flat_b, n_b) = self._encode_a(units), self._encode_b(units)
        text = [b" " + u.encode() for u in units]
        size = np.fromiter(map(len, text), np.int64, len(text))
        same = np.ones(len(units), bool)
        for flat, n, known in ((flat_a, n_a, self.bytes_a), (flat_b, n_b, self.bytes_b)):
            same &= _gives_back(text, size, flat, n, known)
        sums = np.zeros((len(units), 5), np.int64)
        sums[:, 4] = same
        groups, pairs = [b""] * len(units), []
        if same.any():
            flat_a, flat_b = flat_a[np.repeat(same, n_a)], flat_b[np.repeat(same, n_b)]
            sums[same, :4], strings, pairs = self._aligned(size[same], flat_a, flat_b)
            groups = strings if same.all() else groups
            if not same.all():
                for i, s in zip(np.flatnonzero(same).tolist(), strings, strict=True):
                    groups[i] = s
        self.start = np.concatenate([self.start, len(self.pairs) + np.cumsum(sums[:, 3]) - sums[:, 3]])
        self.pairs = np.concatenate([self.pairs, np.asarray(pairs, np.int64)])
        self.sums = np.concatenate([self.sums, sums])
        self.used = np.append(self.used, np.zeros(len(units), np.int64))
        self.groups += groups

    def trim(self, used: np.ndarray) -> None:
        """Note the units that a batch has used, and if there are too many, keep those that two batches have."""
        self.used += np.bincount(used, minlength=len(self.used)) > 0
        if self.known <= UNITS:
            return
        kept = self.used >= 2
        kept[0] = True
        if kept.sum() > UNITS // 2:
            self.forget()
            return
        new = np.cumsum(kept) - 1
        for known in (self.between, self.any):
            old = list(known.items())
            known.clear()
            known.update((u, int(new[i])) for u, i in old if kept[i])
        self.pairs = ragged(self.start[kept], self.sums[kept, 3], self.pairs)
        self.sums = self.sums[kept]
        self.start = np.cumsum(self.sums[:, 3]) - self.sums[:, 3]
        self.groups = [self.groups[i] for i in np.flatnonzero(kept).tolist()]
        self.used = np.zeros(len(self.sums), np.int64)
        self.known = len(self.sums)

    def _aligned(self, size: np.ndarray, flat_a: np.ndarray, flat_b: np.ndarray):
        """Sums, group strings and linked pairs of units of ``size`` bytes, from their joined tokens."""
        unit_end = np.cumsum(size)
        mark = np.zeros(unit_end[-1], np.uint8)
        mark[np.cumsum(self.bytes_a[1][flat_a]) - 1] |= 1
        mark[np.cumsum(self.bytes_b[1][flat_b]) - 1] |= 2
        labels = LABELS[mark].tobytes()
        end = np.fromiter((m.end() for m in GROUP.finditer(labels)), np.int64)
        ends_a, ends_b = np.cumsum(mark & 1, dtype=np.int64), np.cumsum(mark >> 1, dtype=np.int64)
        upto_a, upto_b = ends_a[end - 1], ends_b[end - 1]
        n_a, n_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        # groups as text: tokens of A, then of B, of each group, with the sign that follows each
        group = np.arange(len(end))
        shown = np.empty(len(flat_a) + len(flat_b), np.int64)
        sign_a, sign_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
        sign_a[upto_a - 1], sign_b[upto_b - 1] = 1, 2
        shown[np.arange(len(flat_a)) + np.repeat((upto_b - n_b)[group], n_a)] = flat_a * 3 + sign_a
        shown[np.arange(len(flat_b)) + np.repeat(upto_a[group], n_b)] = flat_b * 3 + sign_b
        start, size, flat = self.shown
        joined = ragged(start[shown], size[shown], flat).tobytes()
        groups = np.searchsorted(end, unit_end, "right")
        cut = np.cumsum(size[shown])[upto_a[groups - 1] + upto_b[groups - 1] - 1].tolist()
        strings = [joined[a:b] for a, b in zip([0, *cut], cut)]
        # a link for each labelled byte, of the tokens that it belongs to
        at = np.flatnonzero(mark)
        token_a = flat_a[ends_a[at] - (mark[at] & 1)]
        token_b = flat_b[ends_b[at] - (mark[at] >> 1)]
        sums = np.stack([ends_a[unit_end - 1], ends_b[unit_end - 1], groups, np.searchsorted(at, unit_end)], 1)
        return np.diff(sums, axis=0, prepend=0), strings, token_a * self.size_b + token_b


def _gives_back(text: list[bytes], size: np.ndarray, flat: np.ndarray, n: np.ndarray, known) -> np.ndarray:
    """Whether the tokens of each text, of ``n`` of the joined ``flat``, have just the text's bytes."""
    start, length, data = known
    found = np.add.reduceat(length[flat], np.cumsum(n) - n)
    same = (found == size) & (n > 0)
    if not same.any():
        return same
    kept = flat[np.repeat(same, n)]
    read = np.frombuffer(b"".join(text if same.all() else [t for t, s in zip(text, same.tolist()) if s]), np.uint8)
    wrong = np.flatnonzero(ragged(start[kept], length[kept], data) != read)
    same[np.flatnonzero(same)[np.searchsorted(np.cumsum(size[same]), wrong, "right")]] = False
    return same


@lru_cache(2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _parts(text: str) -> Iterator[str]:
    """The text in parts of about PART characters, each without the space at which the next one begins."""
    a = 0
    while len(text) - a > PART:
        cut = UNIT_START.search(text, a + PART)
        if cut is None:
            break
        yield text[a : cut.start()]
        a = cut.end()
    yield text[a:]


def _summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's times."""
    if not len(key):
        return key, times
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    return key[first], np.add.reduceat(times[order], first)


class _Row:
    """What is known of a text whose parts have been aligned so far."""

    def __init__(self):
        self.sums, self.groups, self.pairs, self.times = np.zeros(4, np.int64), [], [], []
        self.good = True

    def add(self, sums: np.ndarray, groups: bytes, pairs: np.ndarray, times: np.ndarray) -> None:
        self.good = self.good and bool(sums[4])
        self.sums += sums[:4]
        self.groups.append(groups)
        self.pairs.append(pairs)
        self.times.append(times)

    def values(self) -> tuple:
        if not self.good or not self.groups:
            return 0, 0, 0, 0, "", [], []
        pairs, times = self.pairs[0], self.times[0]
        if len(self.pairs) > 1:
            pairs, times = _summed(np.concatenate(self.pairs), np.concatenate(self.times))
        return *self.sums.tolist(), b"".join(self.groups)[:-1].decode(), pairs, times


def _align_parts(a: Aligner, parts: list[str]) -> Iterator[tuple]:
    """Sums, groups, and linked pairs with their times, of each part."""
    units = [a.units(p) for p in parts]
    a.learn()
    n = np.fromiter(map(len, units), np.int64, len(units))
    flat = np.fromiter((u for x in units for u in x), np.int64, int(n.sum()))
    first = np.cumsum(n) - n
    sums = np.add.reduceat(a.sums[flat], first, axis=0)
    sums[:, 4] = np.minimum.reduceat(a.sums[flat, 4], first)
    # each unit of a part once, then its links
    key, times = np.unique((np.repeat(np.arange(len(units)), n) << 32) | flat, return_counts=True)
    part, unit = key >> 32, key & 0xFFFFFFFF
    used = unit
    links = a.sums[unit, 3]
    pairs = ragged(a.start[unit], links, a.pairs)
    part, times = np.repeat(part, links), np.repeat(times, links)
    order = np.lexsort((pairs, part))
    part, pairs, times = part[order], pairs[order], times[order]
    if len(pairs):
        new = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(pairs, prepend=-1) != 0))
        part, pairs, times = part[new], pairs[new], np.add.reduceat(times, new)
    cut = np.searchsorted(part, np.arange(len(units) + 1)).tolist()
    for i, found in enumerate(units):
        groups = b"".join(map(a.groups.__getitem__, found))
        yield sums[i], groups, pairs[cut[i] : cut[i + 1]], times[cut[i] : cut[i + 1]]
    a.trim(used)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, pairs, times) of every row.

    ``groups`` lists the token ids of each group, as in ``a1,a2|b1;a3|b2,b3``. ``pairs`` are the distinct linked pairs,
    each as A's id times the size of B's vocabulary plus B's id, in order, and ``times`` the links of each. Both
    tokenizer files must be where workers can open them.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<bigint>"
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = aligner(path_a, path_b)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows, parts, owner, size, done = {}, [], [], 0, 0

            def flush(upto: int) -> pa.RecordBatch:
                """Rows from ``done`` on, whose parts have all been seen."""
                nonlocal done
                if parts:
                    for i, found in zip(owner, _align_parts(a, parts), strict=True):
                        rows.setdefault(i, _Row()).add(*found)
                values = zip(*(rows.pop(i, _Row()).values() for i in range(done, upto))) if upto > done else [[]] * 7
                columns = [pa.array(list(v), k) for v, k in zip(values, kinds, strict=True)]
                out = pa.RecordBatch.from_arrays([ids.slice(done, upto - done), *columns], names=[id_col, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])
                parts.clear()
                owner.clear()
                done = upto
                return out

            for i in range(len(texts)):
                text = texts[i].as_py()
                for part in _parts(text) if text else ():
                    parts.append(part)
                    owner.append(i)
                    size += len(part)
                    if size >= PART:
                        yield flush(i)
                        size = 0
            yield flush(len(texts))

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, path_b: str) -> DataFrame:
    """(pair, links, best): links of each pair in the corpus, and whether no other pair of the same token of B has more."""
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    each = aligned.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("links"))
    each = stored(each.withColumn("b", (F.col("pair") % size_b).cast("int")))
    # a row for each token of B's vocabulary at most
    most = F.broadcast(each.groupBy("b").agg(F.max("links").alias("most")))
    return stored(each.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best")))


def with_pair_counts(aligned: DataFrame, path_b: str) -> DataFrame:
    """``aligned`` with ``n_best``, the links whose pair is its B token's most frequent, and ``count_sum``, the links' counts summed.

    ``pairs`` and ``times`` go. All other columns are written to the shared folder with them once, so that no text is
    aligned again: leave out what is not needed.
    """
    aligned = stored(aligned.withColumn("__row", F.monotonically_increasing_id()))
    counts = pair_counts(aligned, path_b)
    total = counts.agg(F.sum("links")).first()[0] or 0
    frequent = F.col("links") * F.lit(MOST_PAIRS) > F.lit(total)
    table = counts.where(frequent).sort("pair").toArrow().combine_chunks()
    held = [np.asarray(table.column(c)) for c in ("pair", "links", "best")]
    shared = aligned.sparkSession.sparkContext.broadcast(held)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, links, best = shared.value
        for batch in batches:
            lists, times = batch.column(1), np.asarray(batch.column(2).flatten())
            n = np.asarray(lists.value_lengths(), np.int64)
            code, row = np.asarray(lists.flatten()), np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(pair, code), max(len(pair) - 1, 0))
            known = pair[at] == code if len(pair) else np.zeros(len(code), bool)
            value = np.zeros((len(n), 2), np.int64)
            np.add.at(value[:, 0], row[known], times[known] * best[at[known]])
            np.add.at(value[:, 1], row[known], times[known] * links[at[known]])
            left = np.append(0, np.cumsum(np.bincount(row[~known], minlength=len(n)))).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~known], pa.int64())) for x in (code, times)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(value[:, 0]), pa.array(value[:, 1]), *rest], names=["__row", "n_best", "count_sum", "pairs", "times"]
            )

    found = aligned.select("__row", "pairs", "times").mapInArrow(
        look_up, "__row bigint, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"
    )
    rest = found.select("__row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    rare = rest.join(counts.where(~frequent), "pair").groupBy("__row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum")
    )
    sums = found.select("__row", "n_best", "count_sum").unionByName(rare)
    sums = sums.groupBy("__row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("pairs", "times").join(sums, "__row").drop("__row")
