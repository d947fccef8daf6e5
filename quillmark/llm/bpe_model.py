"""Byte-pair merge tables as arrays, with the two questions that avoid re-running merges.

A sequence of tokens is what byte-pair merging makes of a word exactly if each
token is what merging makes of the token's own text and every adjacent pair is
*compatible*: merging the pair's joined text gives the pair back. Compatibility
of (a, b) follows from the merge ranks alone. Undo the merges next to the
boundary, latest first; at any time a merge across the boundary would have been
taken if its rank is lower than that of the last undone merge (for one undone
on the right also if it is equal, as equal ranks merge from the left).
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np

#: Words of more bytes are merged one by one, with a heap.
LONG_WORD = 64


@lru_cache(1)
def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Lookup:
    """Integer keys to integers (-1: absent) as one probing table, for whole arrays of keys."""

    def __init__(self, keys: list[int], values: list[int]):
        bits = max(4, (8 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int64)
        for slot, key, value in zip(self._slot(np.array(keys, np.int64)).tolist(), keys, values, strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.values[slot] = key, value

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], -1)
        left = np.flatnonzero((found != key) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found = self.keys[slot[left]]
            hit = found == key[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class MergeModel:
    """Vocabulary and merges of a tokenizer file; ``ending`` is the mark of a word's last token ('' if none)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.ending: str = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes: list[bytes] = [b""] * self.size
        self.ends = np.zeros(self.size, bool)
        for token, i in vocab.items():
            plain = token
            if self.ending and token.endswith(self.ending):
                plain, self.ends[i] = token[: -len(self.ending)], True
            self.bytes[i] = bytes(alphabet[c] for c in plain)
        for text, i in self.specials.items():
            self.bytes[i] = text.encode()
        special = set(self.specials.values())
        self.rank = np.full(self.size, -1, np.int64)
        self.left = np.zeros(self.size, np.int64)
        self.right = np.zeros(self.size, np.int64)
        keys, ranks = [], []
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.rank[k], self.left[k], self.right[k] = r, i, j
            self.merge[i, j] = (r, k)
            keys.append(i * self.size + j)
            ranks.append(r)
        self.rank_of_pair = Lookup(keys, ranks)
        self.made = np.array([k for _, k in self.merge.values()], np.int64)
        self.single = np.full(256, -1, np.int64)
        self.single_end = np.full(256, -1, np.int64)
        for i in range(self.size):
            if len(self.bytes[i]) == 1 and i not in special and self.rank[i] < 0:
                (self.single_end if self.ends[i] else self.single)[self.bytes[i][0]] = i
        self._build_trie(special)

    def _build_trie(self, special: set[int]) -> None:
        """Transitions (node, byte) -> node as sorted keys; per node the inner and the word-ending token."""
        node_of = {b"": 0}
        keys, to = [], []
        inner, final = [-1], [-1]
        for i in sorted(range(self.size), key=lambda i: self.bytes[i]):
            text = self.bytes[i]
            if i in special or not text:
                continue
            node = 0
            for n in range(1, len(text) + 1):
                step = node_of.get(text[:n])
                if step is None:
                    step = node_of[text[:n]] = len(inner)
                    inner.append(-1)
                    final.append(-1)
                    keys.append(node * 256 + text[n - 1])
                    to.append(step)
                node = step
            (final if self.ends[i] else inner)[node] = i
        self.next_node = Lookup(keys, to)
        self.inner = np.array(inner, np.int64)
        self.final = np.array(final, np.int64)
        self.root = np.full(256, -1, np.int64)
        for key, node in zip(keys, to, strict=True):
            if key < 256:
                self.root[key] = node

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next node, or -1."""
        return self.next_node(node * 256 + byte)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each adjacent pair, whether merging its joined text gives the pair back."""
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            cross = self.rank_of_pair(a * self.size + b)
            clash = (cross >= 0) & (cross < limit)
            out[live[clash]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~clash & (np.maximum(ra, rb) >= 0)
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            undo_left = ra > rb
            limit = np.where(undo_left, ra, rb + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return out

    def greedy(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Longest-match tokens of all words at once; (word, token) in word order, words as ranges of ``flat``."""
        words, tokens = [], []
        live = np.flatnonzero(end > start)
        cur = start[live].copy()
        stop = end[live]
        while len(live):
            node = self.root[flat[cur]]
            at = cur + 1
            best, best_at = self.inner[node].copy(), at.copy()
            walk = np.flatnonzero(at < stop)
            node, pos = node[walk], at[walk]
            while len(walk):
                node = self.step(node, flat[pos])
                ok = node >= 0
                walk, node, pos = walk[ok], node[ok], pos[ok] + 1
                token = self.inner[node]
                hit = token >= 0
                best[walk[hit]], best_at[walk[hit]] = token[hit], pos[hit]
                more = pos < stop[walk]
                walk, node, pos = walk[more], node[more], pos[more]
            words.append(live)
            tokens.append(best)
            go = best_at < stop
            live, cur, stop = live[go], best_at[go], stop[go]
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        word, token = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def merged(self, word: bytes) -> list[int]:
        """Exact merging of one word, lowest rank first and leftmost among equals, with a heap over a linked list."""
        ids = [int(self.single[b]) for b in word]
        if self.ending and ids:
            ids[-1] = int(self.single_end[word[-1]])
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merge.get((ids[i], ids[j]))):
                heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [i for i in ids if i >= 0]

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merging of many words, one merge of each word a round; long words go one by one."""
        out: list = [None] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = np.array(self.merged(w), np.int64)
        if not short:
            return out
        size = np.array([len(words[i]) for i in short])
        symbol = self.single[np.frombuffer(b"".join([words[i] for i in short]), np.uint8)]
        if self.ending:
            last = np.cumsum(size) - 1
            symbol[last] = self.single_end[np.frombuffer(bytes(words[i][-1] for i in short), np.uint8)]
        word = np.repeat(np.arange(len(short)), size)
        none = np.int64(1 << 30)

        def pair_rank(at: np.ndarray) -> np.ndarray:
            """Rank of the pair at a symbol and the next of its word."""
            to = np.minimum(at + 1, len(symbol) - 1)
            rank = self.rank_of_pair(symbol[at] * self.size + symbol[to])
            return np.where((word[at] == word[to]) & (at < to) & (rank >= 0), rank, none)

        rank = pair_rank(np.arange(len(symbol)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(symbol)), first)
            over = (best >> 32) >= none
            if over.any():
                ended = np.repeat(over, np.diff(first, append=len(symbol)))
                done.append((word[ended], symbol[ended]))
                word, symbol, rank = word[~ended], symbol[~ended], rank[~ended]
                if not len(symbol):
                    break
                first = np.flatnonzero(np.diff(word, prepend=-1))
                best = np.minimum.reduceat((rank << 32) | np.arange(len(symbol)), first)
            at = best & 0xFFFFFFFF
            symbol[at] = self.made[best >> 32]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            word, symbol, rank = word[keep], symbol[keep], rank[keep]
            rank[at] = pair_rank(at)
            before = at[at > 0] - 1
            rank[before] = pair_rank(before)
        word, symbol = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(word, kind="stable")
        parts = np.split(symbol[order], np.cumsum(np.bincount(word, minlength=len(short)))[:-1])
        for i, ids in zip(short, parts, strict=True):
            out[i] = ids
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Tokens of distinct words: counts per word, all tokens in order, and how many words needed merging.

        Longest matches are proposed, every adjacent pair is checked at once,
        and only words with an incompatible pair are merged.
        """
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(length)
        word, token = self.greedy(flat, end - length, end)
        same = word[1:] == word[:-1]
        ok = np.ones(len(same), bool)
        ok[same] = self.compatible(token[:-1][same], token[1:][same])
        failed = np.zeros(len(words), bool)
        failed[word[1:][~ok]] = True
        count = np.bincount(word, minlength=len(words))
        if not failed.any():
            return count, token, 0
        redo = np.flatnonzero(failed)
        exact = self.merge_words([words[i] for i in redo.tolist()])
        kept = ~failed[word]
        count[redo] = [len(x) for x in exact]
        word = np.concatenate([word[kept], np.repeat(redo, count[redo])])
        token = np.concatenate([token[kept], *exact])
        return count, token[np.argsort(word, kind="stable")], len(redo)

    def prefix_tables(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(last, count) at every byte of every word: last token and token count of the prefix that ends there.

        All words advance together, a byte at a time; at each byte the tokens
        that end there are tried from the longest, until one is compatible with
        the last token of the prefix before it.
        """
        total = len(flat)
        token_at = self._tokens_from(flat, start, end, self.inner)
        last, count = np.full(total, -1, np.int64), np.zeros(total, np.int64)
        size = end - start
        order = np.argsort(-size, kind="stable")
        sizes = -size[order]
        for j in range(1, int(size.max(initial=0)) + 1):
            live = order[: np.searchsorted(sizes, -j, "right")]
            self._extend(start[live], j, token_at, last, count, last, count)
        return last, count

    def whole_words(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Token count of each word, from its prefix table and, if words have an ending mark, one marked token."""
        last, count = self.prefix_tables(flat, start, end)
        size = end - start
        if not self.ending:
            return np.where(size > 0, count[np.maximum(end - 1, 0)], 0)
        final = self._tokens_from(flat, start, end, self.final)
        marked, whole = np.full(len(flat), -1, np.int64), np.zeros(len(flat), np.int64)
        for j in np.unique(size[size > 0]).tolist():
            self._extend(start[size == j], j, final, last, count, marked, whole)
        return np.where(size > 0, whole[np.maximum(end - 1, 0)], 0)

    def end_counts(self, word: bytes) -> np.ndarray:
        """Token count of each prefix of one or more bytes of a word, taken as a whole word (0 inside a character)."""
        flat = np.frombuffer(word, np.uint8).astype(np.int64)
        start, end = np.array([0]), np.array([len(flat)])
        last, count = self.prefix_tables(flat, start, end)
        if not self.ending:
            return count
        final = self._tokens_from(flat, start, end, self.final)
        marked, whole = np.full(len(flat), -1, np.int64), np.zeros(len(flat), np.int64)
        for j in range(1, len(flat) + 1):
            self._extend(start, j, final, last, count, marked, whole)
        return whole

    def _extend(self, start, j, token_at, last, count, to_last, to_count) -> None:
        """Fill the entry of the prefix of ``j`` bytes of the words that begin at ``start``."""
        open_ = start
        for n in range(min(j, len(token_at)), 0, -1):
            token = token_at[n - 1][open_ + (j - n)]
            has = np.flatnonzero(token >= 0)
            if not len(has):
                continue
            at, token = open_[has], token[has].astype(np.int64)
            if n == j:
                before, ok = 0, np.ones(len(at), bool)
            else:
                back = at + (j - n - 1)
                before, ok = count[back], self.compatible(last[back], token)
                before = before[ok]
            place = at[ok] + (j - 1)
            to_last[place], to_count[place] = token[ok], before + 1
            gone = np.zeros(len(open_), bool)
            gone[has[ok]] = True
            open_ = open_[~gone]
            if not len(open_):
                return

    def _tokens_from(self, flat, start, end, terminal) -> list[np.ndarray]:
        """For each length n, the token of that length that begins at each byte, or -1."""
        stop = np.repeat(end, end - start)
        at = np.arange(len(flat))
        node = self.root[flat]
        out = []
        while len(at):
            tokens = np.full(len(flat), -1, np.int32)
            tokens[at] = terminal[node]
            out.append(tokens)
            pos = at + len(out)
            more = pos < stop[at]
            at, pos = at[more], pos[more]
            node = self.step(node[more], flat[pos])
            ok = node >= 0
            at, node = at[ok], node[ok]
        return out
