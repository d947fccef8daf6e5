"""Word boundaries and word hashes of many texts at once, as numpy operations on their UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = 0x20
#: Bytes of text that one round of array operations covers; longer texts are cut between words.
ROUND_BYTES = 1 << 19

#: Separators are space and \t..\r; everything else stays as it is.
PLAIN_WORDS = bytes(SPACE if b == SPACE or 9 <= b <= 13 else b for b in range(256))
#: Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters.
FOLDED_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else SPACE for b in range(256)
)

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """All words of a list of texts in order; ``first[d] .. first[d + 1]`` are those of text d."""

    first: np.ndarray
    hash1: np.ndarray
    hash2: np.ndarray | None
    length: np.ndarray


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _round(data: np.ndarray, both: bool):
    word = data != SPACE
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        empty = np.empty(0, np.uint64)
        return start, empty, empty if both else None, end - start
    length = end - start
    total = int(length.sum())
    within = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    value = data[word].astype(np.uint64) + np.uint64(1)
    at = np.cumsum(length) - length
    longest = int(length.max())
    found = []
    for base in _BASES[: 2 if both else 1]:
        found.append(mix(np.add.reduceat(value * powers(base, longest)[within], at) + length.astype(np.uint64)))
    return start, found[0], found[1] if both else None, length


def words(texts: list[bytes], table: bytes, both: bool = False) -> Words:
    """Words of UTF-8 texts; ``table`` maps bytes to themselves, their folded form or SPACE.

    Two words have the same (hash1, hash2) exactly if their mapped bytes are
    equal, up to a chance of 2^-64 a hash.
    """
    mapped = b" ".join([t.translate(table) for t in texts]) + b" "
    offset = np.cumsum([0] + [len(t) + 1 for t in texts])
    data = np.frombuffer(mapped, np.uint8)
    parts, a = [], 0
    while a < len(data):
        b = min(len(data), a + ROUND_BYTES)
        if b < len(data):
            cut = mapped.rfind(b" ", a, b)
            b = cut + 1 if cut >= a else mapped.index(b" ", b) + 1
        start, h1, h2, n = _round(data[a:b], both)
        parts.append((start + a, h1, h2, n))
        a = b
    start = np.concatenate([p[0] for p in parts])
    return Words(
        np.searchsorted(start, offset),
        np.concatenate([p[1] for p in parts]),
        np.concatenate([p[2] for p in parts]) if both else None,
        np.concatenate([p[3] for p in parts]),
    )


def window_hashes(h: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values (fewer values: none)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= base
        out += h[k : k + n]
    return mix(out)
