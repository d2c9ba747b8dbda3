"""Words of a column of texts as numpy arrays, without a Python loop over words.

Texts stay in their Arrow buffer of UTF-8 bytes. All word patterns used here
split at ASCII characters only, so they can be applied to bytes. Every word
gets a 64-bit hash (a polynomial in its bytes with random coefficients, then
mixed), from which hashes of phrases are built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes per chunk: bounds the temporary arrays.
CHUNK_BYTES = 2 << 20
# Bytes or items worked on at a time inside a chunk, where arrays take many bytes for each.
PIECE = 1 << 16

_rng = np.random.RandomState(20240229)
_BYTE = _rng.randint(0, 2**63, size=256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        t[lo : hi + 1] = True
    return t


#: Bytes outside words: white space, or all of ASCII but letters and digits.
SPACE = _table((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = _table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the base and of its inverse, modulo 2^64."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = 1 << max(n, PIECE + 1).bit_length()
        for key, base in (("p", _BASE), ("i", _BASE_INVERSE)):
            a = np.full(size, np.uint64(base), dtype=np.uint64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["p"][:n], _powers["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts: those of text d are first[d] .. first[d + 1] - 1."""

    data: np.ndarray  # bytes of all texts (lower-cased if asked for)
    first: np.ndarray
    start: np.ndarray  # byte range of each word in data
    end: np.ndarray
    text: np.ndarray  # byte range of each text: text[d] .. text[d + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), dtype=np.uint64)
        for a, b in pieces(self.start, self.end):
            start, end = self.start[a:b] - self.start[a], self.end[a:b] - self.start[a]
            data = self.data[self.start[a] : self.end[b - 1]]
            p, inverse = powers(len(data) + 1)
            total = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[data] * p[:-1], out=total[1:])
            out[a:b] = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def pieces(start: np.ndarray, end: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs a .. b - 1 of consecutive ranges start .. end - 1 that together span most at the most, or one longer range."""
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + most, side="right")))
        yield a, b
        a = b


def chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of about max_bytes each; a longer text stands alone."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = _offsets(texts)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, texts.slice(row, end - row)
        row = end


def _offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]


def words(texts: pa.Array, outside: np.ndarray = SPACE, lower: bool = False) -> Words:
    """Words of one chunk (large_string without nulls, as chunks() gives)."""
    offsets = _offsets(texts)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    data = data[offsets[0] : offsets[-1]]
    bounds = (offsets - offsets[0]).astype(np.int64)
    if lower:
        data = _LOWER[data]
    inside = ~outside[data]
    n = len(data)
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside
    before[bounds] = False
    after = np.zeros(n + 1, dtype=bool)
    after[:n] = inside
    after[bounds] = False
    start = np.flatnonzero(inside & ~before[:n])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    first = np.searchsorted(start, bounds)
    return Words(data, first, start, end, bounds)


def phrases(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of the k items from each position on (len(h) - k + 1 of them)."""
    if k <= 0 or len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    step = np.uint64((_BASE * (2 * seed + 1)) % 2**64 | 1)
    n = len(h) - k + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * step + h[j : j + n]
    return mix(out ^ np.uint64(seed))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), then those of start[1], ..."""
    total = int(count.sum())
    skip = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count) if total else np.zeros(0, np.int64)
    return np.arange(total) + skip

