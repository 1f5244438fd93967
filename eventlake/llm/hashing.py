"""Vectorised hashes of words and windows over the raw bytes of an Arrow text column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTE, _LANES = 0x9E3779B97F4A7C15, (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets of where each begins; null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, dtype=U)]), dtype=U) for b in (self.base, self.inverse))
        return self.up, self.down


class Sums:
    """Prefix sums from which the polynomial hash of any run of values comes by one subtraction."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=U)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def all_of(self, size: int) -> np.ndarray:
        """Of each run of `size` values."""
        return (self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size]

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.down[begin]


class WordHasher:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of several texts at once."""

    def __init__(self):
        self.bytes, self.lanes = Powers(_BYTE), [Powers(x) for x in _LANES]

    def words(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes in order, and the text that each is in. data: the bytes from offsets[0] to offsets[-1]."""
        offsets = offsets - offsets[0]
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        in_word = ~_BLANK[data]
        first, last = in_word.copy(), in_word.copy()
        first[1:] &= ~in_word[:-1]
        last[:-1] &= ~in_word[1:]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]  # where texts that aren't empty begin
        first[edge] = in_word[edge]
        last[edge[edge > 0] - 1] = in_word[edge[edge > 0] - 1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        h = Sums(data.astype(U) + U(1), self.bytes).of(begin, end) + (end - begin).astype(U) * U(0xA0761D6478BD642F)
        return mix(h), np.searchsorted(offsets, begin, side="right") - 1

    def lane(self, words: np.ndarray, i: int) -> Sums:
        return Sums(words, self.lanes[i])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return values if span == width else np.minimum(values[: len(values) - (width - span)], values[width - span :])


def anchors(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each `width` neighbouring grams the place of the one with the least hash (the leftmost of equals) and 32 bits of that hash.

    Equal windows pick their anchor at the same place within them, so what is said of an anchor's hash
    holds for all windows equal to its own.
    """
    best = window_minima((mix(grams) & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U), width)
    return (best & U(0xFFFFFFFF)).astype(np.int64), best >> U(32)
