"""Words of Arrow text columns as hashes, for whole batches at once.

A text is read as UTF-8 bytes.  A byte at a place of a word stands for a random number of its own, and a
word's hash is the mixed sum of them, taken from running sums, so no word becomes a Python object.  (A
polynomial modulo 2^64 would not do: for every base there are short periodic words it can't tell apart.)
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 20  # bytes of text handled at once; one longer text is handled by itself
_GRAM = 0xD1342543DE82EF95
_PLACES = 128  # places of a word whose numbers come from a table


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer (two rounds of multiply and shift)."""
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as asked for."""

    def __init__(self, base: int):
        self.base = base
        self.up = self.down = np.ones(1, U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            back = pow(self.base, -1, 2**64)
            self.up = np.concatenate([[U(1)], np.cumprod(np.full(size - 1, self.base, U))])
            self.down = np.concatenate([[U(1)], np.cumprod(np.full(size - 1, back, U))])
        return self.up[:n], self.down[:n]


_WORDS = _Powers(_GRAM)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: every ASCII character but letters and digits
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


_NUMBERS = mix(np.arange(_PLACES << 8, dtype=U), 7)
_SAME = np.arange(256)
_LOWER = np.where((_SAME >= ord("A")) & (_SAME <= ord("Z")), _SAME + 32, _SAME)


def _numbers(code: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The numbers of bytes at places of a word."""
    out = _NUMBERS[np.minimum(place, _PLACES - 1) << 8 | code]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        out[far] = mix((place[far] << 8 | code[far]).astype(U), 7)
    return out


@dataclass
class Words:
    """Words of some rows: bytes start[i]:end[i] of `data`; row r has words at[r]:at[r+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    at: np.ndarray
    total: np.ndarray  # running sums over the bytes of words
    first: np.ndarray  # where each word begins in them

    def heads(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of each word; words that aren't longer have their own hash."""
        long = self.end - self.start > n
        stop = self.first[:-1] + np.minimum(n, self.end - self.start)
        h = mix(self.total[stop] - self.total[self.first[:-1]], 50 + n)
        return np.where(long, h, self.hash)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k consecutive words inside a row, and offsets by row."""
        n = np.diff(self.at)
        off = np.concatenate([[0], np.cumsum(np.maximum(n - k + 1, 0))])
        if not off[-1]:
            return np.empty(0, U), off
        up, down = _WORDS(len(self.hash) + 1)
        total = np.concatenate([[U(0)], np.cumsum(self.hash * up[:-1])])
        m = np.maximum(n - k + 1, 0)
        i = np.arange(off[-1]) + np.repeat(self.at[:-1] - off[:-1], m)
        return mix((total[i + k] - total[i]) * down[i], k), off


def words(texts: pa.Array, separators: np.ndarray = SPACES, lower: bool = False) -> Words:
    """Words (longest runs of bytes that are no separators) of a text column; null reads as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.empty(0, np.uint8)
    o = o - o[0]
    inside = np.concatenate([[False], ~separators[b], [False]])
    edge = np.zeros(len(b) + 1, bool)
    edge[o] = True
    start = np.flatnonzero(inside[1:] & (edge | ~inside[:-1]))
    end = np.flatnonzero(inside[:-1] & (edge | ~inside[1:]))
    size = end - start
    first = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], size)
    total = np.concatenate([[U(0)], np.cumsum(_numbers((_LOWER if lower else _SAME)[b[inside[1:-1]]], place))])
    h = mix(total[first[1:]] - total[first[:-1]], 1)
    return Words(b, start, end, h, np.searchsorted(start, o), total, first)


_LIBC = ctypes.CDLL(None) if sys.platform == "linux" else None


def give_back() -> None:
    """Return free memory of this process to the system: Python workers live on after their task."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a text column with about `most` bytes each: (first row, slice)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    o = np.concatenate([[0], np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(o, o[first] + most, "right")) - 1)
        yield first, texts.slice(first, last - first)
        first = last
