"""Whole-text kernels on Arrow string columns: words and hashes without a Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once (a longer text is taken alone).
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII bytes that are neither letters, digits nor white space.
PUNCT = np.zeros(256, bool)
PUNCT[33:48] = PUNCT[58:65] = PUNCT[91:97] = PUNCT[123:127] = True

BASE = 0x9E3779B97F4A7C15 | 1
STEP = 0xD1342543DE82EF95


@dataclass
class Words:
    """Words of consecutive texts: byte spans in ``data``, and where each text's words begin."""

    data: np.ndarray
    text_off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.off)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.count)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if data is None or n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give freed memory back to the system: workers are reused, and would keep what their largest batch took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each; every row is in exactly one part."""
    if not batch.num_rows:
        return
    _, off = bytes_of(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


def split(column: pa.Array, separators: np.ndarray = SPACE, lower: bool = False) -> Words:
    """Maximal runs of bytes outside ``separators``; with the default, the words ``[^\\x20\\x09-\\x0D]+``."""
    data, off = bytes_of(column)
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = off[:-1][off[:-1] < off[1:]]
        first[edges] = inside[edges]
        edges = off[1:][off[:-1] < off[1:]] - 1
        last[edges] = inside[edges]
    start = np.flatnonzero(first)
    return Words(data, off, start, np.flatnonzero(last) + 1, np.searchsorted(start, off))


def trim(words: Words) -> Words:
    """Words without leading and trailing ASCII punctuation; words of nothing else become empty spans."""
    start, end = words.start.copy(), words.end.copy()
    at = np.flatnonzero(PUNCT[words.data[start]]) if len(start) else start
    while len(at):
        start[at] += 1
        at = at[start[at] < end[at]]
        at = at[PUNCT[words.data[start[at]]]]
    at = np.flatnonzero((start < end) & PUNCT[words.data[end - 1]]) if len(start) else start
    while len(at):
        end[at] -= 1
        at = at[start[at] < end[at]]
        at = at[PUNCT[words.data[end[at] - 1]]]
    return Words(words.data, words.text_off, start, end, words.off)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Powers that a worker keeps; those for longer texts are made anew.
KEPT = SLICE_BYTES + (1 << 16)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        have = tuple(np.full(size, x % (1 << 64), np.uint64) for x in (base, pow(base, -1, 1 << 64)))
        for x in have:
            x[0] = 1
            np.cumprod(x, out=x)
        if size <= KEPT:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, equal in every batch and process."""
    up, down = powers(BASE, len(words.data))
    total = np.zeros(len(words.data) + 1, np.uint64)
    np.add(words.data, np.uint64(1), out=total[1:], dtype=np.uint64)
    total[1:] *= up[: len(words.data)]
    np.cumsum(total, out=total)
    return mix((total[words.end] - total[words.start]) * down[words.start])


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` consecutive values, whatever text they are of."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(STEP, len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(hashes) - n + 1] + np.uint64(n))


def text_keys(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's whole word sequence."""
    up, down = powers(STEP, len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[off[1:]] - total[off[:-1]]) * down[off[:-1]] + np.diff(off).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
