"""Numpy kernels over Arrow string batches: words, window hashes, feature hashes. They run inside Spark tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial hashes (arithmetic modulo 2**64) and the constants of the final mixing.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Of the C library, where it has it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes, so that any of them may be used alone."""
    h = h ^ (h >> np.uint64(30))
    h *= MIX[0]
    h ^= h >> np.uint64(27)
    h *= MIX[1]
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept for the next call."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        up, down = np.full(size, BASE, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers[0] = have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


class Prefix:
    """Prefix polynomial hashes of a byte array: the hash of any range in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def range(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array (null: empty) and the n + 1 offsets of its texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about `size` bytes together; a longer text makes a run of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def space(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def no_letter(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII that are neither letters nor digits."""
    low = data | np.uint8(0x20)
    return (data < 0x80) & ~((low >= 0x61) & (low <= 0x7A)) & ~((data >= 0x30) & (data <= 0x39))


def words(data: np.ndarray, offsets: np.ndarray, gaps=space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word: a run of bytes that are no gap, within one text."""
    gap = gaps(data)
    first = ~gap
    first[1:] &= gap[:-1]
    inside = offsets[:-1][(offsets[:-1] < len(data))]
    first[inside] = ~gap[inside]
    last = ~gap
    last[:-1] &= gap[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = ~gap[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 0x41) & (data <= 0x5A)) * np.uint8(0x20)).astype(np.uint8)


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the capital letters of U+00C0..U+00DE, byte for byte."""
    out = lower_ascii(data)
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += np.uint8(0x20)
    return out


def sums_by(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each text number (sorted) in 0..n-1."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    at = np.searchsorted(text, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def rest() -> None:
    """Give back to the system what Arrow and numpy have freed: a worker waits for its next task beside a JVM that needs the memory."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_kept: dict[str, Callable[[], None]] = {}


def turn_to(operator: str, drop: Callable[[], None] | None = None) -> None:
    """A worker that serves several operators holds the caches of one: those of the others are dropped. `drop` empties this one's."""
    others = [name for name in _kept if name != operator]
    for name in others:
        _kept.pop(name)()
    if drop is not None:
        _kept[operator] = drop
    if others:
        rest()
