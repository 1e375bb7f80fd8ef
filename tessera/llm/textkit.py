"""Vectorised numpy kernels over Arrow string buffers, shared by the corpus operators.

All kernels work on whole texts.  They take slices of a batch of bounded size
(``SLICE_BYTES`` of text, or one document where that is longer), so that memory does
not follow the Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None
U64 = np.uint64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _rng.integers(1, 2**64, size=256, dtype=np.uint64)
BASE = U64(0x9E3779B97F4A7C15 | 1)
_INV = U64(pow(int(BASE), -1, 2**64))
_POW: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i (or its inverse) modulo 2**64 for i < n; grown on demand."""
    key = "inv" if inverse else "pow"
    have = _POW.get(key)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 64)
        steps = np.full(size, _INV if inverse else BASE, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n > 4 * SLICE_BYTES:
            return have
        _POW[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of rows with about ``limit`` bytes.

    Null texts count as empty here; callers that tell them apart look at the validity.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, off_buf, data_buf = texts.buffers()
    offsets = np.frombuffer(off_buf, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        base = offsets[i]
        yield i, j, data[base : offsets[j]], offsets[i : j + 1] - base
        i = j


def parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows; what a part needed goes back to the machine."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
            release()


def release() -> None:
    """Gives freed memory back, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def trimmed(task: Callable[..., Iterator[pa.RecordBatch]], *args: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task`` over a partition; once it ends, what it needed goes back to the machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches, *args)
        release()

    return run


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row) of the maximal runs of bytes that aren't ASCII white space."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    left = np.empty(len(data), bool)
    left[0] = False
    left[1:] = word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    left[inner] = False
    starts = np.flatnonzero(word & ~left)
    right = np.empty(len(data), bool)
    right[-1] = False
    right[:-1] = word[1:]
    right[inner - 1] = False
    ends = np.flatnonzero(word & ~right) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each byte span, from one prefix sum over the slice."""
    n = len(data)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(n), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * powers(n + 1, True)[starts])


def window_hashes(tokens: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of ``width`` successive token hashes from each position of ``at``."""
    n = len(tokens)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(tokens * powers(n), out=prefix[1:])
    return mix((prefix[at + width] - prefix[at]) * powers(n + 1, True)[at])


def char_starts(data: np.ndarray) -> np.ndarray:
    """Number of UTF-8 characters that begin before each byte, with the total at the end."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    return np.arange(total, dtype=np.int64) - first
