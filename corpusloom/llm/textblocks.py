"""Texts of an Arrow column as flat byte blocks, and vectorised work on them.

A block holds whole texts only: a text longer than the block size gets a block
of its own, so nothing is ever cut, while the temporaries of numpy stay bounded
by the block size or the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
#: Rows of one Arrow batch of texts.
BATCH_ROWS = 500
U64 = np.uint64

#: [\x20\x09-\x0D]
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).view(U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    out = _powers[0][:n], _powers[1][:n]
    if n > 4 * BLOCK:  # one huge text must not keep its tables alive
        _powers[0], _powers[1] = np.ones(1, dtype=U64), np.ones(1, dtype=U64)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def lean(run: Callable) -> Callable:
    """An iterator function of a task that hands what it has freed back to the system.

    Workers outlive their tasks, so whatever allocators keep would add up over the
    stages of a job. Arrays beyond 4 MB are mapped, and so returned when freed; the
    rest is trimmed when a task begins and ends.
    """

    def trim(libc: ctypes.CDLL) -> None:
        pa.default_memory_pool().release_unused()
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    @wraps(run)
    def kept_small(batches: Iterator) -> Iterator:
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD, which would grow by itself otherwise
            libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD
        trim(libc)
        yield from run(batches)
        trim(libc)

    return kept_small


def small_batches(spark) -> None:
    """Texts are long rows: hand them to Python in batches of BATCH_ROWS rather than Spark's default of 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def column(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    col = col.cast(pa.large_binary())
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if buffers[2] is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(buffers[2], dtype=np.uint8), offsets


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, bytes, offsets from 0) of consecutive groups of whole texts."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def squeeze(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of [\\x20\\x09-\\x0D] inside a text becomes one space."""
    if not len(data):
        return data, offsets
    space = SPACE[data]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[starts] = True
    out = np.where(space, np.uint8(32), data)[keep]
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(keep, out=before[1:])
    return out, before[offsets]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and each text's first word (one more at the end)."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    space = SPACE[data]
    full = offsets[:-1] < offsets[1:]
    cut = np.ones(len(data), dtype=bool)
    cut[1:] = space[:-1]
    cut[offsets[:-1][full]] = True
    starts = np.flatnonzero(cut & ~space)
    cut[-1] = True
    cut[:-1] = space[1:]
    cut[offsets[1:][full] - 1] = True
    ends = np.flatnonzero(cut & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges that do not depend on where the range lies."""
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive hashes; one entry for each start."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= U64(0xD6E8FEB86659FD93)
        out += h[i : i + n]
    return mix(out + U64(k))
