"""Vectorised text kernels over Arrow batches: tokens, hashes, shingles.

A word is a maximal run of ASCII letters and digits and of bytes of multi-byte
characters, after Unicode lower-casing. Hashes are polynomial over random odd
byte codes modulo 2^64, then mixed; they depend on the word alone, so equal words
have equal hashes on every machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20260101)
BYTE_CODE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
STEP = np.uint64(0xD6E8FEB86659FD93)
BLOCK = 1 << 18

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[128:] = True

_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse for i < n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        m = max(n, BLOCK + 4096)
        with np.errstate(over="ignore"):
            for key, base in (("up", BASE), ("down", BASE_INV)):
                a = np.full(m, base, np.uint64)
                a[0] = 1
                _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * STEP
    return h ^ (h >> np.uint64(29))


def buffer_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string array without nulls."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    offs = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] else np.zeros(0, np.uint8)
    lo, hi = (int(offs[0]), int(offs[-1])) if len(offs) else (0, 0)
    return data[lo:hi], offs - lo


def release() -> None:
    """Give freed memory back to the system: Python workers live on after a task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow that releases memory when its task ends."""

    @wraps(run)
    def inner(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def texts_of(col: pa.Array) -> pa.Array:
    return pc.fill_null(col.cast(pa.large_string()), "")


def slices(col: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Cut a text column so that each slice holds about `most` bytes, or one text."""
    col = texts_of(col)
    n, at = len(col), 0
    ends = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False)) if n else np.zeros(0, np.int64)
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, col.slice(at, to - at)
        at = to


def spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of inside bytes that cross no text's border."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One mixed 64-bit hash for each span; spans are in order of their starts."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    with np.errstate(over="ignore"):
        while k < len(starts):
            lo = int(starts[k])
            to = max(k + 1, int(np.searchsorted(starts, lo + BLOCK, "right")))
            hi = int(ends[k:to].max())
            up, down = powers(hi - lo + 1)
            run = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(BYTE_CODE[buf[lo:hi]] * up[: hi - lo], out=run[1:])
            s, e = starts[k:to] - lo, ends[k:to] - lo
            out[k:to] = (run[e] - run[s]) * down[s] + (e - s).astype(np.uint64)
            k = to
        return mix(out)


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a slice of texts, and where each text's words begin and end."""
    buf, offs = buffer_of(pc.utf8_lower(col))
    s, e = spans(buf, offs, WORD[buf])
    return hash_spans(buf, s, e), np.searchsorted(s, offs)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of `size` hashes, in order; the caller picks those inside a text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(size), np.uint64)
        for j in range(size):
            out = out * STEP + hashes[j : j + n]
        return mix(out)


def shingle_sets(col: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text its sorted set of word shingles; a text of fewer words than
    `size`, but one at least, has one shingle of all its words, and an empty one none."""
    hashes, at = words(col)
    win = windows(hashes, size)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= size:
            yield np.unique(win[lo : hi - size + 1])
        elif hi > lo:
            yield windows(hashes[lo:hi], hi - lo)
        else:
            yield np.zeros(0, np.uint64)
