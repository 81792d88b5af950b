"""Numpy helpers for tasks: texts of an Arrow batch as bytes, words as hashes, documents as runs."""

import ctypes

import numpy as np
import pyarrow as pa

#: Bytes of batches after which a task gives freed memory back.
REST_BYTES = 16 << 20

#: Bytes of text that numpy works on at a time; one longer text is still taken whole.
SLICE_BYTES = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
_STEP = 0x100000001B3
_STEP_BACK = pow(_STEP, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins and ends; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


def slices(ends: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of documents whose bytes stay below `limit`, one document at least."""
    low, n = 0, len(ends) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX2
    return h ^ (h >> np.uint64(32))


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = _STEP if kind == "up" else _STEP_BACK
        size = max(n, 1 << 20)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = _powers[kind] = np.multiply.accumulate(out)
    return have[:n]


def word_hashes(data: np.ndarray, ends: np.ndarray, is_word: np.ndarray):
    """64-bit hash of every run of bytes for which `is_word` holds, its document, first byte and end.

    Runs end where a document ends. Equal runs have equal hashes wherever they stand; a collision of
    different runs has a chance of about one in 2^64 a pair.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = ends[:-1][(ends[:-1] < n)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = ends[1:][ends[1:] > 0] - 1
    last[tails] = inside[tails]
    stops = np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _power("up", n), out=total[1:])
    h = mixed((total[stops] - total[starts]) * _power("down", n)[starts] + (stops - starts).astype(np.uint64) * _MIX2)
    return h, np.searchsorted(ends, starts, "right") - 1, starts, stops


def runs(owner: np.ndarray, n: int) -> np.ndarray:
    """Where the run of each of n owners begins in a sorted array, and the end of the last."""
    return np.searchsorted(owner, np.arange(n + 1))


def lower_table() -> np.ndarray:
    """Bytes with A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def bytes_in(*ranges) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low:high + 1] = True
    return out


def give_back():
    """Hand what Arrow and the C library keep of freed memory to the system (the latter with glibc only)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """A function for mapInArrow that gives freed memory back now and then, and at its end.

    A worker process outlives its task and would keep the most that it ever had, beside what its executor does next.
    """
    def counted(batches):
        taken = 0
        for batch in batches:
            taken += batch.nbytes
            yield batch
            if taken > REST_BYTES:
                give_back()
                taken = 0

    def lean_run(batches):
        try:
            yield from run(counted(batches))
        finally:
            give_back()

    return lean_run
