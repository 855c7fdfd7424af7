"""Vectorised word splitting and hashing over Arrow string arrays (NumPy only; runs inside tasks).

Words are `[^\\x20\\x09-\\x0D]+`, found in the UTF-8 bytes: none of those bytes occurs inside a longer code point.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.RandomState(20231)
_TABLE = _RNG.randint(1, 2**63 - 1, size=256, dtype=np.int64).astype(U) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


#: What modules keep in a worker between tasks: name -> a function that lets go of it.
held: dict[str, Callable[[], None]] = {"powers": _powers.clear}


def lean(run, keep: str = ""):
    """`run` for mapInArrow, in a worker that holds nothing of other operators' tasks (but for `keep`) while it works, and
    returns freed memory to the system when it is done. Workers outlive their tasks, so that counts on small executors. Nothing
    here makes cycles, so Python's search for them rests until then: it would walk through all words that are held."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for name, clear in held.items():
                if name != keep:
                    clear()
            gc.disable()
            yield from run(batches)
        finally:
            _powers.clear()
            if not keep:
                for clear in held.values():
                    clear()
            gc.enable()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        step = np.full(size, U(_BASE if which == "up" else _INVERSE))
        step[0] = 1
        have = _powers[which] = np.cumprod(step, dtype=U)
    return have[:n]


def blocks(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about max_bytes of text each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.diff(text_buffer(batch.column(batch.schema.get_field_index(column)))[1])
    total, start = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start, n - start)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    n = len(texts)
    if not n or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    n = len(data)
    total = np.zeros(n + 1, U)
    np.cumsum(_TABLE[data] * _power("up", n), out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", n + 1)[starts] + (ends - starts).astype(U))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the sequences a_i b_i, from the hashes of both halves."""
    return mix(a * U(0xD6E8FEB86659FD93) + b * U(0xA0761D6478BD642F) + U(0xE7037ED1A0B428DB))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words of one array (callers mask runs that cross rows)."""
    if len(words) < n:
        return np.zeros(0, U)
    power, size, out, at = words, 1, None, 0
    while True:
        if n & size:
            out = power[at : at + len(words) - n + 1] if out is None else joined(out, power[at : at + len(words) - n + 1])
            at += size
        if size * 2 > n:
            return out
        power = joined(power[:-size], power[size:])
        size *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` values."""
    if len(x) < width:
        return x[:0]
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    if size < width:
        x = np.minimum(x[: len(x) - (width - size)], x[width - size :])
    return x


def inside(woffs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start indices of all runs of n words that stay in one row, and their rows."""
    counts = np.maximum(np.diff(woffs) - n + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - before[rows] + woffs[:-1][rows], rows
