"""Word shingles of whole texts as 64-bit hashes, whole Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(977)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACE = _RNG.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A byte of a word counts by its place: a power of one base for the place in its run of 2^RUN bytes, and of another for the run.
RUN = 12
_POWERS = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full((1 << RUN) - 1, _BASE, np.uint64))))
_RUN_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(text: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of parts of about `most` bytes; one text is never divided. Null texts are empty."""
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    n = len(text)
    if not n:
        return
    _, offs, data = text.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    part = (offsets[:-1] - offsets[0]) // most
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for s, e in zip(bounds, bounds[1:], strict=False):
        o = offsets[s : e + 1]
        yield s, e, data[o[0] : o[-1]], o - o[0]


def shingles(d: np.ndarray, o: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the width-word windows of each text, sorted within it, and where each text's begin (one more at the end).

    Words are what lies between white space (space, tab, line ends, vertical tab, form feed). A text of fewer words has one
    shingle of all its words; one without words has none.
    """
    n = len(o) - 1
    word = ~((d == 32) | ((d >= 9) & (d <= 13)))
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    first = o[:-1][o[:-1] < o[1:]]
    begin[first] = word[first]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    at = np.int32 if len(d) < 1 << 31 else np.int64
    within = np.arange(len(d), dtype=at) - starts.astype(at)[np.cumsum(begin, dtype=at) - 1]
    within[~word] = 0
    value = _BYTE[d]
    value *= _POWERS[within & ((1 << RUN) - 1)]
    run = int(within.max()) >> RUN
    if run:
        value *= np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(run, _RUN_BASE, np.uint64))))[within >> RUN]
    value[~word] = 0
    del within
    hashed = mix64(np.add.reduceat(value, starts))
    at = np.searchsorted(starts, o)
    doc = np.repeat(np.arange(n), np.diff(at))
    m, end = len(hashed), at[1:][doc]
    place = np.arange(m)
    summed = np.zeros(m, np.uint64)
    for j in range(width):
        here = place[: m - j] + j < end[: m - j]
        summed[: m - j] += np.where(here, hashed[j:] * _PLACE[j], np.uint64(0))
    whole = (place + width <= end) | ((place == at[:-1][doc]) & (end - at[:-1][doc] < width))
    h = mix64(summed[whole])
    ptr = np.concatenate(([0], np.cumsum(np.bincount(doc[whole], minlength=n))))
    for s, e in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        if e - s > 1:
            h[s:e].sort()
    return h, ptr


def counted(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text, how often each occurs in it, and where each text's begin."""
    if not len(h):
        return h, np.empty(0, np.int64), ptr
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[ptr[:-1][ptr[:-1] < ptr[1:]]] = True
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(at, ptr)
