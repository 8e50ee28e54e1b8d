"""How a join with bounded memory cuts its build side into chunks."""

from __future__ import annotations

import math
from dataclasses import dataclass


def lambert_w(x: float) -> float:
    """The w >= 0 with w * e^w = x, for x >= 0, by Newton's method on log(w) + w = log(x) where that converges."""
    if x < 0:
        raise ValueError("x must not be negative")
    if x == 0:
        return 0.0
    w = math.log1p(x) if x < math.e else math.log(x) - math.log(math.log(x)) if x > 16 else 1.0
    for _ in range(64):
        e = math.exp(w)
        step = (w * e - x) / (e * (w + 1))
        w -= step
        if abs(step) <= 1e-13 * (1 + abs(w)):
            break
    return w


@dataclass(frozen=True)
class ChunkPlan:
    radix_bits: int
    chunk_rows: int
    chunks: int
    probe_bytes: int


def histogram_bytes(bits: int) -> int:
    return 4 << bits


def most_rows(room: float, bits: int) -> int:
    """The most tuples whose packed form fits into `room` bytes: each takes the 32 - bits bits of its key that the radix leaves, and
    log2(n) bits for its place. n * (32 - bits + log2 n) = 8 * room has the solution below."""
    if room <= 0:
        return 0
    c, x = 32 - bits, 8 * room * math.log(2)
    # with v = ln n + c ln 2: v e^v = x 2^c
    n = math.exp(lambert_w(x * 2.0**c) - c * math.log(2))
    return max(1, int(n))


def plan_chunks(build_rows: int, probe_rows: int, memory_bytes: int, bits: int = 24, probe_floor: float = 1 / 20, histogram_share: float | None = None) -> ChunkPlan:
    """Chunks of the build side for so many bytes; memory_bytes 0 means no bound, hence one chunk.

    The probe side's buffers get a share that balances both sides' passes, probe_floor of the memory at least. With
    histogram_share, radix bits shrink until the histogram takes no more than that share.
    """
    if memory_bytes < 0:
        raise ValueError("memory_bytes must not be negative")
    if not memory_bytes:
        return ChunkPlan(bits, max(1, build_rows), 1, 0)
    if histogram_share is not None:
        while bits > 1 and histogram_bytes(bits) > memory_bytes * histogram_share:
            bits -= 1
    ratio = build_rows / max(1, build_rows + probe_rows)
    probe = int(memory_bytes * max(probe_floor, min(0.5, (1 - ratio) / 10)))
    rows = most_rows(memory_bytes - probe - histogram_bytes(bits), bits)
    if rows < 1:
        raise ValueError(f"{memory_bytes} bytes don't hold the histogram of {bits} radix bits")
    return ChunkPlan(bits, rows, max(1, math.ceil(build_rows / rows)), probe)
