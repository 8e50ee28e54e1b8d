"""Radix of keys, and how many radix bits a relation wants."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def radix(key: Column | str, bits: int, shift: int = 0) -> Column:
    """The `bits` bits of the key above its lowest `shift`, as an int."""
    key = F.col(key) if isinstance(key, str) else key
    return F.shiftright(key, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).cast("int")


def radix_bits(rows: int, threads: int, tuple_bytes: int = 8, cache_bytes: int = 2 << 20) -> int:
    """Bits so that a partition of `rows` fits into the cache, and there is a partition for each thread."""
    fit = math.ceil(math.log2(max(1.0, rows * tuple_bytes / cache_bytes)))
    return max(fit, math.ceil(math.log2(max(1, threads))))
