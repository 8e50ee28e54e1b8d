"""Sharding by minimax contiguous partition. DataFrame functions only.

Rows with equal texts are an atomic group, and groups are ordered by their text's digest. The smallest capacity at which a greedy pass over
the groups needs no more than the wanted number of shards is found by binary search, and the groups are cut there.

The search sees the groups through a histogram of at most 2^16 cells of the digest's range. Taking every cell as one group gives a capacity
that suffices, taking cells of several groups as divisible anywhere gives one below which none can. Between the two lie the cells that may
hold a cut; these alone are counted again in narrower cells, until both capacities are the same or the cells are single groups.
A group larger than an even share of the bytes has a shard of its own, so that it doesn't set the size of the others.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, written

#: A group is told by the first KEY_BITS bits of its text's SHA-256; texts that agree there, if ever, count as one group.
KEY_BITS, CELL_BITS, MOST_CELLS = 60, 16, 1 << 17


def _cells(groups: DataFrame, width: int, spans: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int, int]]:
    """(first key, width, bytes, groups) of each cell of 2^width keys that has groups, in order; of the spans of keys [a, b) only, if given.

    The histogram comes to the driver: at most 2^CELL_BITS cells at first, then so many spans and bits that MOST_CELLS is kept.
    """
    if spans is not None:
        inside = F.lit(False)
        for a, b in spans:
            inside = inside | ((F.col("key") >= a) & (F.col("key") < b))
        groups = groups.filter(inside)
    counts = groups.groupBy(F.shiftright("key", width).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    return sorted((r["cell"] << width, width, r["size"], r["n"]) for r in counts.collect())


def _atomic(sums: list[int], capacity: int, most: int) -> tuple[list[int], bool]:
    """Cuts (cell numbers) of a greedy pass that divides no cell, up to `most`, and whether it was stopped by a cell above the capacity."""
    cuts, at = [], 0
    while len(cuts) < most:
        to = bisect_right(sums, sums[at] + capacity) - 1
        if to >= len(sums) - 1:
            break
        if to == at:
            return cuts, True
        cuts.append(at := to)
    return cuts, False


def _fluid(sums: list[int], single: list[bool], capacity: int, most: int) -> list[int]:
    """Cuts (bytes) of a greedy pass that divides cells of several groups anywhere, up to `most`."""
    cuts, at = [], 0
    while len(cuts) < most and at + capacity < sums[-1]:
        cell = bisect_right(sums, at + capacity) - 1
        cuts.append(at := sums[cell] if single[cell] else at + capacity)
    return cuts


def _least(low: int, high: int, fits) -> int:
    """The least capacity from low to high that fits; high fits."""
    return low + bisect_left(range(low, high), True, key=fits)


def cut_keys(groups: DataFrame, shards: int) -> list[int]:
    """First keys of the shards after the first of the minimax partition of groups (key, size) in key order; no group is larger than an even share."""
    cells, level = _cells(groups, KEY_BITS - CELL_BITS), KEY_BITS - CELL_BITS
    while True:
        sums, single = [0, *accumulate(c[2] for c in cells)], [c[3] == 1 for c in cells]
        total = sums[-1]
        if not cells or shards < 2:
            return []

        def whole(capacity: int) -> bool:
            cuts, stopped = _atomic(sums, capacity, shards)  # noqa: B023
            return not stopped and len(cuts) < shards

        even = max(-(-total // shards), *(c[2] for c in cells if c[3] == 1), 1)
        enough = _least(even, total, whole)
        needed = _least(even, enough, lambda c: len(_fluid(sums, single, c, shards)) < shards)  # noqa: B023
        best = [cells[i][0] for i in _atomic(sums, enough, shards)[0]]
        if needed == enough or level == 0:
            return best
        low, stopped = _atomic(sums, needed, shards - 1)
        high = _fluid(sums, single, enough, shards - 1)
        if stopped:  # a cell of several groups above the capacity needed
            at = low[-1] if low else 0
            wanted = {at}
        else:
            of = lambda b: min(bisect_right(sums, b) - 1, len(cells) - 1)  # noqa: E731, B023
            ends = [*high, *[total] * (len(low) - len(high))]
            wanted = {c for a, b in zip(low, ends, strict=False) for c in range(a, of(b) + 1)}
        several = sorted(c for c in wanted if not single[c])
        if not several:
            return best
        room = max(1, (MOST_CELLS // len(several)).bit_length() - 1)
        level = max(0, level - room)
        spans: list[tuple[int, int]] = []
        for c in several:
            a, b = cells[c][0], cells[c][0] + (1 << cells[c][1])
            spans = [*spans[:-1], (spans[-1][0], b)] if spans and spans[-1][1] == a else [*spans, (a, b)]
        if len(spans) > 4 * shards:  # more would make a long condition: close the gaps that matter least
            spans = _merged(spans, 4 * shards)
        inside = lambda key: (i := bisect_right(spans, (key, 1 << 62)) - 1) >= 0 and key < spans[i][1]  # noqa: E731, B023
        cells = sorted([c for c in cells if not inside(c[0])] + _cells(groups, level, spans))


def _merged(spans: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    gaps = sorted(range(1, len(spans)), key=lambda i: spans[i][0] - spans[i - 1][1])
    joined = set(gaps[: len(spans) - most])
    out = [spans[0]]
    for i in range(1, len(spans)):
        out = [*out[:-1], (out[-1][0], spans[i][1])] if i in joined else [*out, spans[i]]
    return out


def _large(groups: DataFrame, shards: int) -> list[int]:
    """Keys of the groups that are larger than an even share of what smaller ones leave, fewer than `shards`."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    found: list[tuple[int, int]] = []
    while True:
        bound, left = total - sum(s for _, s in found), shards - len(found)
        more = groups.filter((F.col("size") * left > bound) & ~F.col("key").isin([k for k, _ in found])).collect()  # fewer than `left`
        if not more or left < 2:
            return sorted(k for k, _ in found)
        found += [(r["key"], r["size"]) for r in sorted(more, key=lambda r: (-r["size"], r["key"]))[: left - 1]]


def _number_of(cuts: list[int], large: list[int]) -> Column:
    """The shard of a key."""
    first = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("key"))) if cuts else F.lit(0)
    if not large:
        return first.cast("int")
    at = F.array_position(F.array(*[F.lit(k) for k in large]), F.col("key"))
    return F.when(at > 0, at + len(cuts)).otherwise(first).cast("int")


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", window_rows: int = 512, row_bytes: int = 16) -> DataFrame:
    """One row per row of docs: id, size (UTF-8 bytes of the text and row_bytes), crc32 of the text (unsigned), shard and slot.

    Groups larger than an even share of the bytes have the last shards, one each; no contiguous partition of the others into the shards left
    has a smaller largest shard. Slots count from 0 without gaps in each shard, ordered by the first bits of the digest, then by parts of
    about window_rows rows, so that a group of many copies is numbered by many tasks, then id and text digest.
    A null text counts as the empty text; null ids come first in their part. Rows repeated in all columns take slots of their own. Shards
    may stay empty if there are few groups. An empty table gives an empty table. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + row_bytes).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.sha2(text, 256).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("id", "size", "text_crc32", F.unhex("digest").alias("digest"), F.conv(F.substring("digest", 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"), "row")
    rows = written(rows, "shard-rows")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "shard-groups")
    large = _large(groups, shards)
    cuts = cut_keys(groups.filter(~F.col("key").isin(large)), shards - len(large))
    atom = F.shiftright("key", KEY_BITS - CELL_BITS).cast("int").alias("atom")
    counts = groups.groupBy(_number_of(cuts, large).alias("shard"), atom).agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("atom").rowsBetween(Window.unboundedPreceding, -1)
    parts = F.least(F.lit(1 << CELL_BITS), F.ceil(F.col("n") / window_rows)).cast("int")
    placed = F.broadcast(written(counts.select("shard", "atom", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), parts.alias("parts")), "shard-placed"))  # 2^CELL_BITS and `shards` rows at most
    discard(groups)
    of_row = rows.select("id", "size", "text_crc32", "digest", "row", _number_of(cuts, large).alias("shard"), atom)
    dealt = of_row.join(placed, ["shard", "atom"]).withColumn("part", F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("row "), "row"))), "parts").cast("int"))
    per = ["shard", "atom", "part"]
    inner = Window.partitionBy("shard", "atom").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(dealt.groupBy(*per).agg(F.count("*").alias("n")).select(*per, F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("first")), "shard-parts")
    nth = F.row_number().over(Window.partitionBy(*per).orderBy("id", "digest", "size")) - 1
    out = dealt.withColumn("nth", nth).join(starts.hint("merge"), per)
    return out.select("id", "size", "text_crc32", "shard", (F.col("base") + F.col("first") + F.col("nth")).cast("long").alias("slot"))
