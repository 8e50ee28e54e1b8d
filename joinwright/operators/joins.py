"""Inner equi-joins of R (build side) and S (probe side) on one key, with bag semantics, by named strategies.

All names give the same rows, (key, r_payload, s_payload); they differ in the plan. Each keeps its meaning at any size: a
strategy that broadcasts checks the size of R first and shuffles otherwise, partitions follow the cluster's settings, and hot keys are
left to adaptive execution or, where partitions are placed by radix, split explicitly.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.memory import plan_chunks
from ..functions.radix import radix, radix_bits


@dataclass(frozen=True)
class JoinConfig:
    """threads: partitions that a radix join wants at least. radix_bits: -1 chooses by the size of R. memory_bytes: of the chunked joins, 0
    for no bound. broadcast_rows: R is broadcast up to so many rows. nested_loop_pairs: most pairs a nested loop tries. hot_share:
    radix partitions of S with more than hot_share times the mean are split. split_rows: radix partitions of S with fewer rows never are (the
    cracking threshold). scans: a chunked join reads S so many times at most."""

    threads: int = 8
    radix_bits: int = 13
    memory_bytes: int = 0
    broadcast_rows: int = 1_000_000
    nested_loop_pairs: int = 1_000_000_000
    hot_share: float = 4.0
    blocks: int = 4
    split_rows: int = 1
    scans: int = 16

    def __post_init__(self):
        if self.threads < 1 or self.threads & (self.threads - 1):
            raise ValueError("threads must be a power of two")
        if not -1 <= self.radix_bits <= 24 or self.memory_bytes < 0 or min(self.blocks, self.split_rows, self.scans) < 1:
            raise ValueError("radix_bits is -1 to 24, memory_bytes 0 or more, blocks, split_rows and scans 1 or more")


def _sides(r: DataFrame, s: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    return r.select("key", F.col("payload").alias("r_payload"), *more), s.select("key", F.col("payload").alias("s_payload"), *more)


def _out(joined: DataFrame) -> DataFrame:
    return joined.select("key", "r_payload", "s_payload")


def _hinted(r: DataFrame, s: DataFrame, hint: str) -> DataFrame:
    a, b = _sides(r, s)
    return _out(a.hint(hint).join(b, "key"))


def _hinted_apart(r: DataFrame, s: DataFrame, hint: str, bits: int) -> DataFrame:
    """As _hinted, dealt by radix and key, of which the rows keep the key. Spark joins the partitions of a union's parts to one where all parts are
    dealt alike by what they keep, so that a task would read its share of every part at once; these stay partitions of their own."""
    pid = radix("key", bits)
    a, b = _sides(r.withColumn("pid", pid), s.withColumn("pid", pid), "pid")
    return _out(a.hint(hint).join(b, ["pid", "key"]))


def shuffled_hash(r: DataFrame, s: DataFrame, cfg: JoinConfig) -> DataFrame:
    """Both sides by a hash of the key; a hash table of each partition of R. Partitions of either side that are far over the median are
    split at run time (adaptive execution), the other side's rows going to each part."""
    return _hinted(r, s, "shuffle_hash")


def sort_merge(r: DataFrame, s: DataFrame, cfg: JoinConfig) -> DataFrame:
    """Both sides by a hash of the key, then sorted; duplicates on either side, spilling as need be."""
    return _hinted(r, s, "merge")


def small_enough(r: DataFrame, rows: int) -> bool:
    """Whether r has at most so many rows, reading no more than it takes to tell."""
    return r.select(F.lit(1)).limit(rows + 1).count() <= rows


def broadcast_hash(r: DataFrame, s: DataFrame, cfg: JoinConfig) -> DataFrame:
    """One hash table of all of R, shared by all probing tasks, if R is checked to be small; shuffled otherwise."""
    return _hinted(r, s, "broadcast" if small_enough(r, cfg.broadcast_rows) else "shuffle_hash")


def block_hash(r: DataFrame, s: DataFrame, cfg: JoinConfig) -> DataFrame:
    """R in blocks of keys, each joined with all of S as broadcast_hash does; S is read once for each block."""
    block = F.pmod(F.xxhash64("key"), F.lit(cfg.blocks))
    if small_enough(r, cfg.broadcast_rows * cfg.blocks):
        parts = [_hinted(r.filter(block == i), s, "broadcast") for i in range(cfg.blocks)]
    else:
        bits = bits_for(r, cfg)
        parts = [_hinted_apart(r.filter(block == i), s.filter(block == i), "shuffle_hash", bits) for i in range(cfg.blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def nested_loop(r: DataFrame, s: DataFrame, cfg: JoinConfig) -> DataFrame:
    """Every pair of partitions meets and every pair of rows is tried; refused beyond cfg.nested_loop_pairs."""
    pairs = r.select(F.lit(1)).count() * s.select(F.lit(1)).count()
    if pairs > cfg.nested_loop_pairs:
        raise ValueError(f"a nested loop over {pairs} pairs is refused; take another strategy or raise nested_loop_pairs")
    a, b = _sides(r, s)
    b = b.withColumnRenamed("key", "s_key")
    return _out(a.hint("shuffle_replicate_nl").join(b, a["key"] == b["s_key"]))


def bits_for(r: DataFrame, cfg: JoinConfig) -> int:
    return radix_bits(r.count(), cfg.threads) if cfg.radix_bits < 0 else cfg.radix_bits


def _partitions(r: DataFrame, bits: int) -> int:
    """Partitions for 2^bits radix values: no more than the session shuffles to, neighbours share one."""
    return min(1 << bits, max(1, int(r.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def radix_simple(r: DataFrame, s: DataFrame, cfg: JoinConfig) -> DataFrame:
    """Both sides are first partitioned by radix, R and S alike, then joined partition by partition without another exchange."""
    bits = bits_for(r, cfg)
    n = _partitions(r, bits)
    pid = radix("key", bits)
    a, b = _sides(r.withColumn("pid", pid), s.withColumn("pid", pid), "pid")
    return _out(a.repartition(n, "pid").hint("shuffle_hash").join(b.repartition(n, "pid"), ["pid", "key"]))


def radix_split(r: DataFrame, s: DataFrame, cfg: JoinConfig) -> DataFrame:
    """Radix partitions of S that are far larger than the mean are split, and R's rows of them go to each part; without any, as radix_fused.

    The histogram of S has 2^bits rows at most; it's counted first, and what is broadcast are its hot rows, 2^bits / hot_share at most.
    A row of S goes to the part that its key and payload say, so a task that runs again deals alike.
    """
    bits = bits_for(r, cfg)
    pid = radix("key", bits)
    counts = s.groupBy(pid.alias("pid")).agg(F.count("*").alias("n"))
    if bits <= 13:  # a small histogram is counted and looked at in one job
        found = counts.collect()
        fair = max(float(cfg.split_rows), cfg.hot_share * sum(x["n"] for x in found) / max(1, len(found)))
        hot = [(x["pid"], math.ceil(x["n"] / fair)) for x in found if x["n"] > fair]
        if len(found) < 2 or not hot:
            return radix_fused(r, s, cfg)
        parts = r.sparkSession.createDataFrame(hot, "pid int, parts int")
    else:
        rows, mean = counts.agg(F.count("*"), F.avg("n")).first()
        fair = max(float(cfg.split_rows), cfg.hot_share * (mean or 0))
        parts = counts.filter(F.col("n") > fair).select("pid", F.ceil(F.col("n") / F.lit(fair)).cast("int").alias("parts"))
        if rows < 2 or parts.isEmpty():
            return radix_fused(r, s, cfg)
    a, b = _sides(r.withColumn("pid", pid), s.withColumn("pid", pid), "pid")
    a = a.join(F.broadcast(parts), "pid", "left").select("key", "r_payload", "pid", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    dealt = F.pmod(F.xxhash64("key", "s_payload"), F.coalesce("parts", F.lit(1))).cast("int")
    b = b.join(F.broadcast(parts), "pid", "left").select("key", "s_payload", "pid", dealt.alias("part"))
    return _out(a.hint("shuffle_hash").join(b, ["pid", "part", "key"]))


def radix_fused(r: DataFrame, s: DataFrame, cfg: JoinConfig) -> DataFrame:
    """Partitioning is left to the join itself, which builds while R arrives and probes while S does."""
    bits = bits_for(r, cfg)
    pid = radix("key", bits)
    a, b = _sides(r.withColumn("pid", pid), s.withColumn("pid", pid), "pid")
    return _out(a.hint("shuffle_hash").join(b, ["pid", "key"]))


def _chunks(r: DataFrame, s: DataFrame, cfg: JoinConfig, **how) -> int:
    if not cfg.memory_bytes:
        return 1
    return plan_chunks(r.count(), s.count(), cfg.memory_bytes, min(24, max(1, bits_for(r, cfg))), **how).chunks


def _chunked(r: DataFrame, s: DataFrame, cfg: JoinConfig, hint: str, **how) -> DataFrame:
    """R in chunks of keys; S is read again for each chunk, of which it keeps the keys. More chunks than cfg.scans share scans, in partitions."""
    n = min(cfg.scans, _chunks(r, s, cfg, **how))
    if n == 1:
        return _hinted(r, s, hint)
    chunk, bits = F.pmod(F.xxhash64("key"), F.lit(n)), bits_for(r, cfg)
    out = None
    for i in range(n):
        part = _hinted_apart(r.filter(chunk == i), s.filter(chunk == i), hint, bits)
        out = part if out is None else out.union(part)
    return out


def chunked_merge(r: DataFrame, s: DataFrame, cfg: JoinConfig) -> DataFrame:
    """R in chunks that fit into the memory given, S read again for each; sorted, so that even one key's rows spill."""
    return _chunked(r, s, cfg, "merge")


def chunked_hash(r: DataFrame, s: DataFrame, cfg: JoinConfig) -> DataFrame:
    """As chunked_merge with a hash table of each chunk; the histogram is held to a quarter of the memory."""
    return _chunked(r, s, cfg, "shuffle_hash", probe_floor=1 / 32, histogram_share=1 / 4)


def partition_only(r: DataFrame, s: DataFrame, cfg: JoinConfig) -> DataFrame:
    """Both sides are partitioned by radix and nothing is joined: (side, pid, n), the rows of each radix partition."""
    bits = bits_for(r, cfg)
    n, pid = _partitions(r, bits), radix("key", bits)
    sized = [x.select(F.lit(side).alias("side"), pid.alias("pid")).repartition(n, "pid").groupBy("side", "pid").agg(F.count("*").alias("n")) for side, x in (("r", r), ("s", s))]
    return sized[0].union(sized[1])


Strategy = Callable[[DataFrame, DataFrame, JoinConfig], DataFrame]

#: Names of strategies. Those with _st are meant for one thread; how many run is the cluster's matter, so they equal the others.
REGISTRY: dict[str, Strategy] = {
    "RJ": shuffled_hash,
    "RHO": shuffled_hash,
    "RHT": shuffled_hash,
    "CRKJ": radix_split,
    "CRKJ_st": radix_split,
    "CRKJS": radix_simple,
    "CRKJS_st": radix_simple,
    "CRKJF": radix_fused,
    "CRKJF_st": radix_fused,
    "CRKJ_po": partition_only,
    "NL": nested_loop,
    "PHT": broadcast_hash,
    "BHJ": block_hash,
    "MJ": sort_merge,
    "MCJoin": chunked_merge,
    "PaMeCo": chunked_hash,
}


def join(name: str, r: DataFrame, s: DataFrame, cfg: JoinConfig | None = None) -> DataFrame:
    """(key, r_payload, s_payload) for each pair of rows with equal keys. Null keys match nothing. CRKJ_po gives partition_only() instead."""
    if name not in REGISTRY:
        raise ValueError(f"no join is named {name!r}; there are {', '.join(REGISTRY)}")
    return REGISTRY[name](r, s, cfg or JoinConfig())


def join_count(name: str, r: DataFrame, s: DataFrame, cfg: JoinConfig | None = None) -> DataFrame:
    """One row: n_matches; 0 of the rows that CRKJ_po partitions."""
    joined = join(name, r, s, cfg)
    matches = F.sum(F.when(F.col("side").isin("r", "s"), 0).otherwise(F.col("n"))) if name == "CRKJ_po" else F.count("*")
    return joined.agg(F.coalesce(matches, F.lit(0)).cast("bigint").alias("n_matches"))


def three_way(r: DataFrame, s: DataFrame, t: DataFrame, cfg: JoinConfig | None = None, name: str = "RHO") -> DataFrame:
    """T with (R with S), all by key: (key, t_payload). The second join reuses the first one's partitioning of the key."""
    first = join(name, r, s, cfg).select("key", F.col("r_payload").alias("payload"))
    return join(name, t, first, cfg).select("key", F.col("r_payload").alias("t_payload"))
