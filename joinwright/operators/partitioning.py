"""Radix partitioning of a relation, its histogram, and the prefix sums of that."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.radix import radix


def partition(r: DataFrame, bits: int, shift: int = 0) -> DataFrame:
    """r with `pid`, rows of a radix value together; partitions are no more than the session shuffles to."""
    n = min(1 << bits, int(r.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return r.withColumn("pid", radix("key", bits, shift)).repartition(n, "pid")


def histogram(r: DataFrame, bits: int, shift: int = 0) -> DataFrame:
    """(pid, n): rows of each radix value that occurs; summed before the exchange, so no more than 2^bits rows a task move."""
    return r.groupBy(radix("key", bits, shift).alias("pid")).agg(F.count("*").alias("n"))


def prefix_sums(counts: DataFrame) -> DataFrame:
    """(pid, n, start): how many rows stand before those of pid, by pid. The histogram has 2^bits rows, so one task orders it."""
    before = Window.partitionBy(F.lit(0)).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("pid", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("start"))


def sorted_chunks(r: DataFrame, bits: int) -> DataFrame:
    """r by radix value, sorted by it inside each partition."""
    return partition(r, bits).sortWithinPartitions("pid", "key", "payload")


def repeated(r: DataFrame, weight: str) -> DataFrame:
    """Each row as often as its weight says; not at all for 0 or less."""
    return r.filter(F.col(weight) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(weight).cast("bigint") - 1)))


def placed(r: DataFrame, size: int, place: str = "place") -> DataFrame:
    """(place, key, payload) for all places from 0 to size - 1; places that no row names have nulls."""
    slots = r.sparkSession.range(size).select(F.col("id").alias(place))
    return slots.join(r.select(F.col(place).cast("bigint").alias(place), "key", "payload"), place, "left")


def partition_sizes(r: DataFrame) -> DataFrame:
    """(partition, n): rows that each task scans."""
    return r.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))
