"""Sorting relations, and telling whether one is sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import placed_rows


def sort_relation(r: DataFrame) -> DataFrame:
    """r by key, ascending: a range exchange, then a sort in each partition. Payloads travel with their keys."""
    return r.orderBy("key", "payload")


def first_violation(r: DataFrame, place: str = "payload") -> DataFrame:
    """One row: is_sorted, and the first place whose key is less than that of the place before (null if none).

    Places may have gaps. Rows are compared with their predecessor inside range partitions by place; the first row of a partition
    with the last of the one before, a row for each partition.
    """
    kept = placed_rows(r.select(F.col(place).alias("place"), "key"), ["place", "key"], "places")
    inside = kept.withColumn("before", F.lag("key").over(Window.partitionBy("_part").orderBy("_row")))
    ends = kept.groupBy("_part").agg(F.min_by(F.struct("place", "key"), "_row").alias("first"), F.max_by("key", "_row").alias("last"))
    seams = ends.select(F.col("first.place").alias("place"), F.col("first.key").alias("key"), F.lag("last").over(Window.orderBy("_part")).alias("before"))
    bad = inside.select("place", "key", "before").unionByName(seams).filter("key < before").agg(F.min("place").alias("first_violation"))
    return bad.select(F.col("first_violation").isNull().alias("is_sorted"), "first_violation")
