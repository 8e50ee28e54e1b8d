"""How many rows a join has, without joining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_sizes(r: DataFrame, s: DataFrame) -> DataFrame:
    """(key, height, width): rows of each shared key in R and S. Each side is summed before it is shuffled, so hot keys weigh one row a task."""
    h = r.groupBy("key").agg(F.count("*").alias("height"))
    return h.join(s.groupBy("key").agg(F.count("*").alias("width")), "key")


def join_cardinality(r: DataFrame, s: DataFrame) -> DataFrame:
    """One row: n_matches."""
    return group_sizes(r, s).agg(F.coalesce(F.sum(F.col("height") * F.col("width")), F.lit(0)).cast("bigint").alias("n_matches"))
