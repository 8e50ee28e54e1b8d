"""A stream of S probing a table R: the same inner equi-join, batch by batch, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RELATION


def read_relation_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """(key, payload) of the Parquet files that come to a folder."""
    reader = spark.readStream.schema(RELATION)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def probe(r: DataFrame, s: DataFrame) -> DataFrame:
    """(key, r_payload, s_payload) of the table r and the stream s; the planner broadcasts r if its size allows."""
    a, b = r.select("key", F.col("payload").alias("r_payload")), s.select("key", F.col("payload").alias("s_payload"))
    return b.join(a, "key").select("key", "r_payload", "s_payload")
