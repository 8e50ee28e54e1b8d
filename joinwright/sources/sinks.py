"""Where results go: files, logs of matches, counts, sizes and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_relation(r: DataFrame, path: str, mode: str = "errorifexists") -> None:
    r.write.mode(mode).parquet(path)


def log_matches(joined: DataFrame, path: str) -> None:
    """Append matches as CSV files."""
    joined.select("key", "r_payload", "s_payload").write.mode("append").csv(path)


def count(joined: DataFrame) -> int:
    return joined.count()


def output_bytes(joined: DataFrame, row_bytes: int = 12, header_bytes: int = 0) -> DataFrame:
    """One row: how many rows, and how many bytes in packed form."""
    return joined.agg(F.count("*").alias("n_rows")).select("n_rows", (F.col("n_rows") * row_bytes + header_bytes).alias("n_bytes"))


def sample(r: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """n rows after the first `offset`, in key order."""
    return r.orderBy("key", "payload").offset(offset).limit(n)
