"""Readers of Parquet tables, pipe-separated tables and key files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import RELATION, TBL


_schemas: dict[tuple[str, int], T.StructType] = {}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A Parquet table; unused columns are never read. Its schema is asked of the files once for each time that they change, which spares each query a job."""
    path = f"{directory}/{name}.parquet"
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    changed = place.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(place).getModificationTime()
    if (path, changed) not in _schemas:
        _schemas[(path, changed)] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[(path, changed)]).parquet(path)


def tbl_path(name: str, scale: int, root: str = "data") -> str:
    return f"{root}/scale{scale:02d}/{name}.tbl"


def read_tbl(spark: SparkSession, path: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A pipe-separated table with a separator after the last field; fields may be quoted, a quote inside is doubled."""
    schema = T.StructType([*TBL[name].fields, T.StructField("_end", T.StringType())])
    rows = spark.read.csv(path, sep="|", quote='"', escape='"', schema=schema, dateFormat="yyyy-MM-dd", mode="PERMISSIVE")
    return rows.select(*(columns or [f.name for f in TBL[name].fields]))


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """A relation from a file of one number a line; the leading number of a line counts, lines without one give key 0. Payloads are 0."""
    lines = spark.read.text(path)
    number = F.regexp_extract("value", r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")
    rows = lines.select(F.coalesce(number, F.lit(0).cast("bigint")).alias("key"), F.lit(0).cast("bigint").alias("payload"))
    return rows.to(RELATION)


def relation(df: DataFrame, key: str, payload: str | None = None) -> DataFrame:
    """(key, payload) of a table; without a payload column, the key is its own."""
    return df.select(F.col(key).cast("bigint").alias("key"), F.col(payload or key).cast("bigint").alias("payload"))
