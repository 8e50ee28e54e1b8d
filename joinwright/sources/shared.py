"""Tables written once and read again, in the folder that the cluster shares, and rows numbered with their help.

A written table cuts the lineage like a checkpoint, keeps only the columns asked for, and survives the loss of the executors that
wrote it. All tables of an application are in one folder, which is deleted when its driver ends; discard() deletes one before.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_DIR = "spark.checkpoint.dir"
_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode one of our own if that is unset."""
    named = spark.conf.get(_DIR, None) or spark.sparkContext.getConf().get(_DIR)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"set {_DIR} to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="joinwright-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set(_DIR, f"file://{own}")
    return f"file://{own}"


def _deleter(spark: SparkSession, path: str) -> Callable[[], None]:
    """What deletes a folder of the shared store, even when the session has been stopped; one that can't be deleted stays."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def run() -> None:
        with contextlib.suppress(Exception):
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)

    return run


def new_path(spark: SparkSession, what: str) -> str:
    """A path for a table of this application, which nothing else uses."""
    own = f"{shared_dir(spark)}/joinwright/{spark.sparkContext.applicationId}"
    if own not in _cleaned:
        _cleaned.add(own)
        atexit.register(_deleter(spark, own))
    return f"{own}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of written() that no later plan reads."""
    for t in tables:
        if t is not None:
            _deleter(t.sparkSession, t._written_at)()


_INNER = (1 << 33) - 1  # bits of monotonically_increasing_id that count inside a partition


def placed_rows(df: DataFrame, order: list[str | Column], what: str) -> DataFrame:
    """df as a written table with _part and _row: rows are in order by (_part, _row). Without an order, as they come."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    at = F.monotonically_increasing_id()
    return written(ranged.withColumns({"_part": F.shiftright(at, 33).cast("int"), "_row": at.bitwiseAND(F.lit(_INNER))}), what)


def numbered(df: DataFrame, *order: str | Column, name: str = "i", what: str = "numbered") -> DataFrame:
    """df with dense numbers from 0 in that order (without one, as rows come), for ever the same as the table is written first.

    Rows are numbered in their partitions; offsets come from the partitions' sizes, a row for each, so no window spans all rows.
    """
    kept = placed_rows(df, list(order), what)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept.groupBy("_part").agg(F.count("*").alias("n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    return kept.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_first") + F.col("_row")).cast("bigint")).drop("_part", "_row", "_first")
