"""Several joins or queries at once in one session, each in a fair pool of its own."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Task:
    name: str
    result: Callable[[], DataFrame]  # one row, whose first column is a count
    input_rows: int = 0


SCHEMA = "query_id int, name string, n_matches bigint, seconds double, million_rows_per_second double"


def run(spark: SparkSession, tasks: list[Task], delay_ms: int = 0) -> DataFrame:
    """One row for each task: query_id, name, n_matches, seconds, million_rows_per_second. Starts are delay_ms apart. The first
    failure is raised when all have ended."""

    def one(i: int, task: Task) -> tuple:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"query-{i}")
        began = time.perf_counter()
        n = int(task.result().first()[0])
        s = time.perf_counter() - began
        return (i, task.name, n, s, task.input_rows / s / 1e6 if s else 0.0)

    if not tasks:
        return spark.createDataFrame([], SCHEMA)
    with ThreadPoolExecutor(len(tasks)) as pool:
        futures = []
        for i, task in enumerate(tasks):
            if i and delay_ms:
                time.sleep(delay_ms / 1000)
            futures.append(pool.submit(inheritable_thread_target(spark)(one), i, task))
        rows = [f.result() for f in futures]
    return spark.createDataFrame(rows, SCHEMA)


def mean_throughput(results: DataFrame) -> DataFrame:
    return results.agg(F.avg("million_rows_per_second").alias("million_rows_per_second"))
