"""Times and throughputs of joins."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class JoinResult:
    count: int
    seconds: float
    input_rows: int
    phases: dict[str, float] = field(default_factory=dict)

    @property
    def million_rows_per_second(self) -> float:
        return self.input_rows / self.seconds / 1e6 if self.seconds else 0.0


def timed(action: Callable[[], object]) -> tuple[object, float]:
    began = time.perf_counter()
    return action(), time.perf_counter() - began


def measure(result: Callable[[], DataFrame], input_rows: int, repetitions: int = 1) -> JoinResult:
    """Counts what result() gives; the time is the median of the repetitions."""
    runs = [timed(lambda: result().count()) for _ in range(max(1, repetitions))]
    return JoinResult(int(runs[-1][0]), statistics.median(s for _, s in runs), input_rows)


def measure_phases(selections: dict[str, DataFrame], joined: Callable[[dict[str, DataFrame]], DataFrame]) -> JoinResult:
    """Selections are cached and counted first, then joined: the time of both phases apart. For benchmarks only; a query plans both as one."""
    cached = {k: df.cache() for k, df in selections.items()}
    try:
        rows, select = timed(lambda: sum(df.count() for df in cached.values()))
        n, join = timed(lambda: joined(cached).count())
    finally:
        for df in cached.values():
            df.unpersist()
    return JoinResult(int(n), select + join, int(rows), {"selection": select, "join": join})
