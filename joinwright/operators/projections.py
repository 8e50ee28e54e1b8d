"""Projections of join results to relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pair(joined: DataFrame, key: Column | str, payload: Column | str) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return joined.select(col(key).alias("key"), col(payload).alias("payload"))


def build_column_to_key(joined: DataFrame, column: str) -> DataFrame:
    """(a column carried from the build side, S's payload)."""
    return _pair(joined, column, "s_payload")


def probe_column_to_key(joined: DataFrame, column: str) -> DataFrame:
    """(a column carried from the probe side, S's payload)."""
    return _pair(joined, column, "s_payload")


def probe_payload_twice(joined: DataFrame) -> DataFrame:
    return _pair(joined, "s_payload", "s_payload")


def key_and_probe_payload(joined: DataFrame) -> DataFrame:
    return _pair(joined, "key", "s_payload")


def to_relation(joined: DataFrame) -> DataFrame:
    """(key, R's payload)."""
    return _pair(joined, "key", "r_payload")
