"""Schemas of relations and tables, and the sizes of the usual data sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Keys are unsigned 32-bit numbers, which only a bigint holds.
RELATION = T.StructType([T.StructField("key", T.LongType(), False), T.StructField("payload", T.LongType(), False)])
JOIN_OUTPUT = T.StructType([T.StructField(n, T.LongType(), False) for n in ("key", "r_payload", "s_payload")])
MAX_KEY = (1 << 32) - 1


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns])


_L, _S, _D, _F = T.LongType(), T.StringType(), T.DateType(), T.DoubleType()

#: All columns of the pipe-separated files, in order; readers prune them.
TBL = {
    "lineitem": _table(
        ("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L), ("l_linenumber", _L), ("l_quantity", _F), ("l_extendedprice", _F), ("l_discount", _F), ("l_tax", _F),
        ("l_returnflag", _S), ("l_linestatus", _S), ("l_shipdate", _D), ("l_commitdate", _D), ("l_receiptdate", _D), ("l_shipinstruct", _S), ("l_shipmode", _S), ("l_comment", _S),
    ),
    "orders": _table(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S), ("o_totalprice", _F), ("o_orderdate", _D), ("o_orderpriority", _S), ("o_clerk", _S), ("o_shippriority", _L), ("o_comment", _S)),
    "customer": _table(("c_custkey", _L), ("c_name", _S), ("c_address", _S), ("c_nationkey", _L), ("c_phone", _S), ("c_acctbal", _F), ("c_mktsegment", _S), ("c_comment", _S)),
    "part": _table(("p_partkey", _L), ("p_name", _S), ("p_mfgr", _S), ("p_brand", _S), ("p_type", _S), ("p_size", _L), ("p_container", _S), ("p_retailprice", _F), ("p_comment", _S)),
    "nation": _table(("n_nationkey", _L), ("n_name", _S), ("n_regionkey", _L), ("n_comment", _S)),
}


@dataclass(frozen=True)
class DataSet:
    """Sizes of R (primary keys) and S (foreign keys); or the table columns that R and S come from."""

    r_rows: int = 0
    s_rows: int = 0
    r_column: tuple[str, str] | None = None
    s_column: tuple[str, str] | None = None


def _mb(n: int) -> int:
    return n * (1 << 20) // 8  # 8 bytes a tuple


DATA_SETS = {
    "cache-fit": DataSet(_mb(10), _mb(40)),
    "cache-exceed": DataSet(_mb(100), _mb(400)),
    "L": DataSet(50_000_000, 200_000_000),
    "A": DataSet(32_000_000, 320_000_000),
    "B": DataSet(32_000_000, 32_000_000),
    "C": DataSet(r_column=("orders", "o_orderkey"), s_column=("lineitem", "l_orderkey")),
    "D": DataSet(r_column=("customer", "c_custkey"), s_column=("orders", "o_custkey")),
}
