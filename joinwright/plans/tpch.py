"""Selections and join pipelines of four decision-support queries, each ending in the number of joined rows.

Predicates are Columns with the usual constants as defaults. The planner pushes them into the scans, prunes columns and picks each
join's build side.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The queries' constants.
SEGMENT = "BUILDING"
Q3_DAY = date(1995, 3, 15)
Q10_FROM, Q10_TO = date(1993, 10, 1), date(1994, 1, 1)
Q12_FROM, Q12_TO = date(1994, 1, 1), date(1995, 1, 1)
Q12_MODES = ("MAIL", "SHIP")
Q19_MODES = ("AIR", "AIR REG")
Q19_INSTRUCTION = "DELIVER IN PERSON"
#: brand, containers, largest size, least and largest quantity
Q19_BRANCHES = (
    ("Brand#12", ("SM CASE", "SM BOX", "SM PACK", "SM PKG"), 5, 1, 11),
    ("Brand#23", ("MED BAG", "MED BOX", "MED PKG", "MED PACK"), 10, 10, 20),
    ("Brand#34", ("LG CASE", "LG BOX", "LG PACK", "LG PKG"), 15, 20, 30),
)


def q3_customer(segment: str = SEGMENT) -> Column:
    return F.col("c_mktsegment") == segment


def q3_orders(day: date = Q3_DAY) -> Column:
    return F.col("o_orderdate") < F.lit(day)


def q3_lineitem(day: date = Q3_DAY) -> Column:
    return F.col("l_shipdate") >= F.date_add(F.lit(day), 1)


def q10_orders(start: date = Q10_FROM, end: date = Q10_TO) -> Column:
    return (F.col("o_orderdate") >= F.lit(start)) & (F.col("o_orderdate") < F.lit(end))


def q10_lineitem(flag: str = "R") -> Column:
    return F.col("l_returnflag") == flag


def q12_lineitem(start: date = Q12_FROM, end: date = Q12_TO, modes: tuple[str, ...] = Q12_MODES) -> Column:
    c = F.col
    return (
        c("l_shipmode").isin(*modes) & (c("l_commitdate") < c("l_receiptdate")) & (c("l_shipdate") < c("l_commitdate"))
        & (c("l_receiptdate") >= F.lit(start)) & (c("l_receiptdate") < F.lit(end))
    )


def q19_lineitem(least: int = 1, most: int = 30, modes: tuple[str, ...] = Q19_MODES, instruction: str = Q19_INSTRUCTION) -> Column:
    return F.col("l_quantity").between(least, most) & F.col("l_shipmode").isin(*modes) & (F.col("l_shipinstruct") == instruction)


def q19_part(branches=Q19_BRANCHES, most: int | None = None) -> Column:
    top = most or max(b[2] for b in branches)
    return F.col("p_brand").isin(*[b[0] for b in branches]) & F.col("p_container").isin(*[c for b in branches for c in b[1]]) & F.col("p_size").between(1, top)


def q19_match(branches=Q19_BRANCHES, most: int | None = None) -> Column:
    """The condition over both sides: brand, container, size and quantity of one of the branches."""
    out = F.lit(False)
    for brand, containers, size, low, high in branches:
        out = out | ((F.col("p_brand") == brand) & F.col("p_container").isin(*containers) & F.col("p_size").between(1, most or size) & F.col("l_quantity").between(low, high))
    return out


def _n(joined: DataFrame) -> DataFrame:
    return joined.agg(F.count("*").alias("n_rows"))


def q3(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, segment: str = SEGMENT, day: date = Q3_DAY) -> DataFrame:
    c, o, line = customer.filter(q3_customer(segment)), orders.filter(q3_orders(day)), lineitem.filter(q3_lineitem(day))
    return _n(c.join(o, c["c_custkey"] == o["o_custkey"]).join(line, F.col("o_orderkey") == F.col("l_orderkey")))


def q10(customer: DataFrame, orders: DataFrame, nation: DataFrame, lineitem: DataFrame, start: date = Q10_FROM, end: date = Q10_TO) -> DataFrame:
    o, line = orders.filter(q10_orders(start, end)), lineitem.filter(q10_lineitem())
    joined = customer.join(o, F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return _n(joined.join(line, F.col("o_orderkey") == F.col("l_orderkey")))


def q12(orders: DataFrame, lineitem: DataFrame, start: date = Q12_FROM, end: date = Q12_TO) -> DataFrame:
    return _n(orders.join(lineitem.filter(q12_lineitem(start, end)), F.col("o_orderkey") == F.col("l_orderkey")))


def q19_rows(part: DataFrame, lineitem: DataFrame, most: int | None = None) -> DataFrame:
    p, line = part.filter(q19_part(most=most)), lineitem.filter(q19_lineitem())
    return p.join(line, (F.col("p_partkey") == F.col("l_partkey")) & q19_match(most=most))


def q19(part: DataFrame, lineitem: DataFrame, most: int | None = None) -> DataFrame:
    """Rows that also meet the condition over both sides. most widens the sizes."""
    return _n(q19_rows(part, lineitem, most))


def q19_before_match(part: DataFrame, lineitem: DataFrame, most: int | None = None) -> DataFrame:
    """Joined rows of both selections, before the condition over both sides."""
    return _n(part.filter(q19_part(most=most)).join(lineitem.filter(q19_lineitem()), F.col("p_partkey") == F.col("l_partkey")))


# --- columns that the test tables lack, by integer arithmetic that Spark and other SQL engines share ---

_MODES = ("AIR REG", "AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "FOB")
_INSTRUCTIONS = ("DELIVER IN PERSON", "COLLECT COD", "NONE", "TAKE BACK RETURN")
_CONTAINERS = tuple(c for b in Q19_BRANCHES for c in b[1])


def _choice(index: str, values: tuple[str, ...]) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def derived_sql(add_days: str) -> tuple[dict[str, str], dict[str, str]]:
    """SQL of lineitem's and part's derived columns; add_days is how the dialect adds {n} days to the date {d}."""
    seed = "(l_orderkey * 7 + l_linenumber * 3 + l_partkey)"
    ship = "CAST(l_shipdate AS DATE)"
    lineitem = {
        "l_shipmode": _choice(f"({seed} % 7)", _MODES),
        "l_shipinstruct": _choice(f"((l_orderkey + l_linenumber) % {len(_INSTRUCTIONS)})", _INSTRUCTIONS),
        "l_commitdate": add_days.format(d=ship, n=f"({seed} % 61 - 20)"),
        "l_receiptdate": add_days.format(d=ship, n=f"({seed} % 30 + 1)"),
    }
    return lineitem, {"p_container": _choice(f"(p_partkey % {len(_CONTAINERS)})", _CONTAINERS)}


def with_derived(df: DataFrame, which: int) -> DataFrame:
    """lineitem (which 0) or part (1) with the derived columns it lacks."""
    sql = derived_sql("date_add({d}, CAST({n} AS INT))")[which]
    return df.withColumns({k: F.expr(v) for k, v in sql.items() if k not in df.columns})
