"""The queries of all operators over the test tables, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import order
from ..functions.radix import radix
from ..operators import cardinality, joins, partitioning, projections, sealing
from ..schema import TBL
from ..sources import files, generators, sinks
from ..sources.files import relation, table
from ..sources.shared import new_path
from . import concurrent, tpch

Query = Callable[[SparkSession, str], DataFrame]

KEY = bytes(range(16))
Q10_SHIFTED = (date(1996, 10, 1), date(1997, 1, 1))
Q12_SHIFTED = (date(1996, 1, 1), date(1997, 1, 1))
BITS = 6


def orders_r(spark: SparkSession, d: str) -> DataFrame:
    return relation(table(spark, d, "orders"), "o_orderkey", "o_custkey")


def lineitem_s(spark: SparkSession, d: str) -> DataFrame:
    return relation(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")


def customer_r(spark: SparkSession, d: str) -> DataFrame:
    return relation(table(spark, d, "customer"), "c_custkey", "c_nationkey")


def orders_s(spark: SparkSession, d: str) -> DataFrame:
    return relation(table(spark, d, "orders"), "o_custkey", "o_orderkey")


JOIN_SQL = "SELECT o_orderkey AS key, o_custkey AS r_payload, l_partkey AS s_payload FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
COUNT_SQL = "SELECT count(*) AS n_matches FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
Q3_SQL = """SELECT count(*) AS n_rows FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1995-03-15' AND l_shipdate >= DATE '1995-03-16'"""
Q10_SQL = """SELECT count(*) AS n_rows FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= DATE '{}' AND o_orderdate < DATE '{}' AND l_returnflag = 'R'"""


def _with_sql() -> str:
    line, part = tpch.derived_sql("({d} + CAST({n} AS INTEGER))")
    cols = lambda c: ", ".join(f"{v} AS {k}" for k, v in c.items())
    return f"WITH l AS (SELECT *, {cols(line)} FROM lineitem), p AS (SELECT *, {cols(part)} FROM part) "


def _q12_where(start: date, end: date) -> str:
    return f"l_shipmode IN ('MAIL', 'SHIP') AND l_commitdate < l_receiptdate AND l_shipdate < l_commitdate AND l_receiptdate >= DATE '{start}' AND l_receiptdate < DATE '{end}'"


def _q19_part_where(most: int | None) -> str:
    brands, containers = ", ".join(f"'{b[0]}'" for b in tpch.Q19_BRANCHES), ", ".join(f"'{c}'" for b in tpch.Q19_BRANCHES for c in b[1])
    return f"p_brand IN ({brands}) AND p_container IN ({containers}) AND p_size BETWEEN 1 AND {most or 15}"


Q19_LINE_WHERE = "l_quantity BETWEEN 1 AND 30 AND l_shipmode IN ('AIR', 'AIR REG') AND l_shipinstruct = 'DELIVER IN PERSON'"


def _q19_sql(most: int | None, match: bool = True) -> str:
    branches = " OR ".join(
        f"(p_brand = '{b}' AND p_container IN ({', '.join(repr(x) for x in c)}) AND p_size BETWEEN 1 AND {most or s} AND l_quantity BETWEEN {lo} AND {hi})" for b, c, s, lo, hi in tpch.Q19_BRANCHES
    )
    return _with_sql() + f"SELECT count(*) AS n_rows FROM p JOIN l ON p_partkey = l_partkey WHERE {Q19_LINE_WHERE} AND {_q19_part_where(most)}" + (f" AND ({branches})" if match else "")


def _lineitem(spark: SparkSession, d: str) -> DataFrame:
    return tpch.with_derived(table(spark, d, "lineitem"), 0)


def _part(spark: SparkSession, d: str) -> DataFrame:
    return tpch.with_derived(table(spark, d, "part"), 1)


def _concurrent(spark: SparkSession, d: str) -> DataFrame:
    names = ("RHO", "CRKJ", "MJ", "PaMeCo")
    tasks = [concurrent.Task(n, lambda n=n: joins.join_count(n, customer_r(spark, d), orders_s(spark, d))) for n in names]
    return concurrent.run(spark, tasks).select("query_id", "name", "n_matches")


def _concurrent_queries(spark: SparkSession, d: str) -> DataFrame:
    c, o, n = (table(spark, d, t) for t in ("customer", "orders", "nation"))
    line, p = _lineitem(spark, d), _part(spark, d)
    each = {"q3": lambda: tpch.q3(c, o, line), "q10": lambda: tpch.q10(c, o, n, line, *Q10_SHIFTED), "q12": lambda: tpch.q12(o, line, *Q12_SHIFTED), "q19": lambda: tpch.q19(p, line, 50)}
    tasks = [concurrent.Task(k, each[k]) for k in [*each, *each]]
    return concurrent.run(spark, tasks).select("query_id", "name", "n_matches")


def _joined(spark: SparkSession, d: str) -> DataFrame:
    """customer with orders, carrying a column of each side through the join."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"]).select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("bigint").alias("r_payload"), F.col("o_orderkey").alias("s_payload"), "c_nationkey", "o_orderkey")


def _as_tbl(spark: SparkSession, d: str, name: str) -> str:
    """Path of a pipe-separated file with the rows of a test table, as such files come: all columns, an end mark, quotes where needed."""
    df = _lineitem(spark, d) if name == "lineitem" else _part(spark, d) if name == "part" else table(spark, d, name)
    cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TBL[name].fields]
    path = new_path(spark, f"tbl-{name}")
    df.select(*cols, F.lit("").alias("_end")).write.csv(path, sep="|", quote='"', escape='"', nullValue="", emptyValue="", dateFormat="yyyy-MM-dd")
    return path


def _from_tbl(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return files.read_tbl(spark, _as_tbl(spark, d, name), name, list(columns))


def _key_file(spark: SparkSession, d: str) -> str:
    """Path of a text file of customer keys, one a line; every tenth line has no number."""
    path = new_path(spark, "keys")
    line = F.when(F.col("c_custkey") % 10 == 0, "none").otherwise(F.col("c_custkey").cast("string"))
    table(spark, d, "customer").select(line.alias("value")).write.text(path)
    return path


def _zipf_law(spark: SparkSession, n: int = 400_000, top: int = 1000, z: float = 0.9) -> DataFrame:
    """Whether the most frequent keys have the shares of 1 / i^z, within a tenth."""
    total = sum(1 / i**z for i in range(1, top + 1))
    most = generators.zipf(spark, n, top, z).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(20)
    ranked = most.select("n", F.row_number().over(Window.orderBy(F.desc("n"), "key")).cast("bigint").alias("rank"))  # 20 rows
    return ranked.select("rank", (F.abs(F.col("n") * total * F.pow(F.col("rank").cast("double"), F.lit(z)) / n - 1) < 0.1).alias("within"))


def _placed(r: DataFrame) -> DataFrame:
    """Every row at twice its key."""
    return partitioning.placed(r.withColumn("place", F.col("key") * 2), 2 * r.agg(F.max("key")).first()[0] + 1)


def build() -> tuple[dict[str, Query], dict[str, str]]:
    q: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def add(name: str, query: Query, oracle: str | None = None) -> None:
        q[name] = query
        if oracle:
            sql[name] = oracle

    for name in joins.REGISTRY:
        if name == "NL":
            add("join_NL_count", lambda s, d: joins.join_count("NL", relation(table(s, d, "nation"), "n_nationkey"), customer_r(s, d).select(F.col("payload").alias("key"), F.col("key").alias("payload"))), "SELECT count(*) AS n_matches FROM nation JOIN customer ON n_nationkey = c_nationkey")
            add("join_NL_rows", lambda s, d: joins.join("NL", relation(table(s, d, "nation"), "n_nationkey", "n_regionkey"), customer_r(s, d).select(F.col("payload").alias("key"), F.col("key").alias("payload"))), "SELECT CAST(n_nationkey AS BIGINT) AS key, CAST(n_regionkey AS BIGINT) AS r_payload, c_custkey AS s_payload FROM nation JOIN customer ON n_nationkey = c_nationkey")
            continue
        empty = name == "CRKJ_po"
        add(f"join_{name}_count", lambda s, d, n=name: joins.join_count(n, orders_r(s, d), lineitem_s(s, d)), "SELECT CAST(0 AS BIGINT) AS n_matches" if empty else COUNT_SQL)
        if not empty:
            add(f"join_{name}_rows", lambda s, d, n=name: joins.join(n, orders_r(s, d), lineitem_s(s, d)), JOIN_SQL)
    add("join_CRKJ_po_partitions", lambda s, d: joins.join("CRKJ_po", orders_r(s, d), lineitem_s(s, d), joins.JoinConfig(radix_bits=BITS)), f"SELECT side, CAST(k & {(1 << BITS) - 1} AS INTEGER) AS pid, count(*) AS n FROM (SELECT 'r' AS side, o_orderkey AS k FROM orders UNION ALL SELECT 's', l_orderkey FROM lineitem) GROUP BY 1, 2")
    customer_orders = "SELECT count(*) AS n_matches FROM customer JOIN orders ON c_custkey = o_custkey"
    add("join_customer_orders_count", lambda s, d: joins.join_count("RHO", customer_r(s, d), orders_s(s, d)), customer_orders)
    few = joins.JoinConfig(memory_bytes=400_000, radix_bits=10)
    add("join_MCJoin_bounded_count", lambda s, d: joins.join_count("MCJoin", orders_r(s, d), lineitem_s(s, d), few), COUNT_SQL)
    add("join_PaMeCo_bounded_count", lambda s, d: joins.join_count("PaMeCo", orders_r(s, d), lineitem_s(s, d), few), COUNT_SQL)
    add("join_MCJoin_bounded_rows", lambda s, d: joins.join("MCJoin", orders_r(s, d), lineitem_s(s, d), few), JOIN_SQL)
    add("join_PaMeCo_bounded_rows", lambda s, d: joins.join("PaMeCo", orders_r(s, d), lineitem_s(s, d), few), JOIN_SQL)
    add("join_dynamic_bits_count", lambda s, d: joins.join_count("CRKJ", orders_r(s, d), lineitem_s(s, d), joins.JoinConfig(radix_bits=-1)), COUNT_SQL)
    dup = lambda s, d, t, c: table(s, d, t).select(F.col(c).cast("bigint").alias("key"), F.lit(1).cast("bigint").alias("payload"))
    add("join_dups_both_sides", lambda s, d: joins.join_count("RHO", dup(s, d, "customer", "c_nationkey"), dup(s, d, "supplier", "s_nationkey")), "SELECT count(*) AS n_matches FROM customer JOIN supplier ON c_nationkey = s_nationkey")
    add("join_split_skew_count", lambda s, d: joins.join_count("CRKJ", dup(s, d, "customer", "c_nationkey"), dup(s, d, "supplier", "s_nationkey"), joins.JoinConfig(radix_bits=3, hot_share=0.5)), "SELECT count(*) AS n_matches FROM customer JOIN supplier ON c_nationkey = s_nationkey")
    add("join_cardinality", lambda s, d: cardinality.join_cardinality(orders_r(s, d), lineitem_s(s, d)), "SELECT CAST(sum(h * w) AS BIGINT) AS n_matches FROM (SELECT o_orderkey AS k, count(*) AS h FROM orders GROUP BY 1) JOIN (SELECT l_orderkey AS k, count(*) AS w FROM lineitem GROUP BY 1) USING (k)")
    add("join_group_sizes", lambda s, d: cardinality.group_sizes(customer_r(s, d), orders_s(s, d)), "SELECT key, height, width FROM (SELECT c_custkey AS key, count(*) AS height FROM customer GROUP BY 1) JOIN (SELECT o_custkey AS key, count(*) AS width FROM orders GROUP BY 1) USING (key)")
    add("three_way_join", lambda s, d: joins.three_way(orders_r(s, d), lineitem_s(s, d), orders_r(s, d)), "SELECT t.o_orderkey AS key, t.o_custkey AS t_payload FROM orders t JOIN (SELECT o_orderkey AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey) ON t.o_orderkey = k")

    def pid(c):
        return f"CAST({c} & {(1 << BITS) - 1} AS INTEGER)"
    hist = f"SELECT {pid('l_orderkey')} AS pid, count(*) AS n FROM lineitem GROUP BY 1"
    add("radix_values", lambda s, d: lineitem_s(s, d).select("key", radix("key", BITS, 2).alias("radix")), f"SELECT l_orderkey AS key, CAST((l_orderkey >> 2) & {(1 << BITS) - 1} AS INTEGER) AS radix FROM lineitem")
    add("radix_histogram", lambda s, d: partitioning.histogram(lineitem_s(s, d), BITS), hist)
    add("radix_prefix_sum", lambda s, d: partitioning.prefix_sums(partitioning.histogram(lineitem_s(s, d), BITS)), f"SELECT pid, n, CAST(coalesce(sum(n) OVER (ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ({hist})")
    add("radix_partition_only", lambda s, d: partitioning.partition(lineitem_s(s, d), BITS).groupBy("pid").agg(F.count("*").alias("n")), hist)
    add("radix_sorted_chunks", lambda s, d: partitioning.sorted_chunks(orders_s(s, d), BITS), f"SELECT o_custkey AS key, o_orderkey AS payload, {pid('o_custkey')} AS pid FROM orders")
    add("repeat_rows", lambda s, d: partitioning.repeated(table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber"), "l_linenumber"), "SELECT l_orderkey AS key, l_linenumber, unnest(range(CAST(l_linenumber AS BIGINT))) AS copy FROM lineitem WHERE l_linenumber > 0")
    add("place_rows", lambda s, d: _placed(customer_r(s, d)), "SELECT r.range AS place, c_custkey AS key, CAST(c_nationkey AS BIGINT) AS payload FROM range((SELECT 2 * max(c_custkey) + 1 FROM customer)) r LEFT JOIN customer ON c_custkey * 2 = r.range")

    co = "FROM customer JOIN orders ON c_custkey = o_custkey"
    add("project_rp_key_sp", lambda s, d: projections.build_column_to_key(_joined(s, d), "c_nationkey"), f"SELECT c_nationkey AS key, o_orderkey AS payload {co}")
    add("project_sp_tuple", lambda s, d: projections.probe_column_to_key(_joined(s, d), "o_orderkey"), f"SELECT o_orderkey AS key, o_orderkey AS payload {co}")
    add("project_sp_sp", lambda s, d: projections.probe_payload_twice(_joined(s, d)), f"SELECT o_orderkey AS key, o_orderkey AS payload {co}")
    add("project_rk_sp", lambda s, d: projections.key_and_probe_payload(_joined(s, d)), f"SELECT c_custkey AS key, o_orderkey AS payload {co}")
    add("project_to_relation", lambda s, d: projections.to_relation(_joined(s, d)), f"SELECT c_custkey AS key, CAST(c_nationkey AS BIGINT) AS payload {co}")

    t = table
    w = _with_sql()
    add("filter_q3_customer", lambda s, d: t(s, d, "customer").filter(tpch.q3_customer()).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
    add("filter_q3_orders", lambda s, d: t(s, d, "orders").filter(tpch.q3_orders()).select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate < DATE '1995-03-15'")
    add("filter_q3_lineitem", lambda s, d: t(s, d, "lineitem").filter(tpch.q3_lineitem()).select("l_orderkey"), "SELECT l_orderkey FROM lineitem WHERE l_shipdate >= DATE '1995-03-16'")
    add("filter_q10_orders", lambda s, d: t(s, d, "orders").filter(tpch.q10_orders(*Q10_SHIFTED)).select("o_orderkey"), f"SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '{Q10_SHIFTED[0]}' AND o_orderdate < DATE '{Q10_SHIFTED[1]}'")
    add("filter_q10_lineitem", lambda s, d: t(s, d, "lineitem").filter(tpch.q10_lineitem()).select("l_orderkey"), "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
    add("filter_q12_lineitem", lambda s, d: _lineitem(s, d).filter(tpch.q12_lineitem(*Q12_SHIFTED)).select("l_orderkey", "l_linenumber"), w + f"SELECT l_orderkey, l_linenumber FROM l WHERE {_q12_where(*Q12_SHIFTED)}")
    add("filter_q19_lineitem", lambda s, d: _lineitem(s, d).filter(tpch.q19_lineitem()).select("l_partkey", "l_quantity"), w + f"SELECT l_partkey, l_quantity FROM l WHERE {Q19_LINE_WHERE}")
    add("filter_q19_part", lambda s, d: _part(s, d).filter(tpch.q19_part()).select("p_partkey"), w + f"SELECT p_partkey FROM p WHERE {_q19_part_where(None)}")
    add("filter_q19_match", lambda s, d: tpch.q19_rows(_part(s, d), _lineitem(s, d), 50).select("p_partkey", "p_brand", "p_container", "l_quantity"), _q19_sql(50).replace("count(*) AS n_rows", "p_partkey, p_brand, p_container, l_quantity"))

    add("tpch_q3", lambda s, d: tpch.q3(t(s, d, "customer"), t(s, d, "orders"), t(s, d, "lineitem")), Q3_SQL)
    add("tpch_q10", lambda s, d: tpch.q10(*(t(s, d, x) for x in ("customer", "orders", "nation", "lineitem"))), Q10_SQL.format(tpch.Q10_FROM, tpch.Q10_TO))
    add("tpch_q10_shifted", lambda s, d: tpch.q10(*(t(s, d, x) for x in ("customer", "orders", "nation", "lineitem")), *Q10_SHIFTED), Q10_SQL.format(*Q10_SHIFTED))
    q12 = lambda a, b: w + f"SELECT count(*) AS n_rows FROM orders JOIN l ON o_orderkey = l_orderkey WHERE {_q12_where(a, b)}"
    add("tpch_q12", lambda s, d: tpch.q12(t(s, d, "orders"), _lineitem(s, d)), q12(tpch.Q12_FROM, tpch.Q12_TO))
    add("tpch_q12_shifted", lambda s, d: tpch.q12(t(s, d, "orders"), _lineitem(s, d), *Q12_SHIFTED), q12(*Q12_SHIFTED))
    add("tpch_q19", lambda s, d: tpch.q19(_part(s, d), _lineitem(s, d)), _q19_sql(None))
    add("tpch_q19_wide", lambda s, d: tpch.q19(_part(s, d), _lineitem(s, d), 50), _q19_sql(50))
    add("tpch_q19_before_match", lambda s, d: tpch.q19_before_match(_part(s, d), _lineitem(s, d), 50), _q19_sql(50, match=False))

    g = generators
    add("gen_pk", lambda s, d: g.pk(s, 1000), "SELECT range + 1 AS key, range AS payload FROM range(1000)")
    add("gen_pk_shuffled", lambda s, d: g.pk(s, 1000, g.R_SEED).select("key"), "SELECT range + 1 AS key FROM range(1000)")
    add("gen_fk", lambda s, d: g.fk(s, 2500, 1000), "SELECT range % 1000 + 1 AS key, range AS payload FROM range(2500)")
    add("gen_fk_sel", lambda s, d: g.fk_selective(s, 2500, 500, 50), "SELECT CASE WHEN range < 2000 THEN range % 1000 + 1 ELSE (range - 2000) * 1000 // 500 + 1 END AS key, range AS payload FROM range(2500)")
    add("gen_fk_sel_zero", lambda s, d: g.fk_selective(s, 100, 500, 0), "SELECT CAST(0 AS BIGINT) AS key, range AS payload FROM range(100)")
    add("gen_zipf", lambda s, d: g.zipf(s, 10_000, 1000, 0.9).groupBy("key").agg(F.count("*").alias("n")))
    add("gen_uniform", lambda s, d: g.uniform(s, 10_000, 1000).groupBy("key").agg(F.count("*").alias("n")))
    add("gen_fk_from_pk", lambda s, d: g.tiled(orders_s(s, d).select(F.col("payload").alias("key"), F.col("payload")), 40_000).groupBy("key").agg(F.count("*").alias("n")), "SELECT key, count(*) AS n FROM (SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS k FROM orders) JOIN range(40000) r ON r.range % k = i GROUP BY key")
    add("gen_zipf_law", lambda s, d: _zipf_law(s), "SELECT range + 1 AS rank, true AS within FROM range(20)")
    add("gen_uniform_range", lambda s, d: g.uniform(s, 100_000, 1000).agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("n"), F.countDistinct("key").alias("keys")), "SELECT CAST(0 AS BIGINT) AS least, CAST(999 AS BIGINT) AS most, CAST(100000 AS BIGINT) AS n, CAST(1000 AS BIGINT) AS keys")
    add("gen_from_keys", lambda s, d: g.from_keys(orders_s(s, d).select(F.col("payload").alias("key"), F.col("payload")), 20_000), "SELECT key, r.range AS payload FROM (SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS k FROM orders) JOIN range(20000) r ON r.range % k = i")
    add("join_selectivity_count", lambda s, d: joins.join_count("RHO", g.pk(s, 500), g.fk_selective(s, 2000, 500, 50)), "SELECT CAST(1000 AS BIGINT) AS n_matches")

    tbl = lambda name, *c: (lambda s, d: _from_tbl(s, d, name, *c))
    add("read_tbl_lineitem", tbl("lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate", "l_commitdate", "l_receiptdate", "l_shipinstruct", "l_shipmode"), w + "SELECT l_orderkey, l_partkey, l_quantity, l_returnflag, CAST(l_shipdate AS DATE) AS l_shipdate, l_commitdate, l_receiptdate, l_shipinstruct, l_shipmode FROM l")
    add("read_tbl_orders", tbl("orders", "o_orderkey", "o_custkey", "o_orderdate"), "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
    add("read_tbl_customer", tbl("customer", "c_custkey", "c_nationkey", "c_mktsegment"), "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment FROM customer")
    add("read_tbl_part", tbl("part", "p_partkey", "p_brand", "p_size", "p_container"), w + "SELECT p_partkey, p_brand, CAST(p_size AS BIGINT) AS p_size, p_container FROM p")
    add("read_tbl_nation", tbl("nation", "n_nationkey", "n_name"), "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
    add("count_lines", lambda s, d: s.range(1).select(F.lit(files.count_lines(s, _as_tbl(s, d, "orders"))).cast("bigint").alias("n_lines")), "SELECT count(*) AS n_lines FROM orders")
    add("read_key_file", lambda s, d: files.read_keys(s, _key_file(s, d)), "SELECT CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_custkey END AS key, CAST(0 AS BIGINT) AS payload FROM customer")
    add("sort_relation", lambda s, d: order.sort_relation(orders_s(s, d)), "SELECT o_custkey AS key, o_orderkey AS payload FROM orders ORDER BY 1, 2")
    first = "SELECT min(p) IS NULL AS is_sorted, min(p) AS first_violation FROM (SELECT {k} AS k, {p} AS p, lag({k}) OVER (ORDER BY {p}) AS b FROM {t}) WHERE k < b"
    add("is_sorted", lambda s, d: order.first_violation(orders_s(s, d)), first.format(k="o_custkey", p="o_orderkey", t="orders"))
    add("is_sorted_true", lambda s, d: order.first_violation(relation(t(s, d, "customer"), "c_custkey")), first.format(k="c_custkey", p="c_custkey", t="customer"))
    add("output_size", lambda s, d: sinks.output_bytes(joins.join("RHO", orders_r(s, d), lineitem_s(s, d))), "SELECT count(*) AS n_rows, count(*) * 12 AS n_bytes FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
    add("is_sorted_gaps", lambda s, d: order.first_violation(orders_s(s, d).select("key", (F.col("payload") * 10).alias("payload"))), first.format(k="o_custkey", p="o_orderkey * 10", t="orders"))
    add("sample_rows", lambda s, d: sinks.sample(orders_s(s, d), 20, 10), "SELECT o_custkey AS key, o_orderkey AS payload FROM orders ORDER BY 1, 2 LIMIT 20 OFFSET 10")

    add("seal_roundtrip", lambda s, d: sealing.unseal(sealing.seal(orders_r(s, d), KEY), KEY), "SELECT o_orderkey AS key, o_custkey AS payload FROM orders")
    add("sealed_join", lambda s, d: sealing.unseal(sealing.sealed_join(sealing.seal(orders_r(s, d), KEY), sealing.seal(lineitem_s(s, d), KEY), KEY), KEY), "SELECT o_orderkey AS key, o_custkey AS payload FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
    add("sealed_three_way", lambda s, d: sealing.unseal(sealing.sealed_three_way(*(sealing.seal(x, KEY) for x in (customer_r(s, d), orders_s(s, d), customer_r(s, d))), KEY), KEY), "SELECT c_custkey AS key, CAST(c_nationkey AS BIGINT) AS payload FROM customer JOIN orders ON c_custkey = o_custkey")
    packed = f"SELECT CAST(ceil(count(*) / {{per}}) AS BIGINT) AS n_chunks, CAST(count(*) * {sealing.ROW_BYTES} + ceil(count(*) / {{per}}) * {sealing.CHUNK_BYTES} AS BIGINT) AS n_bytes FROM orders"
    add("sealed_bytes", lambda s, d: sealing.sealed_bytes(sealing.seal(orders_r(s, d), KEY)), packed.format(per="4096.0"))
    add("sealed_chunk_bytes", lambda s, d: sealing.sealed_bytes(sealing.seal(orders_r(s, d), KEY, chunk_bytes=8192)), packed.format(per="512.0"))
    one = "SELECT CAST({i} AS INTEGER) AS query_id, '{n}' AS name, ({q}) AS n_matches"
    add("concurrent_joins", _concurrent, " UNION ALL ".join(one.format(i=i, n=n, q=customer_orders) for i, n in enumerate(("RHO", "CRKJ", "MJ", "PaMeCo"))))
    counts = {"q3": Q3_SQL, "q10": Q10_SQL.format(*Q10_SHIFTED), "q12": q12(*Q12_SHIFTED), "q19": _q19_sql(50)}
    add("concurrent_queries", _concurrent_queries, " UNION ALL ".join(one.format(i=i, n=n, q=counts[n]) for i, n in enumerate([*counts, *counts])))
    return q, sql
