from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from joinwright.operators import cardinality, joins
from joinwright.schema import RELATION
from pyspark.sql import functions as F

NAMES = [n for n in joins.REGISTRY if n != "CRKJ_po"]
CASES = {
    "pk x fk": (range(1, 9), [*range(1, 9)] * 2, 16),
    "no overlap": (range(1, 5), range(5, 9), 0),
    "empty r": ([], range(1, 5), 0),
    "empty s": (range(1, 5), [], 0),
    "duplicates": ([1, 1, 2], [1, 1, 1, 2], 7),
    "zero and largest": ([0, 2**32 - 1], [0, 0, 2**32 - 1], 3),
    "sparse": ([1, 1_000_000], [1_000_000, 7], 1),
    "odd sizes": (range(1, 6), [*range(1, 6), 1, 2], 7),
    "hot": (range(1, 17), [3] * 1000 + [*range(1, 17)], 1016),
}


def relation(spark, keys):
    return spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)], RELATION)


def brute(r, s) -> Counter:
    return Counter((k, i, j) for i, k in enumerate(r) for j, x in enumerate(s) if k == x)


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("name", sorted({joins.REGISTRY[n]: n for n in NAMES}.values()))
def test_cases(spark, name, case):
    r, s, n = CASES[case]
    rows = Counter(map(tuple, joins.join(name, relation(spark, r), relation(spark, s)).collect()))
    assert rows == brute(r, s)
    assert rows.total() == n


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(r=st.lists(st.integers(0, 12), max_size=20), s=st.lists(st.integers(0, 12), max_size=30), name=st.sampled_from(NAMES))
def test_bags(spark, r, s, name):
    cfg = joins.JoinConfig(radix_bits=2, hot_share=0.5)
    a, b = relation(spark, r), relation(spark, s)
    assert Counter(map(tuple, joins.join(name, a, b, cfg).collect())) == brute(r, s)
    assert cardinality.join_cardinality(a, b).first()[0] == brute(r, s).total()


def plan_of(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "node"), [("RHO", "ShuffledHashJoin"), ("MJ", "SortMergeJoin"), ("PHT", "BroadcastHashJoin"), ("NL", "CartesianProduct"), ("CRKJS", "ShuffledHashJoin"), ("CRKJF", "ShuffledHashJoin"), ("PaMeCo", "ShuffledHashJoin"), ("MCJoin", "SortMergeJoin")])
def test_plans(spark, name, node):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(joins.join(name, relation(spark, range(50)), relation(spark, range(100))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert node in plan


def test_radix_join_reuses_its_partitioning(spark):
    plan = plan_of(joins.join("CRKJS", relation(spark, range(50)), relation(spark, range(100)))).split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 2


def test_chunked_joins_read_s_for_each_chunk(spark):
    cfg = joins.JoinConfig(memory_bytes=2000, radix_bits=6)
    r, s = relation(spark, range(3000)), relation(spark, [*range(0, 4000, 3), 5, 5])
    for name in ("MCJoin", "PaMeCo"):
        joined = joins.join(name, r, s, cfg)
        assert 1 < joined._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") <= cfg.scans
        assert joined.count() == 1002


@pytest.mark.parametrize(("name", "cfg"), [("MCJoin", joins.JoinConfig(memory_bytes=2000, radix_bits=6)), ("PaMeCo", joins.JoinConfig(memory_bytes=2000, radix_bits=6)), ("BHJ", joins.JoinConfig(broadcast_rows=10, radix_bits=6))])
def test_no_task_reads_several_chunks(spark, name, cfg):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.join(name, relation(spark, range(3000)), relation(spark, [*range(0, 4000, 3), 5, 5]), cfg)
        n = joined._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")
        chunks = joined.select(F.spark_partition_id().alias("task"), F.pmod(F.xxhash64("key"), F.lit(n)).alias("chunk")).distinct().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len({x["chunk"] for x in chunks}) == n > 1
    assert len({x["task"] for x in chunks}) == len(chunks)


def test_hot_partitions_are_split(spark):
    cfg = joins.JoinConfig(radix_bits=4)
    s = relation(spark, [3] * 3000 + [*range(1, 17)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "part" in plan_of(joins.join("CRKJ", relation(spark, range(1, 17)), s, cfg)).split("Initial Plan")[0]
        assert "explode" not in plan_of(joins.join("CRKJ", relation(spark, range(1, 17)), s, joins.JoinConfig(radix_bits=4, split_rows=4000)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for bits in (4, 14):
        assert joins.join_count("CRKJ", relation(spark, range(1, 17)), s, joins.JoinConfig(radix_bits=bits)).first()[0] == 3016


def test_broadcast_checks_size(spark):
    cfg = joins.JoinConfig(broadcast_rows=10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "ShuffledHashJoin" in plan_of(joins.join("PHT", relation(spark, range(50)), relation(spark, range(100)), cfg))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bounds_and_names(spark):
    r = relation(spark, range(10))
    with pytest.raises(ValueError, match="no join is named"):
        joins.join("none", r, r)
    with pytest.raises(ValueError, match="refused"):
        joins.join("NL", r, r, joins.JoinConfig(nested_loop_pairs=99))
    for wrong in ({"threads": 3}, {"radix_bits": 25}, {"memory_bytes": -1}):
        with pytest.raises(ValueError):
            joins.JoinConfig(**wrong)
    assert joins.join_count("CRKJ_po", r, r).first()[0] == 0
    assert sorted(map(tuple, joins.join("CRKJ_po", r, r.limit(3), joins.JoinConfig(radix_bits=1)).collect())) == [("r", 0, 5), ("r", 1, 5), ("s", 0, 2), ("s", 1, 1)]


def test_three_way(spark):
    r, s, t = relation(spark, range(1, 5)), relation(spark, [1, 1, 2]), relation(spark, [1, 2, 2])
    rows = Counter(map(tuple, joins.three_way(r, s, t).collect()))
    assert rows == Counter({(1, 0): 2, (2, 1): 1, (2, 2): 1})
