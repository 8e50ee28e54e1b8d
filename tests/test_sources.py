from __future__ import annotations

import math
from collections import Counter

import pytest

from joinwright.functions import memory, order, radix
from joinwright.operators import joins, sealing
from joinwright.sources import files, generators, shared, sinks


def keys(df):
    return [r["key"] for r in df.orderBy("payload").collect()]


def test_keys_by_rule(spark):
    assert keys(generators.pk(spark, 7)) == list(range(1, 8))
    assert sorted(keys(generators.pk(spark, 1000, 5))) == list(range(1, 1001))
    assert keys(generators.pk(spark, 1000, 5)) != list(range(1, 1001))
    assert keys(generators.fk(spark, 7, 3)) == [1, 2, 3, 1, 2, 3, 1]
    assert Counter(keys(generators.fk(spark, 70, 30, 9))) == Counter(i % 30 + 1 for i in range(70))
    assert keys(generators.fk_selective(spark, 10, 2, 50)) == [1, 2, 3, 4, 1, 2, 3, 4, 1, 3]
    assert set(keys(generators.fk_selective(spark, 5, 2, 0))) == {0}
    with pytest.raises(ValueError):
        generators.fk_selective(spark, 5, 2, 101)


def test_selectivity(spark):
    r = generators.pk(spark, 100)
    assert joins.join_count("RHO", r, generators.fk_selective(spark, 200, 100, 50)).first()[0] == 100
    assert joins.join_count("RHO", r, generators.fk_selective(spark, 50, 100, 0)).first()[0] == 0
    assert joins.join_count("RHO", r, generators.fk(spark, 333, 100)).first()[0] == 333


@pytest.mark.parametrize("z", [0.5, 1.0, 1.3])
def test_zipf_shares(spark, z):
    n, top = 60_000, 500
    seen = Counter(keys(generators.zipf(spark, n, top, z)))
    assert set(seen) <= set(range(1, top + 1))
    total = sum(1 / i**z for i in range(1, top + 1))
    ranked = sorted(seen.values(), reverse=True)
    for i in (1, 2, 5, 10):
        assert ranked[i - 1] == pytest.approx(n / i**z / total, rel=0.15)
    assert sum(ranked[:100]) == pytest.approx(n * sum(1 / i**z for i in range(1, 101)) / total, rel=0.03)


def test_tiles(spark):
    base = spark.createDataFrame([(5, 0), (9, 1), (7, 2)], "key long, payload long")
    assert Counter(map(tuple, generators.tiled(base, 7).collect())) == Counter({(5, 0): 3, (9, 1): 2, (7, 2): 2})
    assert keys(generators.from_keys(base, 5)) == [5, 9, 7, 5, 9]
    with pytest.raises(ValueError):
        generators.tiled(base.limit(0), 3)


def test_numbers_are_dense_in_many_partitions(spark):
    keys = generators.pk(spark, 20_000, 5).repartition(16)
    for name, value in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k"), ("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k"), ("spark.sql.shuffle.partitions", "16")):
        spark.conf.set(name, value)
    try:
        dense = shared.numbered(keys, "payload", "key")
        rows = sorted((r["i"], r["payload"]) for r in dense.collect())
        assert [i for i, _ in rows] == list(range(20_000)) and [p for _, p in rows] == sorted(p for _, p in rows)
        assert sorted(r["i"] for r in shared.numbered(keys).collect()) == list(range(20_000))
        tiled = Counter(r["key"] for r in generators.tiled(keys, 50_000).collect())
        assert tiled.total() == 50_000 and set(tiled.values()) == {2, 3}
        assert len({r["payload"] for r in generators.from_keys(keys, 30_000).collect()}) == 30_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_written_tables_are_deleted_when_discarded(spark):
    t = shared.written(spark.range(5), "test")
    assert t.count() == 5 and t._written_at.removeprefix("file://")
    shared.discard(t, None)
    from pathlib import Path

    assert not Path(t._written_at.removeprefix("file://")).exists()


def test_uniform_and_precedence(spark, tmp_path):
    assert all(0 <= k < 10 for k in keys(generators.uniform(spark, 100, 10)))
    (tmp_path / "k.txt").write_text("12\nx\n 7 junk\n\n4294967295\n")
    assert sorted(r["key"] for r in generators.probe_side(spark, 3, 3, str(tmp_path / "k.txt"), 1.0).collect()) == [0, 0, 7, 12, 4294967295]
    assert files.count_lines(spark, str(tmp_path / "k.txt")) == 5


def test_tbl(spark, tmp_path):
    (tmp_path / "customer.tbl").write_text('1|a|"x|y"|3|p|1.5|BUILDING|"say ""hi"""|\n2||addr|4|p|2|AUTO|c|\n')
    rows = files.read_tbl(spark, str(tmp_path / "customer.tbl"), "customer").orderBy("c_custkey").collect()
    assert (rows[0]["c_address"], rows[0]["c_comment"], rows[0]["c_nationkey"]) == ("x|y", 'say "hi"', 3)
    assert rows[1]["c_name"] is None and rows[1]["c_mktsegment"] == "AUTO"
    (tmp_path / "lineitem.tbl").write_text("1|2|3|4|5.0|6|0.1|0.2|R|F|1995-03-16|1995-03-17|1995-03-18|NONE|AIR|c|\n")
    row = files.read_tbl(spark, str(tmp_path / "lineitem.tbl"), "lineitem", ["l_shipdate", "l_shipmode"]).first()
    assert (str(row[0]), row[1]) == ("1995-03-16", "AIR")
    assert files.tbl_path("part", 1) == "data/scale01/part.tbl"


def test_schemas_follow_the_files(spark, tmp_path):
    import os

    for i, columns in enumerate(("1 AS a", "1 AS a, 'x' AS b")):
        spark.sql(f"SELECT {columns}").write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
        os.utime(tmp_path / "t.parquet", (i + 1, i + 1))
        for _ in range(2):
            assert files.table(spark, str(tmp_path), "t").columns == ["a", "b"][: i + 1] and files.table(spark, str(tmp_path), "t").count() == 1


def test_order(spark):
    r = spark.createDataFrame([(3, 0), (5, 1), (4, 2), (1, 3)], "key long, payload long")
    assert tuple(order.first_violation(r).first()) == (False, 2)
    assert tuple(order.first_violation(r.limit(0)).first()) == (True, None)
    gaps = spark.createDataFrame([(3, 10), (5, 20), (4, 30)], "key long, payload long")
    assert tuple(order.first_violation(gaps).first()) == (False, 30)
    many = spark.createDataFrame([(i if i != 700 else 3, 7 * i) for i in range(1000)], "key long, payload long").repartition(9)
    assert tuple(order.first_violation(many).first()) == (False, 4900)
    assert [x["key"] for x in order.sort_relation(r).collect()] == [1, 3, 4, 5]


def test_sinks(spark, tmp_path):
    r = generators.pk(spark, 10)
    j = joins.join("RHO", r, r)
    sinks.log_matches(j, str(tmp_path / "log"))
    sinks.log_matches(j, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log")).count() == 20
    sinks.save_relation(r, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 10
    assert tuple(sinks.output_bytes(j).first()) == (10, 120)
    assert [x["key"] for x in sinks.sample(r, 2, 3).collect()] == [4, 5]


def test_radix_helpers():
    assert radix.radix_bits(2**21, 1) == 3 and radix.radix_bits(10, 16) == 4


def test_memory_plan():
    for x in (0.1, 1.0, 5.0, 1e3, 1e12):
        w = memory.lambert_w(x)
        assert w * math.exp(w) == pytest.approx(x, rel=1e-9)
    for bits, room in ((10, 1 << 16), (14, 1 << 20), (24, 1 << 28)):
        n = memory.most_rows(room, bits)
        assert n * (32 - bits + math.log2(n)) <= 8 * room * (1 + 1e-6) and (n + 2) * (32 - bits + math.log2(n + 2)) > 8 * room
    assert memory.plan_chunks(1000, 1000, 0).chunks == 1
    p = memory.plan_chunks(10_000_000, 10_000_000, 8 << 20, bits=16)
    assert p.chunks == math.ceil(10_000_000 / p.chunk_rows) > 1
    assert memory.histogram_bytes(memory.plan_chunks(10, 10, 1 << 16, 20, histogram_share=0.25).radix_bits) <= 1 << 14
    with pytest.raises(ValueError):
        memory.plan_chunks(10, 10, 1 << 10, 24)


def test_sealing(spark):
    key, r = bytes(16), generators.pk(spark, 50)
    sealed = sealing.seal(r, key, chunk_rows=7).cache()
    assert sealed.count() == 8
    small = sealing.seal(spark.createDataFrame([(2**32 - 1, -5), (0, 2**63 - 1)], r.schema), key, chunk_bytes=16)
    assert small.count() == 2 and sorted(map(tuple, sealing.unseal(small, key).collect())) == [(0, 2**63 - 1), (2**32 - 1, -5)]
    assert tuple(sealing.sealed_bytes(sealing.seal(r.limit(0), key)).first()) == (0, 0)
    assert sorted(map(tuple, sealing.unseal(sealed, key).collect())) == sorted(map(tuple, r.collect()))
    with pytest.raises(Exception, match="AES|CANNOT_DECRYPT|INVALID_PARAMETER"):
        sealing.unseal(sealed, key, "other").collect()
    flipped = sealed.selectExpr("chunk", "unhex(concat(substring(hex(blob), 1, 60), CASE substring(hex(blob), 61, 1) WHEN '0' THEN '1' ELSE '0' END, substring(hex(blob), 62))) AS blob")
    with pytest.raises(Exception, match="AES|CANNOT_DECRYPT|INVALID_PARAMETER"):
        sealing.unseal(flipped, key).collect()
    with pytest.raises(ValueError):
        sealing.seal(r, b"short")


def test_partitions(spark):
    from joinwright.operators import partitioning

    r = generators.pk(spark, 100)
    assert sum(x["n"] for x in partitioning.partition_sizes(partitioning.partition(r, 3)).collect()) == 100
    counts = {x["pid"]: (x["n"], x["start"]) for x in partitioning.prefix_sums(partitioning.histogram(r, 3)).collect()}
    at = 0
    for pid in range(8):
        n = sum(k & 7 == pid for k in range(1, 101))
        assert counts[pid] == (n, at)
        at += n
