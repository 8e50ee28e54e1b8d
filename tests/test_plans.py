from __future__ import annotations

import datetime
import os

import duckdb
import pytest

import __spark_entry__
from joinwright import cli, metrics
from joinwright.operators import joins
from joinwright.plans import catalog, concurrent, tpch
from joinwright.sources import generators
from joinwright.streaming import probe

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.build()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def normal(v):
    return round(v, 6) if isinstance(v, float) else v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols, want = sorted(df.columns), duck.sql(SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    mine = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert mine == sorted((tuple(normal(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).first()["n_rows"] == 44
    assert set(catalog.build()[0]) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


BRANCH_CASES = [
    ("Brand#12", "SM PKG", 5, 11, "AIR", 1), ("Brand#12", "SM PKG", 6, 11, "AIR", 0), ("Brand#23", "MED BAG", 10, 10, "AIR REG", 1), ("Brand#23", "MED BAG", 10, 21, "AIR", 0),
    ("Brand#34", "LG BOX", 15, 30, "AIR", 1), ("Brand#34", "SM BOX", 1, 25, "AIR", 0), ("Brand#12", "SM CASE", 1, 5, "REG AIR", 0),
]


@pytest.mark.parametrize("case", BRANCH_CASES)
def test_q19_branches(spark, case):
    brand, container, size, quantity, mode, n = case
    part = spark.createDataFrame([(1, brand, container, size)], "p_partkey long, p_brand string, p_container string, p_size int")
    line = spark.createDataFrame([(1, float(quantity), mode, "DELIVER IN PERSON")], "l_partkey long, l_quantity double, l_shipmode string, l_shipinstruct string")
    assert tpch.q19(part, line).first()[0] == n


def test_selections_reach_the_scan(spark, sf):
    plan = QUERIES["tpch_q3"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan


def test_concurrent(spark):
    r, s = generators.pk(spark, 100), generators.fk(spark, 300, 100)
    tasks = [concurrent.Task(n, lambda n=n: joins.join_count(n, r, s), 400) for n in ("RHO", "MJ", "CRKJS")]
    rows = concurrent.run(spark, tasks, delay_ms=5).collect()
    assert [(x["query_id"], x["n_matches"]) for x in rows] == [(0, 300), (1, 300), (2, 300)]
    assert concurrent.mean_throughput(concurrent.run(spark, tasks)).first()[0] > 0
    assert concurrent.run(spark, []).count() == 0


def test_metrics(spark):
    r = generators.pk(spark, 100)
    m = metrics.measure(lambda: joins.join("RHO", r, r), 200, 2)
    assert m.count == 100 and m.million_rows_per_second > 0
    p = metrics.measure_phases({"r": r}, lambda c: joins.join("RHO", c["r"], c["r"]))
    assert p.count == 100 and set(p.phases) == {"selection", "join"}


def test_stream(spark, tmp_path):
    r, s = generators.pk(spark, 20), generators.fk(spark, 60, 30)
    s.repartition(3).write.parquet(str(tmp_path / "s"))
    stream = probe.probe(r, probe.read_relation_stream(spark, str(tmp_path / "s"), 1))
    q = stream.writeStream.format("memory").queryName("probed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, joins.join("RHO", r, s).collect()))
    assert sorted(map(tuple, spark.table("probed").collect())) == want


def test_cli(spark, sf, tmp_path):
    assert cli.main(["join", "-a", "CRKJ", "-r", "100", "-s", "300", "--materialize", str(tmp_path / "out")])[0]["n_matches"] == 300
    assert spark.read.parquet(str(tmp_path / "out")).count() == 300
    assert cli.main(["join", "-r", "10", "-s", "20", "-t", "40", "--three-way-join"])[0]["n_matches"] == 40
    assert cli.main(["join", "-r", "10", "-s", "20", "--seal", "00" * 16])[0]["n_matches"] == 20
    assert [x["n_matches"] for x in cli.main(["join", "-r", "10", "-s", "20", "-q", "2"])] == [20, 20]
    assert cli.main(["join", "-d", "C", "--data", sf])[0]["n_matches"] == 6000 and cli.main(["join", "-d", "D", "--data", sf, "-k", "100"])[0]["n_matches"] == 1500
    (tmp_path / "s.txt").write_text("1\n1\n9\n")
    assert cli.main(["join", "-r", "5", "-u", str(tmp_path / "s.txt"), "-c", "1", "--seal", "00" * 16])[0]["n_matches"] == 2
    assert cli.main(["query", "-q", "3", "--data", sf])[0]["n_matches"] == 44


def test_without_the_llm_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/joinwright", tmp_path / "joinwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [k for k in e.queries() if k.startswith('op') or k == 'pipeline'])"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split(" ", 1)[1].strip() == '[]' and int(done.stdout.split()[0]) == len(QUERIES)
