"""Command line: one join, a three-way join, several at once, or one of the query pipelines.

    python -m joinwright.cli join -a RHO -r 1000000 -s 4000000
    python -m joinwright.cli query -q 3 --data /path/to/tables
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from . import metrics
from .operators import joins, sealing
from .plans import concurrent, tpch
from .schema import DATA_SETS
from .sources import files, generators


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="joinwright", description="Equi-joins on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    j = sub.add_parser("join", help="join generated or read relations")
    j.add_argument("-a", "--algorithm", default="RHO", choices=sorted(joins.REGISTRY))
    j.add_argument("-d", "--dataset", choices=sorted(DATA_SETS), help="C and D take key columns of the tables in --data")
    j.add_argument("--data", help="folder of Parquet tables, or of .tbl files with --scale")
    j.add_argument("--scale", type=int)
    j.add_argument("-r", "--r-size", type=int, default=1 << 21)
    j.add_argument("-s", "--s-size", type=int, default=1 << 21)
    j.add_argument("-t", "--t-size", type=int, default=1 << 21)
    j.add_argument("-n", "--threads", type=int, default=8)
    j.add_argument("-b", "--bits", type=int, default=13, help="-1 chooses by the size of R")
    j.add_argument("-m", "--memory-mb", type=int, default=0, help="of the chunked joins; 0 for no bound")
    j.add_argument("-x", "--r-seed", type=int)
    j.add_argument("-y", "--s-seed", type=int)
    j.add_argument("-z", "--skew", type=float, default=0.0)
    j.add_argument("-l", "--selectivity", type=int, default=100)
    j.add_argument("-q", "--queries", type=int, default=1, help="joins at once")
    j.add_argument("-p", "--delay-ms", type=int, default=0)
    j.add_argument("-c", "--chunk-kb", type=int, default=0, help="KB of a sealed chunk; 0 seals in chunks of 4096 rows")
    j.add_argument("-k", "--cracking-threshold", type=int, default=1, help="radix partitions of S with fewer rows are never split")
    j.add_argument("-e", "--log-matches", metavar="PATH")
    j.add_argument("--materialize", metavar="PATH", help="write the joined rows here")
    j.add_argument("--r-path", help="key file of R")
    j.add_argument("-u", "--s-path", help="key file of S")
    j.add_argument("--sort-r", action="store_true")
    j.add_argument("--sort-s", action="store_true")
    j.add_argument("--seal", metavar="HEXKEY")
    j.add_argument("--three-way-join", action="store_true")
    j.add_argument("--repetitions", type=int, default=1)
    q = sub.add_parser("query", help="a query pipeline")
    q.add_argument("-q", "--query", type=int, nargs="+", default=[12], choices=[3, 10, 12, 19])
    q.add_argument("--data", required=True, help="folder of Parquet tables, or of .tbl files with --scale")
    q.add_argument("--scale", type=int)
    return p


def _table(spark: SparkSession, a: argparse.Namespace, name: str) -> DataFrame:
    return files.read_tbl(spark, files.tbl_path(name, a.scale, a.data), name) if a.scale is not None else files.table(spark, a.data, name)


def _relations(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    of = DATA_SETS.get(a.dataset)
    if of and of.r_column:
        if not a.data:
            raise SystemExit(f"data set {a.dataset} needs --data")
        r, s = (files.relation(_table(spark, a, t), c) for t, c in (of.r_column, of.s_column))
        return (r.orderBy("key") if a.sort_r else r), (s.orderBy("key") if a.sort_s else s)
    if of:
        a.r_size, a.s_size = of.r_rows, of.s_rows
    r = files.read_keys(spark, a.r_path) if a.r_path else generators.pk(spark, a.r_size, a.r_seed)
    s = generators.probe_side(spark, a.s_size, a.r_size, a.s_path, a.skew, a.selectivity, a.s_seed)
    return (r.orderBy("key") if a.sort_r else r), (s.orderBy("key") if a.sort_s else s)


def run_join(spark: SparkSession, a: argparse.Namespace) -> list[dict]:
    cfg = joins.JoinConfig(threads=a.threads, radix_bits=a.bits, memory_bytes=a.memory_mb << 20, split_rows=a.cracking_threshold)
    r, s = _relations(spark, a)
    key = bytes.fromhex(a.seal) if a.seal else None
    if a.three_way_join:
        t = generators.fk(spark, a.t_size, a.s_size)
        if key:
            sealed = [sealing.seal(x, key, chunk_bytes=a.chunk_kb << 10 or None) for x in (r, s, t)]
            result = lambda: sealing.unseal(sealing.sealed_three_way(*sealed, key, cfg), key)
        else:
            result = lambda: joins.three_way(r, s, t, cfg)
    elif key:
        sealed = [sealing.seal(x, key, chunk_bytes=a.chunk_kb << 10 or None) for x in (r, s)]
        result = lambda: sealing.unseal(sealing.sealed_join(*sealed, key, a.algorithm, cfg), key)
    else:
        result = lambda: joins.join(a.algorithm, r, s, cfg)
    if a.materialize:
        result().write.mode("overwrite").parquet(a.materialize)
    if a.log_matches:
        from .sources.sinks import log_matches

        log_matches(joins.join(a.algorithm, r, s, cfg), a.log_matches)
    rows = r.count() + s.count()
    if a.queries > 1:
        tasks = [concurrent.Task(a.algorithm, lambda: joins.join_count(a.algorithm, r, s, cfg), rows) for _ in range(a.queries)]
        return [x.asDict() for x in concurrent.run(spark, tasks, a.delay_ms).collect()]
    m = metrics.measure(result, rows, a.repetitions)
    return [{"algorithm": a.algorithm, "n_matches": m.count, "seconds": m.seconds, "million_rows_per_second": m.million_rows_per_second}]


def run_queries(spark: SparkSession, a: argparse.Namespace) -> list[dict]:
    def t(name: str) -> DataFrame:
        df = _table(spark, a, name)
        return tpch.with_derived(df, 0) if name == "lineitem" else tpch.with_derived(df, 1) if name == "part" else df

    each = {
        3: lambda: tpch.q3(t("customer"), t("orders"), t("lineitem")),
        10: lambda: tpch.q10(t("customer"), t("orders"), t("nation"), t("lineitem")),
        12: lambda: tpch.q12(t("orders"), t("lineitem")),
        19: lambda: tpch.q19(t("part"), t("lineitem")),
    }
    return [x.asDict() for x in concurrent.run(spark, [concurrent.Task(f"q{n}", each[n]) for n in a.query]).collect()]


def main(argv: list[str] | None = None) -> list[dict]:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    out = run_join(spark, a) if a.command == "join" else run_queries(spark, a)
    for row in out:
        print(json.dumps(row))
    return out


if __name__ == "__main__":
    main()
