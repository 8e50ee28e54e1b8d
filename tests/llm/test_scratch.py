from __future__ import annotations

import zipfile
from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa
import pytest

from joinwright.llm import near_dedup, scratch
from pyspark.sql import functions as F


class Conf(dict):
    set = dict.__setitem__


def session(master: str, **conf):
    own = Conf(conf)
    return SimpleNamespace(conf=own, sparkContext=SimpleNamespace(master=master, getConf=lambda: {}))


def test_the_folder_named_is_used():
    named = {"spark.checkpoint.dir": "viewfs://store/scratch/"}
    assert scratch.shared_dir(session("spark://host:7077", **named)) == "viewfs://store/scratch"


def test_a_cluster_without_one_is_refused():
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            scratch.shared_dir(session(master))


def test_local_mode_sets_its_own_once():
    s = session("local[2]")
    assert scratch.shared_dir(s) == scratch.shared_dir(s) and Path(scratch.shared_dir(s).removeprefix("file://")).is_dir()


def test_written_tables_keep_rows_and_names(spark):
    df = spark.createDataFrame([(1, "a", [1]), (None, None, None)], "a long, b string, c array<int>")
    back = scratch.written(df, "test")
    assert back.columns == df.columns and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_the_package_is_sent_once():
    sent = []
    df = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(addPyFile=sent.append)))
    assert scratch.shipped(scratch.shipped(df)) is df and len(sent) == 1
    names = zipfile.ZipFile(sent[0]).namelist()
    assert "joinwright/__init__.py" in names and "joinwright/llm/bpe.py" in names


def test_a_worker_keeps_no_model_of_the_operator_before(spark):
    """A worker that near dedup takes over from language identification lets go of its model."""

    def keeps(batches):
        scratch.held("model", lambda: bytes(1000))
        yield from batches

    def left(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([len(scratch._held)], pa.int64())], names=["n"])

    one = scratch.shipped(spark.range(1).coalesce(1))
    one.mapInArrow(keeps, "id long").collect()
    near_dedup._counts(one.select(F.lit("a b c d e f").alias("text")), "text", 5)
    assert [r["n"] for r in one.mapInArrow(left, "n long").collect()] == [0]
