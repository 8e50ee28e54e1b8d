"""A corpus from raw documents to token ids, in five stages of the llm subpackage.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinwright.llm import bpe, exact_dedup, langid, mixing, near_dedup
from joinwright.llm.queries import vocabulary
from joinwright.llm.scratch import new_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, with it in lang; those without a letter, or that read like no language learned, go.

    Null ids are in the training fold, null and empty texts go, repeated rows stay, an empty table gives an empty one.
    """
    held_out = F.coalesce(langid.fold("doc_id") == 2, F.lit(False))
    return langid.keep_identified(docs, langid.training_text(docs.filter(~held_out), "doc_id", "text", "lang"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the largest doc_id, as op7_exact_dedup keeps it. A null text counts as empty, a null id stays only where its text
    has no other; an empty table gives an empty one."""
    return exact_dedup.drop_exact(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the smallest doc_id. The stage before left no text twice, but for null ids and texts without a word.

    Cases as in near_dedup.drop_near().
    """
    return near_dedup.drop_near(docs, distinct=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. A null source is a source of its own; other cases as in mixing.copies()."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with digests of them and of the text that they decode to. A null text counts as empty and has no ids."""
    return bpe.round_trip(docs, vocabulary(), with_ids=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("bpe", tokens)]

#: No SQL states consistent sampling, dependent rounding or BPE; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = new_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return docs
