"""Exact deduplication by a 128-bit content hash, with the bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_of=content_hash) -> DataFrame:
    """One row per row of docs: its id, the id that stays for its text, and how many rows share the text.

    Rows are grouped by a 128-bit hash of the whole text. While the groups are summed, the set of texts of each
    is kept as well, which compares the bytes of every member, on the map side first: a group with a third
    of all rows reaches the reducer as one row and one text per task. Groups in which two texts share a hash are
    split again by the text itself.

    keep: "min" (the smallest id stays) or "max". A null text counts as the empty text. A null id is
    larger than none: it stays only if the whole group has null ids. Rows repeated with the same id are all
    members; those that carry keep_id are all marked kept (ids are taken to be unique). An empty table gives
    an empty table. Only id_col and text_col are read, so other columns may have any names.
    Returns id_col, keep_id, group_size, kept, text_sha256.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep is 'min' or 'max', not {keep!r}")
    best = F.min if keep == "min" else F.max
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    groups = written(
        rows.withColumn("_h", hash_of(F.col("_text")))
        .groupBy("_h")
        .agg(best("_id").alias("_keep"), F.count("*").alias("_n"), F.collect_set("_text").alias("_texts"))
        .select("_h", "_keep", "_n", (F.size("_texts") > 1).alias("_mixed")),
        "exact-groups",
    )
    members = rows.select("_id", hash_of(F.col("_text")).alias("_h"), F.sha2("_text", 256).alias("text_sha256"))
    out = members.join(groups.filter(~F.col("_mixed")).hint("merge"), "_h").select("_id", "_keep", "_n", "text_sha256")
    if not groups.filter("_mixed").isEmpty():
        clash = rows.withColumn("_h", hash_of(F.col("_text"))).join(groups.filter("_mixed").select("_h"), "_h", "left_semi").select("_id", "_text")
        split = clash.groupBy("_text").agg(best("_id").alias("_keep"), F.count("*").alias("_n"))
        out = out.unionByName(clash.join(split, "_text").select("_id", "_keep", "_n", F.sha2("_text", 256).alias("text_sha256")))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """docs without the rows whose text another row has that stays; all columns as they were.

    Of rows that share both the text and the id that stays, one stays. Cases as in exact_groups.
    """
    groups = exact_groups(docs, id_col, text_col, keep).filter("kept").select(F.col(id_col).alias("_k"), F.col("text_sha256").alias("_s"))
    named = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_i"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_h"))
    staying = named.join(groups.hint("merge"), F.col("_i").eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_s")), "left_semi")
    return staying.dropDuplicates(["_i", "_h"]).select("_row.*")
