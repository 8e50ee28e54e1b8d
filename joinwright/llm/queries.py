"""The queries of the operators, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, langid, mixing, near_dedup, pii, quality, sharding, warc
from .scratch import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(langid.fold("doc_id") == 2, F.lit(False))
    sample = langid.training_text(docs.filter(~held_out), "doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), sample)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_char")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.expand(turns.unionByName(probe))).withColumnRenamed("conv", "conv_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(_table(spark, sf_dir, "documents"))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents"), 40)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="max")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary())


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    records = warc.record_bytes(warc.read_archive(spark, path))
    back = warc.resolved(warc.parse_records(records))
    return back.select(F.col("id").alias("page_id"), F.col("length").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that SQL states."""
    base = quality.features(_table(spark, sf_dir, "documents"))
    return base.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of op5."""
    taken = mixing.copies(_table(spark, sf_dir, "documents"))
    return taken.groupBy("source", "source_size").agg(F.round(F.max("target"), 3).alias("target"), F.count("*").alias("n"))


def sharding_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes that op6 places."""
    return sharding.shard(_table(spark, sf_dir, "documents"), 40).select(F.col("id").alias("doc_id"), "size")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeds that op9 counts."""
    found = pii.entities(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *[F.size(k).cast("bigint").alias(f"n_{k}") for k in pii.KINDS])


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_quality_rules": op2_quality_rules,
    "op3_near_dedup": op3_near_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_bpe": op8_bpe,
    "op9_pii": op9_pii,
    "op10_warc_archive": op10_warc_archive,
    "quality_base": quality_base,
    "mixing_targets": mixing_targets,
    "sharding_sizes": sharding_sizes,
    "pii_base": pii_base,
}


def _escaped(x: str) -> str:
    """SQL: x as chat.escape() gives it."""
    x = f"replace({x}, '\\', '\\\\')"
    for c in (chat.BOS, chat.EOS, chat.OPEN, chat.CLOSE):
        x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
    return x


ORACLE_SQL = {
    "op4_chat_formatting": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
                   UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        l AS (SELECT *, {len(chat.OPEN + chat.CLOSE) + 1} + length(replace({_escaped("r")}, chr(10), chr(92) || chr(10))) + length({_escaped("t")}) AS n FROM c),
        s AS (SELECT *, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS final
              FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn, r, t))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
               CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
               CAST(sum(CASE WHEN r = 'assistant' OR final THEN {len(chat.BOS + chat.EOS)} + upto END) AS BIGINT) AS formatted_chars
        FROM s GROUP BY conv_id
    """,
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op10_warc_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n,
                          max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
        SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
        FROM p
    """,
    "quality_base": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM d, unnest(range(1, len(w) - 1)) u(i)),
        m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM g),
        c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM m, range(3) r(k) WHERE n > 1 GROUP BY doc_id),
        l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
               CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
    """,
    "mixing_targets": r"""
        WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS size, count(*) AS n FROM documents GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
        w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * size AS cap FROM r),
        b AS (SELECT *, sum(size) OVER () - coalesce(sum(cap) OVER o, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS share
              FROM w WINDOW o AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT source, size AS source_size, round(least(CAST(cap AS DOUBLE), max(CAST(rest AS DOUBLE) / share) OVER () * weight), 3) AS target, n FROM b
    """,
    "sharding_sizes": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size FROM documents",
    "pii_base": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        e AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS m FROM d) GROUP BY 1),
        i AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, string_split(unnest(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')), '.') AS p FROM d)
              WHERE greatest(try_cast(p[1] AS HUGEINT), try_cast(p[2] AS HUGEINT), try_cast(p[3] AS HUGEINT), try_cast(p[4] AS HUGEINT)) <= 255 GROUP BY 1),
        c0 AS (SELECT doc_id, row_number() OVER () AS k, x FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+')), '[^0-9]', '', 'g') AS x FROM d) WHERE length(x) BETWEEN 12 AND 19),
        c1 AS (SELECT doc_id, k, sum(CASE WHEN j % 2 = 0 THEN v WHEN v > 4 THEN 2 * v - 9 ELSE 2 * v END) AS s
               FROM (SELECT doc_id, k, j, CAST(substr(x, length(x) - j, 1) AS INTEGER) AS v FROM c0, range(19) r(j) WHERE j < length(x)) GROUP BY doc_id, k),
        c AS (SELECT doc_id, count(*) AS n FROM c1 WHERE s % 10 = 0 GROUP BY 1),
        p AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]')) AS m FROM d)
              WHERE length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15 GROUP BY 1)
        SELECT doc_id, coalesce(e.n, 0) AS n_email, coalesce(i.n, 0) AS n_ip, coalesce(c.n, 0) AS n_card, coalesce(p.n, 0) AS n_phone
        FROM d LEFT JOIN e USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN p USING (doc_id)
    """,
}
