"""Relations encrypted at rest: AES-GCM with associated data, in the JVM.

Sealed rows reveal their number and the chunk size, nothing else; a changed byte or other associated data fails the opening. It is no
attestation of the machine that computes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import numbered
from .joins import JoinConfig, join, three_way
from .projections import to_relation

AAD = "sealed-relation"
ROW_BYTES = 16
#: What encryption adds to a chunk: a vector of 12 bytes, a tag of 16.
CHUNK_BYTES = 28


def _encrypt(plain: Column, key: bytes, aad: str) -> Column:
    iv = F.lit(b"")
    return F.aes_encrypt(plain, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), iv, F.lit(aad.encode()))


def seal(r: DataFrame, key: bytes, aad: str = AAD, chunk_rows: int = 4096, chunk_bytes: int | None = None) -> DataFrame:
    """(chunk, blob): rows of a relation in chunks of chunk_rows (the last one of fewer), or of as many as chunk_bytes bytes hold; each is
    encrypted as one. Keys are 16, 24 or 32 bytes.

    A row is packed in ROW_BYTES bytes. Rows are numbered in a written table, so that a task which runs again chunks alike; a chunk's rows
    meet in one task, so its size bounds the memory.
    """
    if len(key) not in (16, 24, 32):
        raise ValueError("the key must have 16, 24 or 32 bytes")
    if chunk_bytes is not None:
        chunk_rows = max(1, chunk_bytes // ROW_BYTES)
    packed = F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("key", "payload")])
    dense = numbered(r.select("key", "payload"), what="sealing")
    grouped = dense.select(F.floor(F.col("i") / chunk_rows).cast("bigint").alias("chunk"), packed.alias("row")).groupBy("chunk").agg(F.collect_list("row").alias("rows"))
    return grouped.select("chunk", _encrypt(F.unhex(F.array_join("rows", "")), key, aad).alias("blob"))


def sealed_bytes(sealed: DataFrame) -> DataFrame:
    """One row: n_chunks, n_bytes."""
    return sealed.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum(F.octet_length("blob")), F.lit(0)).cast("bigint").alias("n_bytes"))


def unseal(sealed: DataFrame, key: bytes, aad: str = AAD) -> DataFrame:
    """(key, payload); the query fails if a blob was changed or sealed with another key or other associated data."""
    plain = F.hex(F.aes_decrypt("blob", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad.encode())))
    row = sealed.select(F.explode(F.regexp_extract_all(plain, F.lit(f"[0-9A-F]{{{2 * ROW_BYTES}}}"), F.lit(0))).alias("x"))
    number = lambda at: F.conv(F.substring("x", at, 16), 16, -10).cast("bigint")
    return row.select(number(1).alias("key"), number(17).alias("payload"))


def sealed_join(r: DataFrame, s: DataFrame, key: bytes, name: str = "RHO", cfg: JoinConfig | None = None, aad: str = AAD) -> DataFrame:
    """Sealed R and S to the sealed relation of (key, R's payload)."""
    return seal(to_relation(join(name, unseal(r, key, aad), unseal(s, key, aad), cfg)), key, aad)


def sealed_three_way(r: DataFrame, s: DataFrame, t: DataFrame, key: bytes, cfg: JoinConfig | None = None, aad: str = AAD) -> DataFrame:
    """Sealed R, S and T to the sealed relation of (key, T's payload)."""
    joined = three_way(unseal(r, key, aad), unseal(s, key, aad), unseal(t, key, aad), cfg)
    return seal(joined.withColumnRenamed("t_payload", "payload"), key, aad)
