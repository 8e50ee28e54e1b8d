"""Relations made by rule: primary keys, foreign keys, foreign keys of given selectivity, skewed and uniform keys.

Payloads are row numbers. Relations come in row order unless `seed` is given: then keys are dealt to rows in another order, by a
permutation that needs no sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import numbered

R_SEED, S_SEED = 11111, 22222


def _coprime(n: int, seed: int) -> int:
    a = 1 + (seed * 2654435761 + 12345) % max(1, n)
    while math.gcd(a, n) != 1:
        a += 1
    return a % n or 1


def _permuted(i: Column, n: int, seed: int | None) -> Column:
    """A permutation of 0..n-1: affine, with a factor that shares none with n."""
    if seed is None or n < 2:
        return i
    # decimals keep the product exact
    product = i.cast("decimal(20,0)") * F.lit(_coprime(n, seed)).cast("decimal(18,0)") + F.lit(seed % n)
    return (product % F.lit(n).cast("decimal(18,0)")).cast("bigint")


def pk(spark: SparkSession, n: int, seed: int | None = None) -> DataFrame:
    """Keys 1..n once each."""
    return spark.range(n).select((_permuted(F.col("id"), n, seed) + 1).alias("key"), F.col("id").alias("payload"))


def fk(spark: SparkSession, n: int, max_id: int, seed: int | None = None) -> DataFrame:
    """n keys that run through 1..max_id again and again."""
    return spark.range(n).select((_permuted(F.col("id"), n, seed) % max_id + 1).alias("key"), F.col("id").alias("payload"))


def selectivity_range(r_rows: int, selectivity: int) -> int:
    """The range of foreign keys of which `selectivity` percent meet a primary key of 1..r_rows; 0 if none shall."""
    return 100 * r_rows // selectivity if selectivity else 0


def fk_selective(spark: SparkSession, n: int, r_rows: int, selectivity: int, seed: int | None = None) -> DataFrame:
    """n keys, of which about `selectivity` percent are in 1..r_rows: whole runs through the range, then m keys evenly spaced in it."""
    if not 0 <= selectivity <= 100:
        raise ValueError("selectivity is a percentage")
    top = selectivity_range(r_rows, selectivity)
    if not top:
        return spark.range(n).select(F.lit(0).cast("bigint").alias("key"), F.col("id").alias("payload"))
    whole = n // top * top
    m, i = max(1, n - whole), _permuted(F.col("id"), n, seed)
    spaced = F.floor((i - whole).cast("decimal(20,0)") * F.lit(top).cast("decimal(18,0)") / F.lit(m)).cast("bigint")
    return spark.range(n).select(F.when(i < whole, i % top + 1).otherwise(spaced + 1).cast("bigint").alias("key"), F.col("id").alias("payload"))


def zipf(spark: SparkSession, n: int, max_id: int, z: float, seed: int = S_SEED, head: int = 32) -> DataFrame:
    """n keys of 1..max_id, of which the i-th most frequent has a share that goes as 1 / i^z.

    The first `head` ranks are drawn from their exact shares, the others by inverting the integral of 1 / x^z, which is within 1e-4 of
    the sum from there on: no table of max_id shares is needed. Ranks are dealt to keys by a permutation.
    """
    head = min(head, max_id)
    exact = [1 / i**z for i in range(1, head + 1)]
    low, high = head + 0.5, max_id + 0.5
    integral = lambda x: math.log(x) if z == 1 else x ** (1 - z) / (1 - z)
    tail = integral(high) - integral(low) if max_id > head else 0.0
    total, sums, at = sum(exact) + tail, [], 0.0
    for e in exact:
        at += e
        sums.append(at)
    drawn = spark.range(n).select(F.col("id").alias("payload"), (F.rand(seed) * total).alias("u"))
    u = F.col("u") - sums[-1]
    back = F.exp(u + math.log(low)) if z == 1 else F.pow(u * (1 - z) + low ** (1 - z), F.lit(1 / (1 - z)))
    in_head = F.size(F.filter(F.array(*[F.lit(x) for x in sums]), lambda x: x <= F.col("u")))
    rank = F.when(F.col("u") < sums[-1], in_head).otherwise(F.least(F.lit(max_id - 1), F.greatest(F.lit(head), F.round(back) - 1))).cast("bigint")
    return drawn.select((_permuted(rank, max_id, seed) + 1).alias("key"), "payload")


def uniform(spark: SparkSession, n: int, max_id: int, seed: int = S_SEED) -> DataFrame:
    """n keys drawn evenly from 0..max_id - 1."""
    return spark.range(n).select(F.floor(F.rand(seed) * max_id).cast("bigint").alias("key"), F.col("id").alias("payload"))


def tiled(keys: DataFrame, n: int) -> DataFrame:
    """n rows: those of keys in order, again and again; payloads travel along."""
    dense = numbered(keys.select("key", "payload"), "payload", "key", what="tiles")
    k = dense.count()
    if not k:
        raise ValueError("there are no keys to tile")
    rows = keys.sparkSession.range(n).select((F.col("id") % k).alias("i"))
    return rows.join(dense, "i").select("key", "payload")


def from_keys(keys: DataFrame, n: int) -> DataFrame:
    """n rows numbered by payload whose keys run through those of keys in order, again and again."""
    dense = numbered(keys.select("key", "payload"), "payload", "key", what="choices")
    k = dense.count()
    if not k:
        raise ValueError("there are no keys to choose from")
    rows = keys.sparkSession.range(n).select((F.col("id") % k).alias("i"), F.col("id").alias("row"))
    return rows.join(dense, "i").select("key", F.col("row").alias("payload"))


def probe_side(spark: SparkSession, n: int, r_rows: int, path: str | None = None, skew: float = 0.0, selectivity: int = 100, seed: int | None = None) -> DataFrame:
    """S by precedence: a key file, else skewed keys, else selective keys, else foreign keys."""
    from .files import read_keys

    if path:
        return read_keys(spark, path)
    if skew > 0:
        return zipf(spark, n, r_rows, skew, S_SEED if seed is None else seed)
    if selectivity != 100:
        return fk_selective(spark, n, r_rows, selectivity, seed)
    return fk(spark, n, r_rows, seed)
