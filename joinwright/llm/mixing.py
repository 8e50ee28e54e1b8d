"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be copied target / source size times. The whole part is given to
all; the fractional parts are rounded by the pivotal method: two documents with fractional copies meet,
and words move from one to the other, in a random direction whose odds keep each document's expected
copies, until one of the two is integral. The words taken from the source stay the same at every meeting.
Chunks of a source are rounded side by side, each in one pass that holds a single open document; what
is left open of each chunk meets in a reduction tree, and the last one open of a source is rounded to the nearer
number. So a source's words miss its target by half a document at most. Large documents meet first, so that the
last is seldom one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import numbered, shipped, written
from .words import word_count

_MASK = (1 << 64) - 1
_EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sizes (source, source_size, n) with the words that each source shall give (target) and its rank.

    Sources in code point order, null last, weigh as in weights, repeating. All words are shared by weight; a source that would give more
    than most times its own stops there, and what is over is shared again by weight among the others, until none is above. With f the
    words per unit of weight, target = min(most * size, f * weight); f only grows from turn to turn. A turn is one sum over
    the sources, whatever their number, and sources are ranked by range partitions.
    """
    ranked = numbered(sizes, F.col("source").asc_nulls_last(), name="rank", what="mix-ranked")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * most).cast("long"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    f, stopped = 0.0, -1
    while True:
        above = F.col("cap") < F.lit(f) * F.col("weight")
        held, weight, n = ranked.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if n == stopped or not weight:
            break
        f, stopped = (total - (held or 0)) / weight, n
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(f) * F.col("weight"))).select("source", "source_size", "n", "rank", "target")


def _coin(a: int, b: int, level: int) -> float:
    """A number in [0, 1) that depends on its arguments only (a 64-bit finaliser of public record)."""
    z = (a * 0x9E3779B97F4A7C15 + (b ^ level) * 0xC2B2AE3D27D4EB4F + level) & _MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return ((z ^ (z >> 31)) >> 11) / (1 << 53)


def meet(sa: int, xa: float, sb: int, xb: float, coin: float) -> tuple[float, float]:
    """The fractional copies of two documents of sa and sb words after they met: one is 0 or 1, xa * sa + xb * sb is as before."""
    up, down = min((1 - xa) * sa, xb * sb), min(xa * sa, (1 - xb) * sb)
    moved = up if coin * (up + down) < down else -down
    xa, xb = xa + moved / sa, xb - moved / sb
    snap = lambda x: 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
    return snap(xa), snap(xb)


def _round(level: int, root: bool):
    """Rounds rows that come with those of a (rank, chunk) together: one open row is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # [rank, chunk, h, size, x, row]
        at: dict[str, int] = {}
        schema = None

        def closed(r: list) -> tuple:
            return (*r[5][:-2], float(r[4] >= 0.5) if root else r[4], not root)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for b in batches:
            schema = b.schema
            at = {c: i for i, c in enumerate(schema.names)}
            out = []
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                rank, chunk, h, size, x = (row[at[c]] for c in ("rank", "chunk", "h", "size", "x"))
                if held and (held[0], held[1]) != (rank, chunk):
                    out.append(closed(held))
                    held = None
                if held is None:
                    held = [rank, chunk, h, size, x, row]
                else:
                    xa, xb = meet(held[3], held[4], size, x, _coin(held[2], h, level))
                    both = ([*held[:4], xa, held[5]], [rank, chunk, h, size, xb, row])
                    out += [(*r[5][:-2], r[4], False) for r in both if r[4] in (0.0, 1.0)]
                    held = next((r for r in both if r[4] not in (0.0, 1.0)), None)
            yield batch(out)
        if held:
            yield batch([closed(held)])

    return run


_SCHEMA = "id {id}, source {source}, same long, size long, source_size long, target double, whole long, rank long, chunk long, h long, x double, open boolean"


def _copies(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int, seed: int, chunk_rows: int, fan_in: int) -> DataFrame:
    """As copies(), with `same`, a hash of the text."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("same"))
    # Rows that repeat are counted before they move and told apart by their number, so that not even they share a chunk.
    sized = written(sized.groupBy("id", "source", "size", "same").agg(F.count("*").alias("m")), "mix-sizes")
    shares = written(targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).cast("long").alias("source_size"), F.sum("m").alias("n")), weights, most), "mix-targets")
    shares_named = shares.select(F.col("source").alias("s"), "source_size", "target", "rank", F.ceil(F.col("n") / chunk_rows).alias("chunks"))
    each = sized.join(shares_named.hint("merge"), F.col("source").eqNullSafe(F.col("s"))).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = F.xxhash64(F.lit(seed), "id", "size", "source", "same", "k")
    part = per - F.floor(per)
    coin = F.pmod(F.xxhash64(F.lit(1), key), F.lit(1 << 32)) / float(1 << 32)
    settled = F.when(part <= _EPS, 0.0).when(part >= 1 - _EPS, 1.0).when(F.col("size") == 0, F.when(coin < part, 1.0).otherwise(0.0))
    each = each.select(
        "id", "source", "same", "size", "source_size", "target", F.floor(per).cast("long").alias("whole"), "rank", F.pmod(key, "chunks").alias("chunk"), key.alias("h"),
        F.coalesce(settled, part).alias("x"), settled.isNull().alias("open"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in sized.schema}
    schema = _SCHEMA.format(id=kinds["id"], source=kinds["source"])
    chunks = shares_named.agg(F.max("chunks")).first()[0] or 1
    level, rounded, each = 0, [each.filter(~F.col("open"))], each.filter("open")
    while True:
        root = chunks <= 1
        dealt = each.repartition("rank", "chunk").sortWithinPartitions("rank", "chunk", F.desc("size"), "h", "id")
        done = written(shipped(dealt).mapInArrow(_round(level, root), schema), f"mix-level{level}")
        rounded.append(done.filter(~F.col("open")))
        if root:
            break
        each = done.filter("open").withColumn("chunk", F.floor(F.col("chunk") / fan_in).cast("long"))
        chunks, level = -(-chunks // fan_in), level + 1
    whole = rounded[0]
    for more in rounded[1:]:
        whole = whole.unionByName(more)
    return whole.select("id", "source", "same", "size", "source_size", "target", (F.col("whole") + F.round("x").cast("long")).alias("copies"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 7, chunk_rows: int = 1024, fan_in: int = 64) -> DataFrame:
    """How often the mix takes each row of docs: id, source, size, source_size, target, copies.

    Size is the number of words of the text (null: 0). A null source is a source of its own. A text without words is
    taken as often as its source's documents on average, which adds no words. Choices depend on seed, id, text
    and source alone, so a rerun, or a run over the same rows in other partitions, takes the same. Rows that
    repeat are rounded one by one. Only rows with a fraction of a copy go to Python: chunk_rows rows of a source are rounded in one pass, fan_in
    open rows meet at each level of the tree. An empty table gives an empty table. Other columns are not read.
    """
    return _copies(docs, id_col, text_col, source_col, weights, most, seed, chunk_rows, fan_in).drop("same")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 7, chunk_rows: int = 1024, fan_in: int = 64) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; all columns as they were. Cases as in copies().

    Rows of one id, source and text share their copies evenly.
    """
    taken = _copies(docs, id_col, text_col, source_col, weights, most, seed, chunk_rows, fan_in)
    taken = written(taken.groupBy("id", "source", "same").agg(F.sum("copies").alias("copies"), F.count("*").alias("m")), "mix-taken")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("i"), F.col(source_col).alias("s"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    on = F.col("i").eqNullSafe(F.col("id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("t") == F.col("same"))
    repeat = lambda df, n: df.select("row", F.explode(F.sequence(F.lit(1), n.cast("int")))).select("row.*")
    out = repeat(rows.join(taken.filter("m = 1 AND copies > 0").hint("merge"), on), F.col("copies"))
    several = taken.filter("m > 1 AND copies > 0")
    if not several.isEmpty():
        nth = F.row_number().over(Window.partitionBy("i", "s", "t").orderBy(F.lit(0)))
        each = rows.join(several.hint("merge"), on).withColumn("n", F.floor(F.col("copies") / F.col("m")) + F.when(nth <= F.col("copies") % F.col("m"), 1).otherwise(0))
        out = out.unionByName(repeat(each.filter("n > 0"), F.col("n")))
    return out
