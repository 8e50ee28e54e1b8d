"""Near-duplicate groups by consistent weighted sampling over TF-IDF weighted word shingles.

1. Document frequencies of shingles are summed over all distinct texts in a table of fixed size (one row of a count-min sketch,
   less the load that a bucket has on average), so that copies don't make what they hold common. A shingle that fewer than one in a hundred texts have counts
   as that rare, so edits to a small family don't change the weights of what it shares.
2. Each distinct text is sampled bands * rows times: a sample is the shingle of least a = c / (y e^r), with r, c, beta drawn per
   shingle and sample, y = e^(r (t - beta)), t = floor(ln w / r + beta). Two texts draw the same sample with the probability of their
   weighted Jaccard similarity. Weights have 128 values and the draws come from a table, so a is looked up.
3. Samples are hashed in bands; texts that share a band meet in a bucket. Every member is compared with the bucket's leader by the
   exact weighted Jaccard similarity of their whole texts, and linked if it's at least the threshold. Leaders change from bucket to
   bucket and from round to round. A bucket is closed when its members are all connected, or when distances rule out further
   links: distance is a metric, so two members whose distances from a leader differ by more than the limit are no link. After some
   rounds, what is left is compared member by member where the classes differ. For that, buckets of many members are dealt anew by prefixes: with a text's
   shingles in one order for all, rarest first, two texts that are linked share one of the first, which weigh as much as a link may miss. So texts that
   share a passage that many have don't meet for its sake.
4. Links are joined into classes by contracting them round by round; links found later join the classes, not their members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, release, shipped, written
from .shingles import counted, mix64, shingles, slices
from .words import WORD

BUCKETS, CHUNK = 1 << 20, 1 << 12
FLOOR = 1e-2
#: Bytes of text that a block of members has at most, if it has more than one.
BLOCK_BYTES = 8_000_000
TABLE_BITS = 14
#: Weight of an idf level (16) and a term frequency class (8: 1, 2-3, 4-7, ... 128 and more).
WEIGHTS = np.array([(1 + q / 15) * (1 + 0.7 * t) for q in range(16) for t in range(8)])
_TF_CLASS = np.array([0, *(min(7, int(math.log2(x))) for x in range(1, 256))], np.int64)


def _key(text_col: str) -> Column:
    """What tells texts apart: 128 bits of SHA-256. A null text counts as the empty text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)), 1, 16)


def _counts(docs: DataFrame, text_col: str, width: int) -> tuple[np.ndarray, int]:
    """In how many texts the shingles of each of the BUCKETS buckets of hashes are, and how many texts have shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        table, texts = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for _, _, d, o in slices(batch.column(0)):
                u, _, ptr = counted(*shingles(d, o, width))
                table += np.bincount((u >> np.uint64(44)).astype(np.int64), minlength=BUCKETS)
                texts += int((np.diff(ptr) > 0).sum())
        if texts:
            rows = [table[i : i + CHUNK].astype(np.uint32).tobytes() for i in range(0, BUCKETS, CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(rows)), pa.int32()), pa.array([np.array([texts], np.uint32).tobytes(), *rows], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(counts, np.uint32).astype(np.int64)
                sums[chunk] = sums[chunk] + more if chunk in sums else more
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    parts = docs.select(text_col).mapInArrow(count, "chunk int, counts binary").repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect()  # BUCKETS + 1 numbers
    table, n = np.zeros(BUCKETS), 0
    for chunk, counts in parts:
        if chunk < 0:
            n = int(np.frombuffer(counts, np.int64)[0])
        else:
            table[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(counts, np.int64)
    return table, n


def _frequencies(docs: DataFrame, text_col: str, width: int) -> bytes:
    """The idf level (0 to 15) of each of the BUCKETS buckets of shingle hashes, one byte each."""
    table, n = _counts(docs, text_col, width)
    share = np.maximum((table - table.mean()) / max(n, 1), max(FLOOR, 1 / max(n, 1)))
    level = np.log(share) / math.log(FLOOR)
    return np.clip(np.rint(level * 15), 0, 15).astype(np.uint8).tobytes()


class Weigher:
    """Distinct shingles of texts with their weight levels."""

    def __init__(self, levels: bytes, width: int):
        self.levels, self.width = np.frombuffer(levels, np.uint8), width

    def __call__(self, d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, tf, ptr = counted(*shingles(d, o, self.width))
        level = self.levels[(u >> np.uint64(44)).astype(np.int64)].astype(np.int64) * 8 + _TF_CLASS[np.minimum(tf, 255)]
        return u, level, ptr


@lru_cache(maxsize=1)
def _draws() -> np.ndarray:
    """By weight level and table entry: ln a as a number that sorts alike, in the upper 32 bits."""
    rng = np.random.default_rng(4243)
    n = 1 << TABLE_BITS
    r, c, beta = rng.gamma(2, 1, n), rng.gamma(2, 1, n), rng.random(n)
    t = np.floor(np.log(WEIGHTS)[:, None] / r + beta)
    a = (np.log(c) - r * (t - beta) - r).astype(np.float32).view(np.uint32)
    a = np.where(a >> np.uint32(31), ~a, a | np.uint32(1 << 31)).astype(np.uint64)
    return (a << np.uint64(32)).ravel()


def band_hashes(u: np.ndarray, level: np.ndarray, ptr: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The band hashes (texts x bands) of texts that have shingles, in order."""
    table, rng = _draws(), np.random.default_rng(611)
    turn = rng.integers(0, 1 << 64, bands * rows, dtype=np.uint64) | np.uint64(1)
    fold = rng.integers(0, 1 << 64, rows, dtype=np.uint64) | np.uint64(1)
    own = np.flatnonzero(ptr[:-1] < ptr[1:])
    out = np.empty((bands * rows, len(own)), np.uint64)
    shift, low = np.uint64(64 - TABLE_BITS), np.uint64(0xFFFFFFFF)
    block = (ptr[own] // 65536) if len(own) else own
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(own)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if i == j:
            continue
        s, e = ptr[own[i]], ptr[own[j - 1] + 1]
        x, base, tie, starts = u[s:e], level[s:e] << TABLE_BITS, u[s:e] & low, ptr[own[i:j]] - s
        for k in range(bands * rows):
            at = ((x * turn[k]) >> shift).view(np.int64) + base
            key = table.take(at)
            key |= tie
            out[k, i:j] = np.minimum.reduceat(key, starts)
    banded = out.reshape(bands, rows, len(own))
    summed = (banded * fold[None, :, None]).sum(axis=1) + np.arange(1, bands + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    return mix64(summed).T


def _signatures(texts: DataFrame, levels, width: int, bands: int, rows: int) -> DataFrame:
    """texts (same, rep, text) as same, rep, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        weigh = Weigher(levels.value, width)
        for batch in batches:
            for s, e, d, o in slices(batch.column(2)):
                u, level, ptr = weigh(d, o)
                hashes = band_hashes(u, level, ptr, bands, rows).astype(np.int64, copy=False).view(np.int64)
                own = ptr[:-1] < ptr[1:]
                offsets = np.concatenate(([0], np.cumsum(own * bands))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(hashes).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), batch.column(1).slice(s, e - s), lists], names=["same", "rep", "bands"])

    return texts.select("same", "rep", "text").mapInArrow(run, f"same binary, rep {texts.schema['rep'].dataType.simpleString()}, bands array<long>")


def _steps(docs: DataFrame, text_col: str, width: int) -> bytes:
    """How common the shingles of each of the BUCKETS buckets are among docs, in steps of a twelfth of a doubling, one byte each."""
    return np.minimum(255, np.rint(12 * np.log2(1 + _counts(docs, text_col, width)[0]))).astype(np.uint8).tobytes()


def prefix(u: np.ndarray, level: np.ndarray, threshold: float, common: np.ndarray | None = None) -> np.ndarray:
    """The shingles of a text of which it shares one at least with every text that is as similar as threshold, or more.

    Shingles are in one order for all texts: by how common they are where that is told, then by idf, rarest first, then by hash. What two texts share lies from the first shared one on, and a link needs threshold times the
    weight of either text; so the first shared one comes before what is left weighs less.
    """
    order = np.lexsort((u, -(level >> 3)) if common is None else (u, -(level >> 3), common))
    weight = WEIGHTS[level[order]]
    before = np.cumsum(weight) - weight
    return u[order[before <= (1 - threshold) * weight.sum() + 1e-9]]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts' (distinct shingles, levels)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(WEIGHTS[a[1][i]], WEIGHTS[b[1][j]]).sum()
    return float(least / (WEIGHTS[a[1]].sum() + WEIGHTS[b[1]].sum() - least)) if len(a[0]) and len(b[0]) else 0.0


def _vectors(text: pa.Array, weigh: Weigher) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for _, _, d, o in slices(text):
        u, level, ptr = weigh(d, o)
        out += [(u[s:e], level[s:e]) for s, e in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
    return out


def _compared(pairs: DataFrame, texts: DataFrame, levels, width: int) -> DataFrame:
    """pairs (a, b) of text ids with their similarity."""
    one = texts.select(F.col("id").alias("b"), F.col("text").alias("tb")).hint("merge")
    two = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")).hint("merge")
    both = pairs.join(one, "b").join(two, "a").select("a", "b", "ta", "tb")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        weigh = Weigher(levels.value, width)
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                part = batch.slice(s, 64)
                sims = [similarity(x, y) for x, y in zip(_vectors(part.column(2), weigh), _vectors(part.column(3), weigh), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    return both.mapInArrow(run, f"a {kind}, b {kind}, sim double")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the least id that links (a, b) connect each linked id with, as a written table.

    Each round an id goes twice to the neighbour that is first in that round's order of hashes, or stays if it is first itself; links then hold between the
    ids gone to, those within one fall away and equal ones are one. So a constant part of the ids and links is left from round to round, whatever the ids of a chain.
    """
    edges = lambda x, a, b, what: written(x.filter(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.lit(1).alias("one")).drop("one"), what)
    left = edges(links, "a", "b", "near-links")
    ends = left.select(F.explode(F.array("a", "b")).alias("id")).unionByName(links.filter("a = b").select(F.col("a").alias("id")))
    held, round_no = written(ends.groupBy("id").agg(F.first("id").alias("label")), "near-labels"), 0
    while not left.isEmpty():
        place = lambda c: F.struct(F.xxhash64(F.lit(round_no), c).alias("at"), F.col(c).alias("to"))
        near = left.select(F.col("a").alias("v"), place("b").alias("p")).unionByName(left.select(F.col("b").alias("v"), place("a").alias("p")))
        one = written(near.groupBy("v").agg(F.min("p").alias("p")).select("v", F.least("p", place("v"))["to"].alias("next")), "near-steps")
        step = written(one.join(one.select(F.col("v").alias("next"), F.col("next").alias("to")).hint("merge"), "next").select("v", "to"), "near-steps")
        of = lambda c: step.select(F.col("v").alias(c), F.col("to").alias(f"to_{c}")).hint("merge")
        fewer = edges(left.join(of("a"), "a").join(of("b"), "b"), "to_a", "to_b", "near-links")
        moved = held.join(of("label"), "label", "left").select("id", F.coalesce("to_label", "label").alias("label"))
        moved = written(moved, "near-labels")
        discard(left, held, one, step)
        left, held, round_no = fewer, moved, round_no + 1
    least = held.groupBy("label").agg(F.min("id").alias("least"))
    out = written(held.join(least.hint("merge"), "label").select("id", F.col("least").alias("label")), "near-labels")
    discard(left, held)
    return out


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, label) as further links (a, b) between labels, or ids that have none yet, join them; as a written table. Only classes that the links name are joined anew."""
    more = components(links)
    to = more.select(F.col("id").alias("of"), F.col("label").alias("least")).hint("merge")
    out = labels.join(to, F.col("label") == F.col("of"), "full_outer").select(F.coalesce("id", "of").alias("id"), F.coalesce("least", "label").alias("label"))
    out = written(out, "near-merged")
    discard(more)
    return out


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """links (a, b) of ids as links of their labels; those within a class fall away."""
    of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")).hint("merge")
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    return named.filter("a != b")


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, width: int = 5, bands: int = 18, rows: int = 4, leader_rounds: int = 2, block: int = 256, distinct: bool = False) -> DataFrame:
    """Distinct texts that have words (same, rep, class_id, stays), as a written table.

    rep is the smallest id of the text, stays marks one text of each class: that of the smallest id, then of the least digest. distinct says that no text
    occurs twice, which spares an exchange of all texts.
    """
    rows_of = docs.select(_key(text_col).alias("same"), F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
    own = None if distinct else written(rows_of.groupBy("same").agg(F.min("rep").alias("rep"), F.first("text").alias("text")), "near-distinct")
    each = rows_of if own is None else own
    levels = shipped(docs).sparkSession.sparkContext.broadcast(_frequencies(each, "text", width))  # BUCKETS bytes
    signed = written(_signatures(each, levels, width, bands, rows).filter("size(bands) > 0").withColumn("node", F.monotonically_increasing_id()), "near-signed")
    exploded = signed.select(F.col("node").alias("id"), F.explode("bands").alias("bucket"))
    shared = written(exploded.groupBy("bucket").agg(F.min("id").alias("lead"), F.count("*").alias("n")).filter("n > 1"), "near-buckets")
    members = written(exploded.join(shared.hint("merge"), "bucket").select("bucket", "id", "lead"), "near-members")
    wanted = written(signed.select(F.col("same").alias("s"), F.col("rep").alias("r"), "node").join(members.select("id").distinct().hint("merge"), F.col("node") == F.col("id"), "left_semi"), "near-wanted")
    of_text = (F.col("s") == F.col("same")) & F.col("r").eqNullSafe(F.col("rep"))
    texts = written(each.join(wanted.hint("merge"), of_text).select(F.col("node").alias("id"), "text", F.octet_length("text").alias("bytes")), "near-texts")
    discard(own, shared, wanted)
    used, labels, round_no = [signed, texts, members], None, 0
    while True:
        asked = members.filter("id != lead").groupBy(F.col("id").alias("a"), F.col("lead").alias("b")).agg(F.lit(1).alias("one")).drop("one")
        compared = written(_compared(asked, texts, levels, width), "near-compared")
        links = compared.filter(F.col("sim") >= threshold).select("a", "b")
        labels = components(links) if labels is None else _merged(labels, _between(links, labels))
        left = _open_members(members, compared, labels, 1 - threshold, round_no)
        used += [compared, labels, left]
        round_no += 1
        if left.isEmpty():
            break
        members = left
        if round_no == leader_rounds:
            crossing = _crossing(members.filter(F.col("n") <= block), texts, levels, width, threshold, block)
            links, used = crossing, [*used, crossing]
            many = members.filter(F.col("n") > block)
            if not many.isEmpty():
                dealt = _by_prefix(many.groupBy("id").agg(F.first("label").alias("label")), texts, levels, width, threshold)
                crossing = _crossing(dealt, texts, levels, width, threshold, 4 * block)
                links, used = links.unionByName(crossing), [*used, dealt, crossing]
            labels = _merged(labels, links)
            used.append(labels)
            break
    of_node = labels.select(F.col("id").alias("n"), "label").hint("merge")
    named = signed.select("same", "rep", "node").join(of_node, F.col("node") == F.col("n"), "left").select("same", "rep", F.coalesce("label", "node").alias("label"))
    named = written(named, "near-named")
    first = written(named.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "same")).alias("first")), "near-first")
    classed = named.join(first.hint("merge"), "label").select("same", "rep", F.col("first.rep").alias("class_id"), (F.col("same") == F.col("first.same")).alias("stays"))
    classed = written(classed, "near-class-of-text")
    discard(*used, named, first)
    return classed


def _bare(text_col: str) -> Column:
    """Whether a text has no word."""
    return ~F.coalesce(F.col(text_col), F.lit("")).rlike(WORD)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, bands: int = 18, rows: int = 4, leader_rounds: int = 2, block: int = 256) -> DataFrame:
    """One row per row of docs: id_col, class_id, text_id, kept.

    class_id is the smallest id of the texts connected by links of at least threshold (weighted Jaccard similarity of
    width-word shingles of the whole texts), text_id the smallest id with the very same text; kept marks
    the rows whose id is their class_id. Words are compared as they stand. A text of fewer words than width is one shingle. A text that
    is null or has no word is a class of its own, named by its id. A null id takes the class of its text, null if
    no row of the class has another. Texts are told apart by their digest, so equal ids of different texts don't meet. Rows repeated
    with the same id are all returned. An empty table gives an empty table.
    Other columns are not read. After leader_rounds rounds, what is left of a bucket is compared in
    blocks of so many members.
    """
    classed = _classes(docs, id_col, text_col, threshold, width, bands, rows, leader_rounds, block)
    each = docs.select(F.col(id_col).alias("id"), _key(text_col).alias("s"), _bare(text_col).alias("bare"))
    out = each.join(classed.hint("merge"), F.col("s") == F.col("same"), "left")
    own = lambda c: F.when(F.col("bare"), F.col("id")).otherwise(F.col(c))
    out = out.select(F.col("id").alias(id_col), own("class_id").alias("class_id"), own("rep").alias("text_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("class_id")))


def _open_members(members: DataFrame, compared: DataFrame, labels: DataFrame, limit: float, round_no: int) -> DataFrame:
    """The members of buckets that may still hold an unknown link: bucket, id, lead (another than before), n, label.

    The leader leaves. A member at distance d of it can only be linked with members at distances up to d + limit; if none of
    them is in another class than it, it leaves. Buckets of which less than two classes are left are closed.
    """
    dist = compared.select(F.col("a").alias("id"), F.col("b").alias("lead"), (1 - F.col("sim")).alias("d")).hint("merge")
    own = labels.select("id", "label").hint("merge")
    rest = members.filter("id != lead").select("bucket", "id", "lead").join(dist, ["id", "lead"]).join(own, "id", "left")
    rest = rest.select("bucket", "id", "d", F.coalesce("label", "id").alias("label"), F.when(F.col("d") <= limit, "near").otherwise("far").alias("side"))
    rest = written(rest, f"near-rest{round_no}")
    stats = rest.groupBy("bucket").agg(
        F.min(F.when(F.col("side") == "far", F.col("d"))).alias("far_from"), F.max(F.when(F.col("side") == "near", F.col("d"))).alias("near_to"),
        F.min("label").alias("l0"), F.max("label").alias("l1"),
    )
    stats = written(stats.filter("l0 != l1 and far_from is not null"), f"near-open{round_no}")
    kept = rest.join(stats.hint("merge"), "bucket").filter((F.col("side") == "far") | (F.col("d") >= F.col("far_from") - limit))
    kept = written(kept.select("bucket", "id", "label"), f"near-kept{round_no}")
    again = kept.groupBy("bucket").agg(
        F.min_by("id", F.xxhash64(F.lit(round_no), "id")).alias("lead"), F.count("*").alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1"),
        F.bit_xor(F.xxhash64("id")).alias("who"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("who_else"),
    )
    # Of buckets with the same members one is enough.
    again = again.filter("n > 1 and l0 != l1").groupBy("who", "who_else", "n").agg(F.min("bucket").alias("bucket"), F.min("lead").alias("lead"))
    again = written(again.select("bucket", "lead", "n"), f"near-again{round_no}")
    left = written(kept.join(again.hint("merge"), "bucket").select("bucket", "id", "lead", "n", "label"), f"near-left{round_no}")
    discard(rest, stats, kept, again)
    return left


def _by_prefix(members: DataFrame, texts: DataFrame, levels, width: int, threshold: float) -> DataFrame:
    """members (id, label) in buckets (bucket, id, label, bytes) by the shingles of their prefixes, as a written table: whichever two of different labels are linked meet in one.

    A text has as many rows as its prefix has shingles, about a fifth of all. The order is by how common shingles are among members: weights hold all that few in a hundred texts
    have as equally rare, and then a passage that so many share would be in the prefix of each. Buckets with one label only are left out, and of those with the same members all but one.
    """
    wanted = written(texts.select("id", "text").join(members.select("id", "label").hint("merge"), "id"), "near-many")
    steps = wanted.sparkSession.sparkContext.broadcast(_steps(wanted, "text", width))  # BUCKETS bytes
    types = {c: wanted.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        weigh, step = Weigher(levels.value, width), np.frombuffer(steps.value, np.uint8)
        for batch in batches:
            for s, e, d, o in slices(batch.column(1)):
                u, level, ptr = weigh(d, o)
                common = step[(u >> np.uint64(44)).astype(np.int64)]
                each = [prefix(u[i:j], level[i:j], threshold, common[i:j]) for i, j in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32)
                flat = np.concatenate(each).astype(np.uint64, copy=False).view(np.int64) if each else np.empty(0, np.int64)
                columns = [batch.column(0).slice(s, e - s), batch.column(2).slice(s, e - s), pa.array(np.diff(o)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "bytes", "buckets"])

    dealt = wanted.mapInArrow(run, f"id {types['id']}, label {types['label']}, bytes long, buckets array<long>")
    dealt = written(dealt.select("id", "label", "bytes", F.explode("buckets").alias("bucket")), "near-prefixes")
    sets = dealt.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.bit_xor(F.xxhash64("id")).alias("who"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("who_else"),
    )
    sets = written(sets.filter("l0 != l1").groupBy("who", "who_else", "n").agg(F.min("bucket").alias("bucket")), "near-prefix-sets")
    out = written(dealt.join(sets.select("bucket").hint("merge"), "bucket").select("bucket", "id", "label", "bytes"), "near-by-prefix")
    discard(wanted, dealt, sets)
    return out


def _crossing(members: DataFrame, texts: DataFrame, levels, width: int, threshold: float, block: int) -> DataFrame:
    """Links (a, b) between classes that members of a bucket are in, as a written table; of those that a task finds, as many as connect what it connects.

    members has the bytes of each text, or gets them from texts. A bucket is cut into blocks of about `block` members, or BLOCK_BYTES of text; every two blocks meet in one task, and each block's own
    members in one. So a task holds two blocks of texts, whatever the size of the bucket, no pair is ever a row, and a text has a row for each block of its bucket: one
    in a bucket of one block. Members of the bucket's largest class don't ask.
    """
    kind = members.schema["id"].dataType.simpleString()
    sized = members if "bytes" in members.columns else members.select("bucket", "id", "label").join(texts.select("id", "bytes").hint("merge"), "id")
    sizes = sized.groupBy("bucket", "label").agg(F.count("*").alias("k"), F.sum("bytes").alias("b"))
    sizes = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("k", "label")).alias("largest"), F.sum("k").alias("n"), F.max("k").alias("most"), F.sum("b").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.least(F.col("n"), F.ceil(F.col("bytes") / BLOCK_BYTES))).cast("int")
    sizes = written(sizes.filter("n > most").select("bucket", "largest", blocks.alias("blocks")), "near-blocks")
    each = members.select("bucket", "id", "label").join(sizes.hint("merge"), "bucket")
    each = each.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = [F.least("own", "other").alias("q"), F.greatest("own", "other").alias("m")]
    placed = written(each.select("bucket", "id", "label", *place, "own", (F.col("label") != F.col("largest")).alias("asks")), "near-dealt")
    dealt = placed.join(texts.select("id", "text").hint("merge"), "id").select("bucket", "q", "m", "id", "label", "own", "asks", "text")

    def run(key, table):
        release()
        weigh = Weigher(levels.value, width)
        vectors = _vectors(table.column("text").combine_chunks(), weigh)
        asks, own = np.array(table.column("asks").to_pylist()), np.array(table.column("own").to_pylist())
        names, label = np.unique(np.array(table.column("label").to_pylist()), return_inverse=True)
        group = np.arange(len(names))  # of classes that are connected by now
        total = np.array([WEIGHTS[x[1]].sum() for x in vectors])
        posted = np.concatenate([x[0] for x in vectors])
        order = np.argsort(posted, kind="stable")
        posted = posted[order]
        weight = np.concatenate([WEIGHTS[x[1]] for x in vectors])[order]
        owner = np.repeat(np.arange(len(vectors)), [len(x[0]) for x in vectors])[order]
        alone, a, b = key[1].as_py() == key[2].as_py(), [], []
        for i in np.flatnonzero(asks):
            other = group[label] != group[label[i]]
            if not alone:
                other &= own != own[i]
            if not other.any():
                continue
            x, mine = vectors[i][0], WEIGHTS[vectors[i][1]]
            low, high = np.searchsorted(posted, x, "left"), np.searchsorted(posted, x, "right")
            found = np.repeat(high - np.cumsum(high - low), high - low) + np.arange((high - low).sum())
            least = np.bincount(owner[found], np.minimum(weight[found], np.repeat(mine, high - low)), len(vectors))
            hit = other & (least >= threshold * (total[i] + total - least))
            for j in np.unique(label[hit]).tolist():
                if group[j] != group[label[i]]:
                    a.append(names[label[i]])
                    b.append(names[j])
                    group[group == group[j]] = group[label[i]]
        kept = table.schema.field("label").type
        return pa.Table.from_arrays([pa.array(a, kept), pa.array(b, kept)], names=["a", "b"])

    links = written(dealt.groupBy("bucket", "q", "m").applyInArrow(run, f"a {kind}, b {kind}"), "near-crossing")
    discard(sizes, placed)
    return links


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each class (that of the smallest id, then of the least digest); all columns as they were.

    Classes are those of texts, as in near_groups(), whatever the ids: rows with a null id, or with an id that another text has, stay
    unless their text's class has a smaller one. Of texts without a word, one row stays for each id and text.
    """
    staying = _classes(docs, id_col, text_col, **how).filter("stays").select("same", "rep").hint("merge")
    named = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_i"), _key(text_col).alias("_s"), _bare(text_col).alias("_b"))
    kept = named.join(staying, (F.col("_s") == F.col("same")) & F.col("_i").eqNullSafe(F.col("rep")), "left").filter(F.col("_b") | F.col("same").isNotNull())
    return kept.dropDuplicates(["_s", "_i"]).select("_row.*")
