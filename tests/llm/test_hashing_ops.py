"""Exact dedup, near dedup, archive and sharding against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from joinwright.llm import exact_dedup, near_dedup, sharding, shingles, warc
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, _row string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", 0, "clash", "clash") for i, t in enumerate(texts)], DOCS)


EDGE = [None, "", "", "a", "a", "A", "é" * 3, "x " * 20_000, "x " * 20_000, " ", "a"]


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("bits", [128, 0])
def test_exact_groups(spark, keep, bits):
    """bits 0: all hashes collide, so the text itself decides."""
    hash_of = exact_dedup.content_hash if bits else (lambda c: F.unhex(F.md5(F.lit("same"))))
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs(spark, EDGE), keep=keep, hash_of=hash_of).collect()}
    by = defaultdict(list)
    for i, t in enumerate(EDGE):
        by[t or ""].append(i)
    for t, ids in by.items():
        best = min(ids) if keep == "min" else max(ids)
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest())


def test_drop_exact(spark):
    d = docs(spark, EDGE)
    out = exact_dedup.drop_exact(d, keep="max")
    assert out.columns == d.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 5, 6, 8, 9, 10]
    assert exact_dedup.drop_exact(d.limit(0)).count() == 0
    assert exact_dedup.drop_exact(d.limit(1).unionByName(d.limit(1))).count() == 1
    nulls = docs(spark, ["t", "t", "u"], [None, 4, None])
    assert sorted((r["text"], r["doc_id"]) for r in exact_dedup.drop_exact(nulls).collect() if r["doc_id"]) == [("t", 4)]
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(d, keep="any")


def plain_shingles(t: str, width: int = 5) -> Counter:
    w = t.split()
    return Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else Counter()


def test_shingles_are_the_texts_windows():
    import pyarrow as pa

    rng = random.Random(4)
    texts = ["", None, " ", "one", "a b c d", "a b c d e", "a b c d e f a b c d e", "é ü\tß\n\nx y z  ", *(" ".join(rng.choice("ab cd éf g".split()) for _ in range(rng.randint(1, 60))) for _ in range(40))]
    seen: dict[int, tuple] = {}
    for _, _, d, o in shingles.slices(pa.array(texts), most=50):
        assert len(o) >= 2
    (_, _, d, o), *rest = shingles.slices(pa.array(texts))
    u, tf, ptr = shingles.counted(*shingles.shingles(d, o))
    assert not rest and len(ptr) == len(texts) + 1
    for i, t in enumerate(texts):
        mine, want = Counter(dict(zip(u[ptr[i] : ptr[i + 1]].tolist(), tf[ptr[i] : ptr[i + 1]].tolist(), strict=True))), plain_shingles(t or "")
        assert sorted(mine.values()) == sorted(want.values())
        seen |= {(i, h): 1 for h in mine}
    words = "p q r s t u v w".split()
    a, b = " ".join(words), " ".join(words[:7])
    (_, _, d, o), = shingles.slices(pa.array([a, b]))
    u, _, ptr = shingles.counted(*shingles.shingles(d, o))
    assert len(np.intersect1d(u[: ptr[1]], u[ptr[1] :])) == 3


def test_sampling_matches_weighted_jaccard():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8):
        n, hits, bands = 400, 0, 300
        pool = shingles.mix64(rng.integers(0, 1 << 62, 2 * n, dtype=np.uint64))
        k = int(2 * n * share / (1 + share))
        a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:k], pool[n : 2 * n - k])))
        level = {int(x): int(y) for x, y in zip(pool, rng.integers(0, 128, 2 * n), strict=True)}
        la, lb = (np.array([level[int(x)] for x in v]) for v in (a, b))
        want = near_dedup.similarity((a, la), (b, lb))
        ha = near_dedup.band_hashes(a, la, np.array([0, n]), bands, 1)
        hb = near_dedup.band_hashes(b, lb, np.array([0, n]), bands, 1)
        hits = (ha == hb).mean()
        assert hits == pytest.approx(want, abs=0.09)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.random()}"
    return " ".join(w)


def test_near_groups_against_all_pairs(spark):
    rng = random.Random(8)
    texts = list(EDGE)
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(40, 200))]
        texts += [" ".join(base)] + [edited(rng, base, rng.randint(0, 6)) for _ in range(rng.randint(1, 12))]
    common = " ".join(f"c{i}" for i in range(40))
    texts += [common + " " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(60)) for _ in range(30)]
    got = {r["doc_id"]: r for r in near_dedup.near_groups(docs(spark, texts), block=4, leader_rounds=1).collect()}
    levels = near_dedup._frequencies(docs(spark, sorted(set(t or "" for t in texts))), "text", 5)
    import pyarrow as pa

    weigh = near_dedup.Weigher(levels, 5)
    vectors = near_dedup._vectors(pa.array(texts), weigh)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    close = 0
    for i in range(len(texts)):
        for j in range(i):
            s = near_dedup.similarity(vectors[i], vectors[j])
            if s >= 0.8 or (texts[i] == texts[j] and (texts[i] or "").split()):
                close += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert close > 40
    assert {i: got[i]["class_id"] for i in got} == {i: root(i) for i in range(len(texts))}
    assert all(got[i]["kept"] == (got[i]["class_id"] == i) for i in got)
    distinct = near_dedup.drop_near(exact_dedup.drop_exact(docs(spark, texts)), distinct=True)
    assert {r["doc_id"] for r in distinct.collect() if (r["text"] or "").split()} == {root(i) for i in range(len(texts)) if (texts[i] or "").split()}
    out = near_dedup.drop_near(docs(spark, texts))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({root(i) for i in range(len(texts))}) and out.columns == docs(spark, texts).columns
    assert near_dedup.near_groups(docs(spark, texts).limit(0)).count() == 0


def test_prefixes_of_linked_texts_meet():
    """Whenever two texts are similar enough, their prefixes share a shingle; and a passage that many have is in none of them."""
    rng = np.random.default_rng(5)
    linked = 0
    for _ in range(300):
        n = int(rng.integers(4, 60))
        pool = np.unique(rng.integers(0, 1 << 62, 2 * n, dtype=np.uint64))
        idf = {int(x): int(y) for x, y in zip(pool, rng.integers(0, 16, len(pool)), strict=True)}
        shift = int(rng.integers(0, max(1, n // 5)))
        a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[shift:n], pool[n : n + int(rng.integers(0, max(1, n // 6)))])))
        la, lb = (np.array([idf[int(x)] * 8 + int(rng.integers(0, 2)) for x in v]) for v in (a, b))
        for t in (0.8, 0.5):
            if near_dedup.similarity((a, la), (b, lb)) >= t:
                linked += 1
                assert len(np.intersect1d(near_dedup.prefix(a, la, t), near_dedup.prefix(b, lb, t)))
    assert linked > 100
    u = np.arange(1, 101, dtype=np.uint64)
    level = np.where(u <= 50, 0, 15) * 8
    assert near_dedup.prefix(u, level, 0.8).min() > 50 and len(near_dedup.prefix(u, level, 0.8)) <= 16


def test_long_words():
    import pyarrow as pa

    word = "".join(random.Random(1).choice("abc") for _ in range(300_000))
    texts = [word, word[:-1] + "x", "x" + word[1:], word[:5000] + "y" + word[5001:], word]
    (_, _, d, o), = shingles.slices(pa.array(texts), most=10**9)
    u, _, ptr = shingles.counted(*shingles.shingles(d, o))
    assert len(u) == 5 and len(set(u.tolist())) == 4 and u[0] == u[4] and len(shingles._POWERS) == 1 << shingles.RUN


def test_copies_do_not_make_their_text_common(spark):
    """An edited version of a text is linked with it, though the text is a third of all rows."""
    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    near = list(base)
    for i in (5, 60):
        near[i] = "changed"
    rest = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(200)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_groups(docs(spark, [" ".join(base)] * 100 + [" ".join(near)] + rest)).collect()}
    assert {got[i] for i in range(101)} == {0} and len({got[i] for i in range(101, 301)}) == 200


def test_ids_that_are_null_or_clash(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(100)] for _ in range(6)]
    a, b, c, d, e, f = (" ".join(x) for x in base)
    near_e = " ".join([*base[4][:-1], "other"])
    ids, texts = [None, None, None, 5, 5, None, 9, 9, None, None], [a, b, a, c, d, e, near_e, f, " ", ""]
    out = near_dedup.drop_near(docs(spark, texts, ids)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter([(None, a), (None, b), (5, c), (5, d), (9, near_e), (9, f), (None, " "), (None, "")])
    got = Counter((r["doc_id"], r["class_id"], r["text_id"]) for r in near_dedup.near_groups(docs(spark, texts, ids)).collect())
    assert got == Counter({(None, None, None): 5, (5, 5, 5): 2, (None, 9, None): 1, (9, 9, 9): 2})


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 100)]
    got = dict(map(tuple, near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102, 200)}


def test_components_of_other_shapes(spark):
    """Chains in any order, stars, dense groups, a link of an id with itself, links twice and either way round."""
    rng = random.Random(5)
    for trial in range(3):
        ids = rng.sample(range(1000), 120)
        links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in zip(ids[:60], ids[1:60], strict=False)] + [(ids[60], x) for x in ids[61:80]]
        links += [(a, b) for a in ids[80:100] for b in ids[80:100]] + [(ids[100], ids[101])] * 2 + [(ids[102], ids[102])]
        rng.shuffle(links)
        groups = [ids[:60], ids[60:80], ids[80:100], ids[100:102], [ids[102]]]
        got = dict(map(tuple, near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()))
        assert got == {x: min(g) for g in groups for x in g}


def test_labels_merge(spark):
    """Links between classes, and with ids that have none, rename the whole classes and no others."""
    labels = near_dedup.written(spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "id long, label long"), "labels")
    got = dict(map(tuple, near_dedup._merged(labels, spark.createDataFrame([(5, 1), (8, 3), (10, 11), (5, 1)], "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 8: 3, 9: 3, 3: 3, 10: 10, 11: 10}
    links = spark.createDataFrame([(2, 6), (1, 2), (9, 3)], "a long, b long")
    assert sorted(map(tuple, near_dedup._between(links, labels).collect())) == [(1, 5), (8, 3)]


def test_links_do_not_grow_with_the_square_of_a_group(spark):
    """Members of a large group that meet in blocks: links are as many as classes at most in each block, not as pairs."""
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(60):
        words = list(base)
        words[i] = f"x{i}"
        rows.append((i, i, " ".join(words)))
    texts = spark.createDataFrame(rows, "id long, label long, text string").withColumn("bytes", F.octet_length("text")).withColumn("bucket", F.lit(1))
    levels = spark.sparkContext.broadcast(near_dedup._frequencies(texts, "text", 5))
    links = near_dedup._crossing(texts.select("bucket", "id", "label"), texts.select("id", "text", "bytes"), levels, 5, 0.8, 256)
    assert links.count() == 59
    assert {r["label"] for r in near_dedup.components(links).collect()} == {0}


def _rows_written(run, monkeypatch):
    """How many rows the tables that near dedup writes have while run does, by name."""
    rows, write = [], near_dedup.written

    def counting(df, what):
        out = write(df, what)
        rows.append((what, out.count()))
        return out

    monkeypatch.setattr(near_dedup, "written", counting)
    run()
    return Counter({what: sum(n for w, n in rows if w == what) for what, _ in rows})


def test_a_text_has_a_row_for_each_block_of_its_bucket(spark, monkeypatch):
    """Not two for each: members of one block are there once, those of b blocks b times; and links across blocks are found."""
    base = [f"w{k}" for k in range(80)]
    rows = [(i, i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(60)]
    texts = spark.createDataFrame(rows, "id long, label long, text string").withColumn("bytes", F.octet_length("text")).withColumn("bucket", F.lit(1))
    levels = spark.sparkContext.broadcast(near_dedup._frequencies(texts, "text", 5))
    for block, blocks in ((60, 1), (20, 3)):
        found = []
        made = _rows_written(lambda: found.append(near_dedup._crossing(texts.select("bucket", "id", "label"), texts.select("id", "text", "bytes"), levels, 5, 0.8, block)), monkeypatch)  # noqa: B023
        monkeypatch.undo()
        assert made["near-dealt"] == 60 * blocks
        assert {r["label"] for r in near_dedup.components(found[0]).collect()} == {0}


def test_a_shared_passage_is_in_no_prefix(spark):
    """Texts that share a passage of a third, and no more, don't meet for its sake; two of them that are near copies do."""
    passage = [f"p{k}" for k in range(40)]
    rows = [(i, i, " ".join([f"t{i}_{k}" for k in range(40)] + passage + [f"u{i}_{k}" for k in range(40)])) for i in range(60)]
    rows.append((60, 60, rows[7][2] + " end"))
    texts = spark.createDataFrame(rows, "id long, label long, text string")
    levels = spark.sparkContext.broadcast(bytes([15] * near_dedup.BUCKETS))  # all weigh the same
    met = near_dedup._by_prefix(texts.select("id", "label"), texts.select("id", "text"), levels, 5, 0.8)
    assert {r["id"] for r in met.collect()} == {7, 60}


def test_archive(spark, tmp_path):
    big, html = "é" * 600, [None, "", "short", "short", "<p>x</p>\r\n", "é" * 600, "é" * 600, "é" * 600, "y" * 5000]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://h/{i}\r\nX: y", h, "clash") for i, h in enumerate(html)], "page_id long, url string, html string, key string")
    warc.write_archive(pages, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a" / "payloads")).count() == 5
    got = {r["id"]: r for r in warc.read_archive(spark, str(tmp_path / "a")).collect()}
    for i, h in enumerate(html):
        body = (h or "").encode()
        assert bytes(got[i]["payload"]) == body and got[i]["sha1"] == hashlib.sha1(body).hexdigest() and got[i]["length"] == len(body)
        revisit = h == big and i < 7
        assert (got[i]["kind"], got[i]["refers_to"]) == (("revisit", 7) if revisit else ("response", None))
        head = got[i]["header"]
        assert head.startswith("WARC/1.1\r\n") and head.endswith("\r\n\r\n") and "\r\nX: y" not in head
        assert f"Content-Length: {0 if revisit else len(body)}\r\n" in head
    archive = warc.read_archive(spark, str(tmp_path / "a"))
    records = {r["id"]: bytes(r["record"]) for r in warc.record_bytes(archive).collect()}
    assert records[8] == got[8]["header"].encode() + b"y" * 5000 + b"\r\n\r\n" and records[5].endswith(b"\r\n\r\n\r\n\r\n")
    warc.export_warc(archive, str(tmp_path / "w"))
    written = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    assert Counter(written) == Counter(b"".join(records.values()))
    parsed = warc.parse_records(warc.record_bytes(archive))
    for source in (parsed, warc.parse_records(warc.read_warc(spark, str(tmp_path / "w")))):
        rows = {r["id"]: r for r in source.collect()}
        assert {i: bytes(r["body"]) for i, r in rows.items()} == {i: b"" if got[i]["kind"] == "revisit" else (h or "").encode() for i, h in enumerate(html)}
        assert rows[0]["url"] == "http://h/0 X: y" and rows[2]["url"] == "" and all((r["kind"], r["refers_to"]) == (got[i]["kind"], got[i]["refers_to"]) for i, r in rows.items())
        again = {r["id"]: r for r in warc.resolved(source).collect()}
        assert {i: (r["length"], r["sha1"]) for i, r in again.items()} == {i: (len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, h in enumerate(html)}
    with pytest.raises(Exception, match="not a WARC record"):
        warc.parse_records(warc.record_bytes(archive).withColumn("record", F.substring("record", 1, 300))).collect()
    warc.write_archive(pages.limit(0), str(tmp_path / "e"))
    assert warc.resolved(warc.parse_records(warc.record_bytes(warc.read_archive(spark, str(tmp_path / "e"))))).count() == 0
    odd = spark.createDataFrame([(None, "u", "é" * 600), (3, "u", "é" * 600), (3, "v", "é" * 600), (3, "w", "z" * 2000), (None, "u", "x")], "page_id long, url string, html string")
    warc.write_archive(odd, str(tmp_path / "o"))
    rows = warc.resolved(warc.parse_records(warc.record_bytes(warc.read_archive(spark, str(tmp_path / "o"))))).collect()
    assert Counter((r["id"], r["kind"], r["refers_to"], r["length"]) for r in rows) == Counter({(None, "revisit", 3, 1200): 1, (3, "response", None, 1200): 2, (3, "response", None, 2000): 1, (None, "response", None, 1): 1})
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0


def test_archive_finds_damage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 50)], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    spark.read.parquet(str(tmp_path / "a" / "payloads")).withColumn("payload", F.encode(F.lit("other"), "UTF-8")).write.parquet(str(tmp_path / "b" / "payloads"))
    spark.read.parquet(str(tmp_path / "a" / "records")).write.parquet(str(tmp_path / "b" / "records"))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()


def greedy(sizes, cap):
    """Shards that a pass over all groups needs; none is larger than the capacity."""
    n, room = 1, cap
    for v in sizes:
        n, room = (n, room - v) if v <= room else (n + 1, cap - v)
    return n


def test_cuts_are_minimax(spark, monkeypatch):
    """Against a search over all groups, with more groups than cells, so that cells hold several and are narrowed."""
    rng = random.Random(5)
    for trial, (cell_bits, n) in enumerate([(2, 300), (3, 400), (0, 50), (4, 9), (16, 60), (1, 700)]):
        monkeypatch.setattr(sharding, "CELL_BITS", cell_bits)
        monkeypatch.setattr(sharding, "MOST_CELLS", rng.choice([8, 64, 1 << 17]))
        k = rng.randint(2, 12)
        near = trial == 1  # keys that agree in many bits
        keys = sorted(rng.sample(range(1 << 14), n) if near else (rng.randrange(1 << sharding.KEY_BITS) for _ in range(n)))
        sizes = [rng.choice([16, 17, 500, 900, 1500]) for _ in keys]
        groups = spark.createDataFrame(list(zip(keys, sizes, strict=True)), "key long, size long").cache()
        if sharding._large(groups, k):
            continue
        cuts = sharding.cut_keys(groups, k)
        best = next(c for c in range(max(-(-sum(sizes) // k), max(sizes)), sum(sizes) + 1) if greedy(sizes, c) <= k)
        parts = Counter()
        for key, v in zip(keys, sizes, strict=True):
            parts[sum(c <= key for c in cuts)] += v
        assert max(parts.values()) <= best and len(cuts) < k
    assert sharding.cut_keys(spark.createDataFrame([], "key long, size long"), 3) == []


def test_large_groups_have_shards_of_their_own(spark):
    rows = [(1, 1000), (2, 10), (3, 12), (4, 300), (5, 11), (6, 13)]
    assert sharding._large(spark.createDataFrame(rows, "key long, size long"), 4) == [1, 4]
    assert sharding._large(spark.createDataFrame(rows[:1], "key long, size long"), 40) == [1]
    assert sharding._large(spark.createDataFrame([], "key long, size long"), 4) == []
    rng = random.Random(9)
    texts = [f"{i} " + "x" * rng.randint(100, 300) for i in range(2000)]
    rest = sum(len(t) + 16 for t in texts)
    hot = "hot " * 100
    copies = rest // 2 // (len(hot) + 16)
    got = sharding.shard(docs(spark, texts + [hot] * copies), 40).collect()
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    top, *others = sorted(size.values(), reverse=True)
    assert top == copies * (len(hot) + 16) and len(size) == 40
    ordered = [len(t) + 16 for t in sorted(texts, key=lambda t: hashlib.sha256(t.encode()).hexdigest())]
    assert others[0] == next(c for c in range(-(-rest // 39), rest) if greedy(ordered, c) <= 39)


def test_shard(spark):
    rng = random.Random(6)
    texts = [*EDGE, *("copy " * 5 for _ in range(40)), *("".join(rng.choice("abé ") for _ in range(rng.randint(0, 300))) for _ in range(300))]
    d = docs(spark, texts, [None if i == 7 or 20 < i < 40 else i // 2 for i in range(len(texts))])
    got = sharding.shard(d, 6, window_rows=8).collect()
    assert len(got) == len(texts)
    assert Counter((r["size"], r["text_crc32"]) for r in got) == Counter((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts)
    slots, where = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        where[(r["size"], r["text_crc32"])].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(6))
    assert all(len(v) == 1 for v in where.values())
    assert sharding.shard(d.limit(0), 6).count() == 0
