"""Language, quality, chat, mixing, BPE and personal data against brute force; the pipeline against its parts."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from joinwright.llm import bpe, chat, langid, mixing, pii, quality, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source)"""
    return spark.createDataFrame([(*r, 0, "clash", "clash") for r in rows], DOCS)


# --- language ---


def longest_matches(text: str, known: str) -> int:
    n, i = 0, 0
    while i < len(text):
        j = i
        while j < len(text) and text[i : j + 1] in known:
            j += 1
        i, n = max(j, i + 1), n + 1
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(3)
    texts = {k: "".join(rng.choice(v) for _ in range(300)) for k, v in {"a": "abc ", "b": "bcd ", "c": "xyzé"}.items()}
    model = langid.Model(texts)
    for _ in range(40):
        t = "".join(rng.choice("abcdxyé? ") for _ in range(rng.randint(1, 200)))
        spelt = lambda s: "".join(map(chr, langid.points(s)))
        codes = model.code[langid.points(t)].astype(np.int32)[:, None]
        assert model.phrases(codes)[0][:, 0].tolist() == [longest_matches(spelt(t), spelt(texts[k])) for k in model.langs]


@pytest.mark.parametrize("segment", [1, 5, 16, 64])
def test_segments_are_parsed_as_whole_texts(segment, monkeypatch):
    """Long repeats make phrases that span segments."""
    rng = random.Random(segment)
    monkeypatch.setattr(langid, "SEGMENT", segment)
    monkeypatch.setattr(langid, "ROWS", 7)
    known = {k: "".join(rng.choice(v) for _ in range(400)) for k, v in {"a": "ab ", "b": "abc ", "z": "xyz"}.items()}
    model = langid.Model(known)
    spelt = lambda s: "".join(map(chr, langid.points(s)))
    texts = ["".join(rng.choice([known["a"][i : i + 90], known["b"][i : i + 40], "abxq", "", "zzz"]) for i in rng.choices(range(300), k=9)) for _ in range(12)]
    got = model.counts([langid.points(t) for t in texts])
    assert got.T.tolist() == [[longest_matches(spelt(t), spelt(known[k])) for k in model.langs] for t in texts]


def test_every_character_has_a_code():
    rng = random.Random(4)
    scripts = {"el": range(0x3B1, 0x3CA), "en": range(97, 123), "ja": range(0x3041, 0x3097), "ko": range(0xAC00, 0xB000), "ru": range(0x430, 0x450), "zh": range(0x4E00, 0x5200)}
    words = {k: ["".join(chr(rng.choice(v)) for _ in range(rng.randint(1, 5))) for _ in range(150)] for k, v in scripts.items()}
    say = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    texts = {k: say(k, 100 if k == "el" else 400) for k in scripts}
    model = langid.Model(texts)
    assert model([say(k, 12) for k in scripts])[0] == sorted(scripts)
    spelt = lambda s: "".join(map(chr, langid.points(s)))
    mixed = [" ".join(say(rng.choice(sorted(scripts)), 2) for _ in range(15)) + " жњ龍" for _ in range(20)]
    codes = [model.code[langid.points(t)] for t in mixed]
    steps = max(map(len, codes))
    found, _ = model.phrases(np.array([np.pad(c, (0, steps - len(c))) for c in codes]).T)
    assert found.T.tolist() == [[longest_matches(spelt(t), spelt(texts[k])) for k in model.langs] for t in mixed]


def test_identify(spark):
    texts = {"en": "the cat sat on the mat and the dog ran away " * 20, "fr": "le chat est sur le tapis et la souris mange du fromage " * 20}
    rows = [(1, "the dog sat on the cat", None, None), (2, "la souris est sur le tapis", "x", None), (3, None, None, None), (4, "", None, None), (5, "12 34 !?", None, None), (6, "the mat " * 3000, None, None), (None, "日本語", None, None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs(spark, rows), texts).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, 6)] == ["en", "fr", "und", "und", "und", "en"]
    assert got[None][0] == "en" and all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in langid.identify(docs(spark, rows), {}).collect()} == {"und"}
    kept = langid.keep_identified(docs(spark, rows), texts)
    assert {(r["doc_id"], r["lang"]) for r in kept.collect()} == {(1, "en"), (2, "fr"), (6, "en")} and kept.columns == docs(spark, rows).columns
    assert langid.keep_identified(docs(spark, rows), texts, languages=["fr"]).count() == 1
    assert langid.identify(docs(spark, rows * 2), texts).count() == 14
    assert langid.identify(docs(spark, rows).limit(0), texts).count() == 0
    assert langid.training_text(docs(spark, rows).filter("lang is not null"), "doc_id", "text", "lang") == {"x": "la souris est sur le tapis"}
    long = [(i, f"{i} " + "mot " * 300, "fr", None) for i in range(5)] + [(9, "court", "fr", None)]
    assert langid.training_text(docs(spark, long), "doc_id", "text", "lang", chars=4000) == {"fr": "court"}
    assert set(langid.training_text(docs(spark, long[:5]), "doc_id", "text", "lang", chars=4000)["fr"].split("\n")) <= {x[1][:1000] for x in long}
    assert langid.training_text(docs(spark, rows).filter("lang = 'none'"), "doc_id", "text", "lang") == {}


def test_held_out_accuracy(spark, sf):
    rows = queries.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.9


# --- quality ---


def plain_features(t: str | None):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_features(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\n\nx\n x\nx", "#*$ %&|<>é", "a b c", "w " * 30_000, *("".join(rng.choice(["a ", "b ", "c\n", "é  ", "#"]) for _ in range(rng.randint(1, 80))) for _ in range(150))]
    got = {r["id"]: r for r in quality.features(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_features(t), t


def test_windows_of_equal_hash_are_told_apart_by_their_words(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(3, 60))) for _ in range(60)]
    d = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    plain = F.expr
    monkeypatch.setattr(quality.F, "expr", lambda s: plain(s.replace("xxhash64(words[i], words[i + 1], words[i + 2])", "cast(ascii(words[i]) % 2 AS BIGINT)")))
    assert {r["id"]: r["n_repeat_words"] for r in quality.features(d).collect()} == {i: plain_features(t)[4] for i, t in enumerate(texts)}


def plain_em(votes: Counter, steps: int = 200, still: float = 1e-6) -> dict:
    """Posterior of each tuple of votes, by loops. votes: how many documents have each."""
    k = len(next(iter(votes)))
    q = {v: min(0.99, max(0.01, v.count(1) / max(1, k - v.count(0)))) for v in votes}
    acc, moved = None, 1.0
    for _ in range(steps + 1):
        pi = min(0.999, max(0.001, sum(n * q[v] for v, n in votes.items()) / max(1, sum(votes.values()))))
        new = []
        for j in range(k):
            rate = lambda vote, w: min(0.9999, max(0.0001, (sum(n * w(q[v]) for v, n in votes.items() if v[j] == vote) + 1) / (sum(n * w(q[v]) for v, n in votes.items() if v[j]) + 2)))  # noqa: B023, E731
            g, b = rate(1, lambda x: x), rate(-1, lambda x: 1 - x)
            new.append((g, max(b, 1 - g)))
        moved = max(abs(x - y) for p, r in zip(acc, new, strict=True) for x, y in zip(p, r, strict=True)) if acc else 1.0
        acc = new
        log = lambda v: math.log(pi / (1 - pi)) + sum(math.log(g / (1 - b)) if x == 1 else math.log((1 - g) / b) if x else 0 for x, (g, b) in zip(v, acc, strict=True))  # noqa: B023, E731
        q = {v: 1 / (1 + math.exp(-max(-500, min(500, log(v))))) for v in votes}
        if moved <= still:
            break
    return q


def test_posteriors_against_loops(spark):
    rng = random.Random(12)
    for rules in (1, 3, 5):
        votes = Counter()
        for _ in range(400):
            good = rng.random() < 0.7
            votes[tuple(rng.choices([1 if good else -1, -1 if good else 1, 0], [6, 1 + j, 2])[0] for j in range(rules))] += 1
        votes[tuple([-1] * rules)] += 0
        code = lambda v: sum((x + 1) * 3**j for j, x in enumerate(v))
        got = {r["code"]: r["posterior"] for r in quality._em(spark.createDataFrame([(code(v), n) for v, n in votes.items()], "code int, n long"), rules, 200, 1e-6).collect()}
        want = plain_em(votes)
        assert {code(v): pytest.approx(q, abs=1e-6) for v, q in want.items()} == got
    assert quality._em(spark.createDataFrame([], "code int, n long"), 3, 200, 1e-6).count() == 0


def test_a_vote_alone_is_no_veto(spark, monkeypatch):
    """Of four rules, one errs on a tenth of the good texts: its vote against the others is outvoted, while a filter of all rules drops the text."""
    monkeypatch.setattr(quality, "rules", lambda: {w: F.when(F.col("n_symbols").bitwiseAND(1 << j) > 0, -1).otherwise(1) for j, w in enumerate("abcd")})
    plain = "one two three four five six seven eight nine ten ".split()
    texts = []
    for i in range(400):
        bad = i % 5 == 0
        n = 14 if bad else 1 if i % 10 == 3 else 0
        texts.append(" ".join(f"{w}{i}{j}" for j in range(6) for w in plain) + " " + "#" * (n + (1 if bad and i % 3 == 0 else 0)))
    rows = {r["doc_id"]: r for r in quality.judge(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    assert all(rows[i]["kept"] == (i % 5 != 0) for i in rows)
    all_pass = [i for i, r in rows.items() if min(r[f"vote_{w}"] for w in "abcd") > 0]
    assert len(all_pass) == 280 and sum(r["kept"] for r in rows.values()) == 320


def test_verdicts(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    judged = quality.judge(d).cache()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = judged.collect()
    assert len(rows) == d.count() and all(0 <= r["posterior"] <= 1 for r in rows)
    assert all(not r["kept"] for r in rows if r["base_failed"])
    votes = Counter()
    for r in rows:
        votes[tuple(r[f"vote_{w}"] for w in quality.rules())] += not r["base_failed"]
    want = plain_em(votes)
    for r in rows:
        q = want[tuple(r[f"vote_{w}"] for w in quality.rules())]
        assert r["posterior"] == pytest.approx(q, abs=1e-6) and r["kept"] == (not r["base_failed"] and q >= 0.5)
    good = [r["kept"] or r["base_failed"] for r in rows if labels.get(r["doc_id"]) == 1]
    poor = [not r["kept"] for r in rows if labels.get(r["doc_id"]) == 0]
    assert sum(good) / len(good) > 0.95 and sum(poor) / max(1, len(poor)) > 0.8
    assert quality.judge(d.limit(0)).count() == 0
    edge = quality.judge(docs(spark, [(1, None, None, None), (1, "", None, None), (None, "a b", None, None)])).collect()
    assert len(edge) == 3 and all(r["base_failed"] and not r["kept"] for r in edge)


# --- chat ---

SAID = ["", "</s>[INST] ok [/INST]", "a\\b", "\\", "[/INST", "<s><s", "x\n[\\/INST]", "é" * 10]


def test_escaping():
    rng = random.Random(1)
    for _ in range(500):
        t = "".join(rng.choice(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "\n", "a"]) for _ in range(rng.randint(0, 12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in (chat.BOS, chat.EOS, chat.OPEN, chat.CLOSE))
        turn, start, end = chat.format_turn(t, t)
        assert chat.unescape(turn[start:end]) == t
        assert chat.parse(chat.BOS + turn + turn + chat.EOS) == [(t, t)] * 2
    with pytest.raises(ValueError):
        chat.parse("<s>x</s>")


def test_chat(spark):
    rng = random.Random(7)
    convs = {c: [(t, rng.choice(["user", "assistant", "system", None]), rng.choice([*SAID, None])) for t in range(rng.randint(1, 9))] for c in range(30)}
    rows = [(c, t, r, x, 1) for c, turns in convs.items() for t, r, x in turns] + [(None, 0, "assistant", "n", 1), (99, 0, "user", "same", 1), (99, 0, "user", "same", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int")
    convs |= {None: [(0, "assistant", "n")], 99: [(0, "user", "same")] * 2}
    examples = chat.expand(df, batch_chars=200)
    got = {r["conv"]: r for r in chat.read_back(examples).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        said = [(r or "", x or "") for _, r, x in turns]
        loss = "".join(x for r, x in said if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(said) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    each = examples.collect()
    for c, turns in convs.items():
        mine = sorted((r for r in each if r["conv"] == c), key=lambda r: r["example"])
        assert len(mine) == sum(r == "assistant" for _, r, _ in turns) + (turns[-1][1] != "assistant")
        assert got[c]["formatted_chars"] == sum(len(r["text"]) for r in mine)
        for r in mine:
            assert chat.parse(r["text"]) == [(a or "", b or "") for _, a, b in turns[: r["n_turns"]]]
    assert chat.expand(df.limit(0)).count() == 0


# --- mixing ---


def plain_targets(sizes: dict, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        out = {s: most * sizes[s] if s in capped else rest * w[s] / free for s in names}
        over = {s for s in names if s not in capped and out[s] > most * sizes[s]}
        if not over:
            return out
        capped |= over


def test_mixing(spark):
    rng = random.Random(11)
    rows = [(i if i % 50 else None, rng.choice([None, "", "w " * rng.randint(1, 30)]), "en", rng.choice(["é", "z", "a", "b", None, *["hot"] * 8])) for i in range(1500)]
    rows += [(7000, "tiny one", "en", "small")] + [(7001, "same again", "en", "hot")] * 3 + [(None, "all alike", "en", "hot")] * 40
    d = docs(spark, rows)
    got = mixing.copies(d, chunk_rows=16, fan_in=4).collect()
    again = mixing.copies(d.repartition(5), chunk_rows=16, fan_in=4).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["copies"] * r["size"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 3
    want = plain_targets(dict(sizes))
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6
    mixed = mixing.mix(d, chunk_rows=16, fan_in=4)
    assert mixed.columns == d.columns
    per = Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in mixed.collect())
    assert per == +Counter({k: v for k, v in _summed(got).items()})
    assert mixing.copies(d.limit(0)).count() == 0 and mixing.mix(d.limit(0)).count() == 0


def _summed(got):
    out = Counter()
    for r in got:
        out[(r["id"], r["source"], r["size"])] += r["copies"]
    return out


def test_a_meeting_keeps_words_and_expectations():
    rng = random.Random(1)
    for _ in range(200):
        sa, sb, xa, xb = rng.randint(1, 50), rng.randint(1, 50), rng.uniform(0.01, 0.99), rng.uniform(0.01, 0.99)
        up, down = min((1 - xa) * sa, xb * sb), min(xa * sa, (1 - xb) * sb)
        p = down / (up + down)
        mean = 0.0
        for coin, weight in ((p / 2, p), ((1 + p) / 2, 1 - p)):
            ya, yb = mixing.meet(sa, xa, sb, xb, coin)
            assert ya * sa + yb * sb == pytest.approx(xa * sa + xb * sb) and ({ya, yb} & {0.0, 1.0})
            mean += weight * ya
        assert mean == pytest.approx(xa)


# --- BPE ---


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    whole = Tokenizer.from_file(path)
    rng = random.Random(5)
    parts = ["a", " ", "  ", "\n", "é", "1", "<|endoftext|>", "the ", "don't", "x y", "!", "…", "　", "\t", "ab cd ef gh", "\x00", "日本", "，", "。", "'", "'s", "’", "привет", " мир", "中文", "²", "\x1c", "\x85", "\u00a0", "\u2003", "\u200b", "́", "𝒳", "😀", "ʼ", "١", "अ"]
    texts = ["", None, "a" * 5000, " " * 3000, "the passage that all share " * 300, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 2500))) for _ in range(60))]
    texts += ["one " + texts[10], texts[10] + " two"]
    d = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    want = {i: whole.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    encoded = bpe.encode(d, path)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == want
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(encoded, path).collect()} == {i: whole.decode(x, skip_special_tokens=False) for i, x in want.items()}
    for r in bpe.round_trip(d, path).collect():
        ids = want[r["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.encode(d.limit(0), path).count() == 0 and bpe.round_trip(d.limit(0), path).count() == 0


def test_the_vocabulary_is_sent(spark, tmp_path):
    import shutil

    own = tmp_path / "own_vocabulary.json"
    shutil.copy(queries.vocabulary(), own)
    d = docs(spark, [(1, "a text of some words", None, None)])
    want = bpe.Codec(queries.vocabulary()).encode("a text of some words").tolist()
    assert bpe.encode(d, str(own)).first()["ids"] == want
    assert bpe.codec("/nowhere/own_vocabulary.json").encode("a text of some words").tolist() == want


@pytest.mark.parametrize("script", ["latin", "cyrillic", "chinese"])
def test_shared_passages_are_encoded_once(script):
    rng = random.Random(2)
    if script == "chinese":
        passage = "".join("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(rng.randint(3, 20))) + rng.choice("，。") for _ in range(1500))
    else:
        first = 97 if script == "latin" else 0x430
        passage = " ".join("".join(chr(first + rng.randrange(26)) for _ in range(rng.randint(2, 9))) for _ in range(4000))
    codec = bpe.Codec(queries.vocabulary())
    codec.encode("first words " + passage)
    before, pieces = codec.reused, len(codec.cache)
    codec.encode("other " + passage + " end")
    assert codec.reused - before > 10 and len(codec.cache) <= pieces + 2 and codec.widened == 0
    tiny = bpe.Codec(queries.vocabulary(), cache_bytes=3000)
    assert tiny.encode(passage).tolist() == codec.encode(passage).tolist() and tiny.cached <= 3000


def test_what_the_fast_encoder_gives_up_on():
    codec = bpe.Codec(queries.vocabulary())
    texts = ["one two  three, 中文。" * 100, "a" * 3000]
    want = [codec.encode(t).tolist() for t in texts]

    class Stops:
        def __getattr__(self, name):
            return getattr(codec.pieces.encoding, name)

        def encode_to_numpy(self, *a, **k):
            raise RuntimeError("stack")

    other = bpe.Codec(queries.vocabulary())
    other.pieces.encoding = Stops()
    assert [other.encode(t).tolist() for t in texts] == want


def test_joins_grow_until_ids_agree(monkeypatch):
    """With agreement points that are none, windows grow, and what can't agree is encoded whole."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.vocabulary())
    rng = random.Random(8)
    texts = ["".join(rng.choice(["thing", "ation ", " the", "don't ", "12", "é", "中文", "  ", "!?"]) for _ in range(900)) for _ in range(25)]
    codec = bpe.Codec(queries.vocabulary(), chunk_bits=6)
    assert all(codec.encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids for t in texts) and codec.widened == 0
    monkeypatch.setattr(bpe.Codec, "agrees", lambda self, data, i: 0 < i < len(data) and data[i] & 0xC0 != 0x80)
    wrong = bpe.Codec(queries.vocabulary(), chunk_bits=6)
    assert sum(wrong.encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids for t in texts) > 0 and wrong.widened > 0


# --- personal data ---

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind: str, m: str) -> bool:
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def plain_spans(t: str | None):
    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, t or "") if passes(k, m[0]))


def listed(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def test_personal_data(spark):
    rng = random.Random(3)
    parts = ["a@b.c", "@", ".", "%", "1.2.3.4", "255", ".", "-", " ", "4111 1111 1111 1111", "+1 (988) 555-2485", "+", "x", "é", "9", "0.", "a.b@c-d.e.f%q@r.s", " \n", "1-1", "()", "😀", "call 555-123-9876,"]
    texts = ["", None, "9" * 3000, "1 2 " * 2000, "a" * 5000 + "@", "1." * 2000, "a@b.cc " * 600, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(400))]
    d = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    for r in pii.find(d).collect():
        want = plain_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[3] == k for x in want) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(listed(want).encode()).hexdigest()
        assert {x for x in listed(want).split(",") if x} <= set(r["spans"].split(","))
    assert pii.find(d.limit(0)).count() == 0


def test_patterns_discover(spark):
    texts = [f"some text {i} then Phone: +1 555 {i:07d} and more" for i in range(20)] + ["write Phone: 555-123-4567, please", "a number 555-123-4567 elsewhere", "the item 555-765-4321 costs"] + ["the end of the day"] * 50
    rows = {r["doc_id"]: r for r in pii.find(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    assert rows[20]["spans"] == "phone:13:25" and rows[21]["spans"] == "phone:9:21" and rows[22]["spans"] == ""
    assert rows[20]["n_phone"] == 0 and rows[3]["n_phone"] == 1


def test_discovered_identifiers_support_patterns(spark):
    found = [f"555-123-456{i}" for i in range(4)]
    texts = [f"some text {i} then Phone: +1 555 {i:07d} and more" for i in range(20)] + [f"write Phone: {x} now" for x in found[:3]] + [f"write Tel: {x} again" for x in found]
    rows = {r["doc_id"]: r["spans"] for r in pii.find(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    assert [rows[i] for i in range(20, 27)] == ["phone:13:25"] * 3 + ["phone:11:23"] * 4
    one = pii.find(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]), turns=1)
    assert one.filter("doc_id = 26").first()["spans"] == "" and one.filter("doc_id = 23").first()["spans"] != ""


def test_shapes_of_several_words(spark):
    seeds = [f"text {i} Phone: +1 555 {i:07d} and more" for i in range(9)] + [f"text {i} Mail: x{i}@a.bc and more" for i in range(9)]
    texts = [*seeds, "Phone: 030 123 4567, please", "Phone: (555) 123 4567 now", "Mail: alice@localhost now", "a number 1-555-0000003 of before", "the 12 34 56"]
    rows = {r["doc_id"]: r["spans"] for r in pii.find(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    assert [rows[i] for i in range(18, 23)] == ["phone:7:19", "phone:7:21", "email:6:21", "phone:9:22", ""]


def plain_discover(edges, turns=3, support=3, confidence=0.5):
    totals, by = Counter(), defaultdict(dict)
    for kind, p, value, n, _ in edges:
        totals[p] += n
        if kind:
            by[(kind, p)][value] = n
    seeds = {(k, v): 1.0 for k, _, v, _, seed in edges if seed}
    known = dict(seeds)
    for _ in range(turns):
        good = {}
        for (kind, p), values in by.items():
            hit = [n * known[(kind, v)] for v, n in values.items() if (kind, v) in known]
            if len(hit) >= support and sum(hit) / totals[p] >= confidence:
                good[(kind, p)] = min(0.999, sum(hit) / totals[p])
        miss = defaultdict(lambda: 1.0)
        for (kind, p), c in good.items():
            for v in by[(kind, p)]:
                miss[(kind, v)] *= 1 - c
        new = dict(seeds) | {k: 1 - m for k, m in miss.items() if 1 - m >= confidence and k not in seeds}
        done = set(new) == set(known)
        known = new
        if done:
            break
    return set(known)


def test_discovery_against_loops(spark):
    rng = random.Random(14)
    for trial in range(3):
        rows = {}
        for _ in range(700):
            kind = rng.choice(["phone", "card", None])
            value = f"{kind}{rng.randrange(60)}" if kind else None
            rows[(kind, rng.randrange(40) if kind != "card" else rng.randrange(90), value)] = rng.randint(1, 4)
        seeds = {v for _, _, v in rows if v and rng.random() < (0.3, 0.5, 0.7)[trial]}
        edges = [(k, p, v, n, v in seeds) for (k, p, v), n in rows.items()]
        got = {tuple(r) for r in pii.discover(spark.createDataFrame(edges, "kind string, p long, value string, n long, seed boolean")).collect()}
        assert got == plain_discover(edges) and len(got) >= len(seeds)


def test_hidden_seeds_are_found_again(spark):
    texts = [f"some text {i} then Phone: +1 555 {i:07d} and more {i % 7}" for i in range(60)] + [f"value {i}" for i in range(200)]
    row = pii.held_out(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).filter("kind = 'phone'").first()
    assert row["hidden"] > 0 and row["found"] == row["hidden"] and row["others"] == 0


# --- pipeline ---


def plain_classes(spark, texts: list[str]) -> list[int]:
    """For each text the place of the first one that links of similarity 0.8 connect it with, by comparing all pairs."""
    import pyarrow as pa

    from joinwright.llm import near_dedup

    levels = near_dedup._frequencies(spark.createDataFrame([(t,) for t in texts], "text string"), "text", 5)
    vectors = near_dedup._vectors(pa.array(texts), near_dedup.Weigher(levels, 5))
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and near_dedup.similarity(vectors[i], vectors[j]) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf}/documents.parquet")
    seen, cur = {}, d
    for name, stage in corpus_pipeline.STAGES:
        cur = stage(spark, cur, sf).cache()
        if name != "bpe":
            assert cur.columns == d.columns
        seen[name] = cur.collect()
    rows = {r["doc_id"]: r for r in d.collect()}
    text = {i: r["text"] for i, r in rows.items()}
    # the language: of all documents with a letter, that of which the whole text needs fewest bits, by the plainest of parsers
    learned = langid.training_text(d.filter(langid.fold("doc_id") != 2), "doc_id", "text", "lang")
    spelt = lambda s: "".join(map(chr, langid.points(s)))
    known = {k: spelt(t) for k, t in learned.items()}
    told = {r["doc_id"]: r["lang"] for r in seen["language_id"]}
    assert set(told) <= {i for i, t in text.items() if any(c.isalpha() for c in t or "")}
    for i in sorted(text)[::20]:
        p = spelt(text[i] or "")
        if p.strip() and len(p) < 4000:
            need = {k: longest_matches(p, v) * math.log2(len(v)) for k, v in known.items()}
            fits = min(need.values()) / len(p) <= 8
            assert told.get(i) == (min(sorted(need), key=need.get) if fits else None)
    by = defaultdict(list)
    for i in told:
        by[text[i]].append(i)
    exact = sorted(max(v) for v in by.values())
    assert sorted(r["doc_id"] for r in seen["exact_dedup"]) == exact
    label = plain_classes(spark, [text[i] for i in exact])
    near = [i for k, i in enumerate(exact) if label[k] == k]
    assert sorted(r["doc_id"] for r in seen["near_dedup"]) == near
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", text[i])) for i in near}
    of, took, most = Counter(), Counter(), Counter()
    taken = Counter(r["doc_id"] for r in seen["mixing"])
    for i in near:
        source = rows[i]["source"]
        of[source] += size[i]
        took[source] += taken[i] * size[i]
        most[source] = max(most[source], size[i])
    want = plain_targets(dict(of))
    assert set(taken) <= set(near) and max(taken.values()) <= 3 and all(abs(took[s] - want[s]) <= most[s] / 2 + 1e-6 for s in of)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.vocabulary())
    assert Counter(r["doc_id"] for r in seen["bpe"]) == taken
    for r in seen["bpe"]:
        assert r["ids"] == whole.encode(text[r["doc_id"]], add_special_tokens=False).ids and r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, sf).collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in seen["bpe"])


def test_pipeline_stages_of_odd_rows(spark, sf):
    import corpus_pipeline

    one, two = "the cat sat on the mat and then the dog ran away from the house", "a quite different text about many other things that happen here"
    odd = [(None, None, None, None), (1, "", "en", "s"), (None, one, "en", None), (None, two, "en", None), (3, one, None, "s"), (3, two, "en", "s"), (3, two, "en", "s"), (4, one + " now", "en", "s"), (5, "12 34", "en", "s")]
    d = docs(spark, odd)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, d.limit(0), sf)
        assert empty.count() == 0 and (name == "bpe" or empty.columns == d.columns)
        out = stage(spark, d, sf)
        n = {"language_id": 6, "bpe": 9}.get(name)
        assert (n is None or out.count() == n) and out.count() > 0
    kept = corpus_pipeline.exact(spark, d, sf).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(1, ""), (3, one), (3, two), (4, one + " now"), (5, "12 34")])
    left = corpus_pipeline.near(spark, corpus_pipeline.exact(spark, d, sf), sf).collect()
    assert {r["text"] for r in left} >= {"", two, "12 34"} and len(left) == 4


def test_oracles(spark, sf):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        df, want = queries.QUERIES[name](spark, sf), c.sql(sql)
        cols = sorted(df.columns)
        assert sorted(want.columns) == cols
        at = [want.columns.index(x) for x in cols]
        assert sorted((tuple(r[x] for x in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_folds(spark):
    import zlib

    rows = spark.range(-5, 50).select("id", langid.fold("id").alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in rows)
