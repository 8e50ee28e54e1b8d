"""Quality by weak supervision: rules vote or abstain, expectation-maximisation estimates how accurate each is, and a document
is kept by its posterior probability of being good. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

_SPACE = " \t\n\x0b\f\r"
_SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A word without a letter.
_BARE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]++(?![^\x20\x09-\x0D])"


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct, n_upper,
    n_marks, n_letters, n_bare (words without a letter).

    A null text has none of anything. Repeated 3-word windows are found by sorting a text's windows by hash and comparing neighbours, words
    with words. Hash and place are packed in one number, so that numbers are sorted; should two neighbours of equal hash have other words, the
    windows of that text are sorted by their words as well.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.withColumn("inner", F.btrim("t", F.lit(_SPACE)))
    d = d.select(
        "id", "t",
        F.when(F.col("inner") == "", F.array().cast("array<string>")).otherwise(F.split("inner", _SPLIT, -1)).alias("words"),
        F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)) != "").alias("lines"),
    )
    d = d.withColumns({
        "n_words": F.size("words").cast("long"),
        "n_distinct": F.size(F.array_distinct("words")).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "word_chars": F.length(F.translate("t", _SPACE, "")).cast("long"),
        "n_symbols": (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long"),
        "n_marks": (F.length("t") - F.length(F.translate("t", "!?", ""))).cast("long"),
        "n_upper": F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("long"),
        "n_letters": F.length(F.regexp_replace("t", r"\P{L}+", "")).cast("long"),
        "n_bare": F.regexp_count("t", F.lit(_BARE)).cast("long"),
        "bits": F.length(F.bin(F.size("words").cast("long"))),
    })
    window = "xxhash64(words[i], words[i + 1], words[i + 2])"
    d = d.withColumn("packed", F.expr(f"CASE WHEN n_words >= 3 THEN sort_array(transform(sequence(0, n_words - 3), i -> shiftleft({window}, bits) + i)) END"))
    place = "{x} & (shiftleft(1L, bits) - 1)"
    pair = f"CASE WHEN k > 0 AND shiftright(x, bits) = shiftright(packed[k - 1], bits) THEN named_struct('i', cast({place.format(x='x')} AS INT), 'j', cast({place.format(x='packed[k - 1]')} AS INT)) END"
    d = d.withColumn("pairs", F.expr(f"filter(transform(packed, (x, k) -> {pair}), y -> y IS NOT NULL)"))
    same = "words[y.i] = words[y.j] AND words[y.i + 1] = words[y.j + 1] AND words[y.i + 2] = words[y.j + 2]"
    covers = lambda pairs: f"size(array_distinct(flatten(transform({pairs}, y -> array(y.i, y.i + 1, y.i + 2, y.j, y.j + 1, y.j + 2)))))"
    by_words = "sort_array(transform(sequence(0, cast(n_words AS INT) - 3), i -> named_struct('a', words[i], 'b', words[i + 1], 'c', words[i + 2], 'i', i)))"
    next_to = "transform(array({w}), w -> filter(transform(w, (x, k) -> CASE WHEN k > 0 AND x.a = w[k - 1].a AND x.b = w[k - 1].b AND x.c = w[k - 1].c THEN named_struct('i', x.i, 'j', w[k - 1].i) END), y -> y IS NOT NULL))[0]".format(w=by_words)
    covered = f"CASE WHEN pairs IS NULL OR size(pairs) = 0 THEN 0 WHEN forall(pairs, y -> {same}) THEN {covers('pairs')} ELSE {covers(next_to)} END"
    return d.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(covered).cast("long").alias("n_repeat_words"),
        "n_lines", "n_distinct", "n_upper", "n_marks", "n_letters", "n_bare",
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes over the columns of features(): 1 good, -1 bad, 0 abstains.

    Each kind of poor text is looked for by two rules at least, since it is by their agreement that accuracies are told apart.
    """
    c = F.col
    share = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(0.0))
    words = c("n_words")
    return {
        "length": _vote(words >= 100, words < 50),
        "letters": _vote(share("n_letters", "word_chars") > 0.85, share("n_letters", "word_chars") < 0.75),
        "bare": _vote(share("n_bare", "n_words") < 0.05, share("n_bare", "n_words") > 0.2),
        "symbols": _vote(share("n_symbols", "n_words") < 0.05, share("n_symbols", "n_words") > 0.25),
        "marks": _vote(share("n_marks", "n_words") < 0.1, share("n_marks", "n_words") > 0.4),
        "capitals": _vote(share("n_upper", "word_chars") < 0.15, share("n_upper", "word_chars") > 0.4),
        "lines": _vote((c("n_lines") >= 3) & (c("n_dup_lines") == 0), share("n_dup_lines", "n_lines") > 0.3),
        "repeats": _vote(share("n_repeat_words", "n_words") < 0.1, share("n_repeat_words", "n_words") > 0.3),
        "variety": _vote(share("n_distinct", "n_words") > 0.3, share("n_distinct", "n_words") < 0.12),
    }


def _em(patterns: DataFrame, k: int, steps: int, still: float) -> DataFrame:
    """patterns (code, n) with the posterior probability of good. The code has the votes as digits of base 3.

    There are 3^k patterns at most, whatever the number of documents; they are folded in one row. Each rule has two accuracies, of its
    votes on good and on bad documents (good, bad); all that is asked of a rule is that it's no worse than chance: good + bad >= 1. The
    posterior starts as the share of good votes, which favours no rule. Steps end when no accuracy moves by more than `still`, or
    after `steps`. Counts are smoothed by one vote of either kind.
    """
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("p"))
    votes = f"transform(sequence(0, {k - 1}), j -> cast(floor(x.code / pow(3, j)) % 3 AS INT) - 1)"
    one = one.select(F.expr(f"transform(p, x -> named_struct('code', x.code, 'n', cast(x.n AS DOUBLE), 'v', {votes}))").alias("p"))
    term = "CASE v WHEN 1 THEN ln(a.good / (1 - a.bad)) WHEN -1 THEN ln((1 - a.good) / a.bad) ELSE 0D END"
    posterior = f"1 / (1 + exp(-least(500D, greatest(-500D, ln(s.pi / (1 - s.pi)) + aggregate(zip_with(x.v, s.acc, (v, a) -> {term}), 0D, (t, u) -> t + u)))))"
    share = "least(0.99D, greatest(0.01D, size(filter(x.v, v -> v = 1)) / greatest(1, size(filter(x.v, v -> v != 0)))))"
    sums = lambda what: f"aggregate(e, 0D, (t, x) -> t + {what})"
    of = lambda vote, q: f"least(0.9999D, greatest(0.0001D, ({sums(f'CASE WHEN x.v[j] = {vote} THEN x.n * {q} ELSE 0D END')} + 1) / ({sums(f'CASE WHEN x.v[j] != 0 THEN x.n * {q} ELSE 0D END')} + 2)))"
    rule = f"transform(array(named_struct('g', {of(1, 'x.q')}, 'b', {of(-1, '(1 - x.q)')})), r -> named_struct('good', r.g, 'bad', greatest(r.b, 1 - r.g)))[0]"
    prior = f"least(0.999D, greatest(0.001D, {sums('x.n * x.q')} / greatest(1D, {sums('x.n')})))"
    fit = lambda q: f"transform(array(transform(p, x -> named_struct('v', x.v, 'n', x.n, 'q', {q}))), e -> named_struct('pi', {prior}, 'acc', transform(sequence(0, {k - 1}), j -> {rule})))[0]"
    moved = "array_max(zip_with(s.acc, f.acc, (a, b) -> greatest(abs(a.good - b.good), abs(a.bad - b.bad))))"
    step = f"CASE WHEN s.moved <= {still}D THEN s ELSE transform(array({fit(posterior)}), f -> named_struct('pi', f.pi, 'acc', f.acc, 'moved', {moved}))[0] END"
    start = f"transform(array({fit(share)}), f -> named_struct('pi', f.pi, 'acc', f.acc, 'moved', 1D))[0]"
    one = one.withColumn("s", F.expr(f"aggregate(sequence(1, {steps}), {start}, (s, i) -> {step})"))
    return one.select(F.explode(F.expr(f"transform(p, x -> named_struct('code', x.code, 'posterior', {posterior}))")).alias("x")).select("x.code", "x.posterior")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = 0.5, steps: int = 200, still: float = 1e-6) -> DataFrame:
    """The features of each row of docs, each rule's vote (vote_<rule>), posterior, base_failed and kept.

    base_failed: less than 50 words, or more than half of them in repeated 3-word windows. kept: not base_failed, and a posterior of
    keep_from at least. Accuracies are estimated over the documents that don't fail the base, of which alone the posterior decides. Null
    and empty texts fail the base. Repeated rows and ties of ids are judged one by one, a null id stays null. An
    empty table gives an empty table; other columns are not read. Documents with the same votes get the same posterior.
    """
    votes = rules()
    code = sum(((v + 1) * 3**j for j, v in enumerate(votes.values())), F.lit(0)).cast("int")
    seen = written(features(docs, id_col, text_col).withColumn("code", code), "quality-features")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = written(_em(seen.groupBy("code").agg(F.count(F.when(~failed, 1)).alias("n")), len(votes), steps, still), "quality-posteriors")
    judged = seen.join(F.broadcast(found), "code")  # 3^rules rows
    digits = {f"vote_{name}": (F.floor(F.col("code") / 3**j) % 3 - 1).cast("int") for j, name in enumerate(votes)}
    return judged.withColumns({**digits, "base_failed": failed, "kept": ~failed & (F.col("posterior") >= keep_from)}).drop("code").withColumnRenamed("id", id_col)
