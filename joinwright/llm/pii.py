"""Personal data by bootstrapped contextual extraction. DataFrame functions only.

Identifiers of fixed form (e-mail and IP addresses, card and phone numbers) are the seeds. Each place of a seed gives lexical patterns: the two words before
it, the word before and the word after, either alone, and its own form. Places that may hold an identifier are all words with a digit or an @, and runs of
short numbers; a pattern extracts those of them where it holds. Patterns and the identifiers that they extract form a graph, scored in turns: a pattern by
the share of its places that hold identifiers known so far, an identifier by its patterns. What patterns of high confidence discover is known in the next turn,
and marked wherever it stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

KINDS = ("email", "ip", "card", "phone")

# Each expression finds what its plain form finds (see the tests), but never tries a run of characters twice: runs are possessive,
# and a match starts where a run does or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What may be an identifier: runs of two to eight short numbers, and words with a digit or an @.
_NUMBER = r"[0-9]{1,6}+(?![0-9])"
SHAPED = rf"(?<![^\x20\x09-\x0D])(?:[(+]?+{_NUMBER}(?:[\x20().-]{{1,3}}+{_NUMBER}){{1,7}}+(?=[.,;:!?)]*+(?:[\x20\x09-\x0D]|$))|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
_SPACE = r"\x20\x09-\x0D"


def _found(pattern: str, gate: str, keep: str = "true") -> str:
    """SQL: the matches of pattern in t where gate holds, as structs of s, e (code points), m (the match), ll, l and r (the two words before it and the
    one after it, in lower case).

    The text is split at the matches: lengths of what lies between give the places, in one pass. Only matches for which
    keep (SQL over x.m) holds are put down; they are gathered in lists of 256, so the work grows with their number. A context is looked for in the
    100 characters next to the match.
    """
    p = "r'" + pattern + "'"
    words = lambda part: f"filter(split(lower({part}), r'[{_SPACE}]+'), w -> w != '')"
    left = words("substring(x.g, -100)")
    row = f"array(named_struct('s', a.at + length(x.g), 'e', a.at + length(x.g) + length(x.m), 'm', x.m, 'll', try_element_at({left}, -2), 'l', try_element_at({left}, -1), 'r', try_element_at({words('substring(x.n, 1, 100)')}, 1)))"
    kind = "array<struct<s:int,e:int,m:string,ll:string,l:string,r:string>>"
    none = f"cast(array() AS {kind})"
    full = "size(a.part) >= 256"
    zipped = f"transform(array(split(t, {p}, -1)), gaps -> zip_with(zip_with(gaps, slice(gaps, 2, size(gaps)), (g, n) -> named_struct('g', g, 'n', n)), regexp_extract_all(t, {p}, 0), (x, m) -> named_struct('g', x.g, 'n', x.n, 'm', m)))[0]"
    fold = (
        f"aggregate({zipped}, named_struct('at', 0, 'part', {none}, 'done', cast(array() AS array<{kind}>)),"
        f" (a, x) -> CASE WHEN x.m IS NULL THEN a ELSE named_struct('at', a.at + length(x.g) + length(x.m),"
        f" 'part', CASE WHEN NOT ({keep}) THEN a.part WHEN {full} THEN {row} ELSE concat(a.part, {row}) END,"
        f" 'done', CASE WHEN ({keep}) AND {full} THEN concat(a.done, array(a.part)) ELSE a.done END) END, a -> concat(flatten(a.done), a.part))"
    )
    return f"CASE WHEN {gate} THEN {fold} ELSE {none} END"


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length({d})), 0L, (a, i) -> a + CASE WHEN i % 2 = 1 THEN cast(substring({d}, length({d}) + 1 - i, 1) AS INT)"
    " ELSE (2 * cast(substring({d}, length({d}) + 1 - i, 1) AS INT)) div 10 + (2 * cast(substring({d}, length({d}) + 1 - i, 1) AS INT)) % 10 END) % 10 = 0"
)


#: SQL: which kind a place that is no seed is shaped like, or null; its closing punctuation is left out first.
_CORE = "regexp_replace(x.m, r'[^0-9A-Za-z]++$', '')"
_SHAPE = r"""CASE
    WHEN x.m RLIKE r'^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+$' THEN 'email'
    WHEN x.m RLIKE r'^[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){3,7}$' THEN 'ip'
    WHEN x.m RLIKE r'^[0-9]([ -]?[0-9]){11,18}$' THEN 'card'
    WHEN x.m RLIKE r'^[(+]?[0-9]([(). -]{0,2}[0-9]){6,10}$' THEN 'phone' END"""


_KEEP = {
    "email": "true",
    "ip": "forall(split(x.m, r'\\.'), p -> coalesce(try_cast(p AS INT) <= 255, false))",
    "card": f"length(x.m) BETWEEN 12 AND 60 AND length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN.format(d=_DIGITS)}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "shaped": "true",
}


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, an array of (s, e, m, ll, l, r) for each of KINDS, and `shaped`: all places that may hold an identifier."""
    digit = "t RLIKE '[0-9]'"
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return t.select(
        "id",
        F.expr(_found(EMAIL, "contains(t, '@')", _KEEP["email"])).alias("email"),
        F.expr(_found(IP, digit, _KEEP["ip"])).alias("ip"),
        F.expr(_found(CARD, digit, _KEEP["card"])).alias("card"),
        F.expr(_found(PHONE, "contains(t, '+')", _KEEP["phone"])).alias("phone"),
        F.expr(_found(SHAPED, "t RLIKE '[0-9@]'", _KEEP["shaped"])).alias("shaped"),
    )


def _value(kind: str) -> str:
    return "lower(x.m)" if kind in ("email", "ip") else _DIGITS


#: SQL: the patterns of a place x, by hash. Letters of a form count by run, digits one by one.
_PATTERNS = """filter(array(
    CASE WHEN x.ll IS NOT NULL THEN xxhash64('two before', x.ll, x.l) END, CASE WHEN x.l IS NOT NULL AND x.r IS NOT NULL THEN xxhash64('around', x.l, x.r) END,
    CASE WHEN x.l IS NOT NULL THEN xxhash64('before', x.l) END, CASE WHEN x.r IS NOT NULL THEN xxhash64('after', x.r) END,
    xxhash64('form', regexp_replace(regexp_replace(left(x.m, 64), '[A-Za-z]+', 'a'), '[0-9]', '9'))), p -> p IS NOT NULL)"""


def discover(edges: DataFrame, turns: int = 3, support: int = 3, confidence: float = 0.5) -> DataFrame:
    """(kind, value): all identifiers known in the end, seeds and discovered ones.

    edges (kind, p, value, n, seed): at n places where pattern p holds the value stands; kind is null if it's shaped like no identifier. A pattern counts for
    a kind with support known identifiers of it at least, if they fill a share of `confidence` of all its places; an identifier is known
    if the chance that none of its patterns is right, taken as independent, is at most 1 - confidence. Turns end when nothing new is known.
    """
    totals = written(edges.groupBy("p").agg(F.sum("n").alias("total")), "pii-totals").hint("merge")
    edges = edges.filter("kind is not null")
    seeds = written(edges.filter("seed").select("kind", "value").distinct().withColumn("score", F.lit(1.0)), "pii-seeds")
    known, count = seeds, seeds.count()
    for turn in range(turns):
        hits = edges.join(known.hint("merge"), ["kind", "value"]).groupBy("kind", "p").agg(F.sum(F.col("n") * F.col("score")).alias("hits"), F.count("*").alias("k"))
        good = hits.filter(F.col("k") >= support).join(totals, "p").withColumn("conf", F.least(F.lit(0.999), F.col("hits") / F.col("total")))
        good = good.filter(F.col("conf") >= confidence).select("kind", "p", "conf")
        scored = edges.join(good.hint("merge"), ["kind", "p"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score"))
        both = scored.filter(F.col("score") >= confidence).unionByName(seeds).groupBy("kind", "value").agg(F.max("score").alias("score"))
        known = written(both, f"pii-known{turn}")
        before, count = count, known.count()
        if count == before:
            break
    return known.select("kind", "value")


def _places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, base, n_<kind>, places) of each row of docs, as a written table. base: s, k, e of the seeds; places: s, e, kind, value, ps, seed of all places."""
    mark = lambda kind, i: f"transform({kind}, x -> named_struct('s', x.s, 'k', {i + 1}, 'e', x.e))"
    base = f"concat({', '.join(mark(k, i) for i, k in enumerate(KINDS))})"
    place = lambda kind, value, seed: f"named_struct('s', x.s, 'e', x.e, 'kind', {kind}, 'value', {value}, 'ps', {_PATTERNS}, 'seed', {seed})"
    seeds = ", ".join(f"transform({k}, x -> {place(repr(k), _value(k), 'true')})" for k in KINDS)
    outside = f"transform(filter(shaped, x -> NOT exists(base, b -> b.s < x.e AND x.s < b.e)), x -> named_struct('s', x.s, 'm', {_CORE}, 'll', x.ll, 'l', x.l, 'r', x.r))"
    other = f"transform(transform({outside}, x -> named_struct('s', x.s, 'e', x.s + length(x.m), 'm', x.m, 'll', x.ll, 'l', x.l, 'r', x.r)), x -> {place(_SHAPE, f'CASE WHEN ({_SHAPE}) IS NULL THEN NULL WHEN x.m RLIKE {chr(39)}[@:]{chr(39)} THEN lower(x.m) ELSE {_DIGITS} END', 'false')})"
    found = entities(docs, id_col, text_col).withColumn("base", F.expr(base))
    found = found.select("id", "base", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.expr(f"concat({seeds}, {other})").alias("places"), F.monotonically_increasing_id().alias("row"))
    return written(found, "pii-found")


def _edges(found: DataFrame) -> DataFrame:
    each = found.select(F.explode("places").alias("x")).select("x.kind", "x.value", "x.seed", F.explode("x.ps").alias("p"))
    return written(each.groupBy("kind", "p", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "pii-edges")


def held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 10, turns: int = 3, support: int = 3, confidence: float = 0.5) -> DataFrame:
    """How well hidden seeds are found again: kind, hidden, found, others (identifiers discovered that are no seeds). One seed value in `share` is hidden."""
    edges = _edges(_places(docs, id_col, text_col))
    hidden = F.pmod(F.xxhash64(F.lit("hidden"), "kind", "value"), F.lit(share)) == 0
    asked = edges.withColumn("seed", F.col("seed") & ~hidden)
    known = discover(asked, turns, support, confidence).withColumn("known", F.lit(True))
    values = edges.filter("kind is not null").groupBy("kind", "value").agg(F.max("seed").alias("seed")).withColumn("hidden", F.col("seed") & hidden)
    both = values.join(known.hint("merge"), ["kind", "value"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return both.groupBy("kind").agg(F.count_if("hidden").alias("hidden"), F.count_if(F.col("hidden") & F.col("known")).alias("found"), F.count_if(~F.col("seed") & F.col("known")).alias("others"))


def _spans(arrays: str) -> str:
    return f"array_join(transform(sort_array({arrays}), x -> concat(element_at(array({', '.join(repr(k) for k in KINDS)}), x.k), ':', x.s, ':', x.e)), ',')"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", turns: int = 3, support: int = 3, confidence: float = 0.5) -> DataFrame:
    """One row per row of docs: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The numbers and base_sha256 tell of the seeds; spans lists them and the places outside of them that hold a known identifier (kind:start:end, in code
    points, end exclusive; by start, then kind as in KINDS). Whole texts are read; a null text counts as the empty one; null and repeated
    ids are kept, row by row. An empty table gives an empty table. Other columns are not read.
    """
    found = _places(docs, id_col, text_col)
    known = written(discover(_edges(found), turns, support, confidence), "pii-known")
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("x.kind")).cast("int")
    may = found.select("row", F.explode(F.filter("places", lambda x: ~x["seed"] & x["kind"].isNotNull())).alias("x"))
    places = may.select("row", F.col("x.kind").alias("kind"), F.col("x.value").alias("value"), F.struct("x.s", number.alias("k"), "x.e").alias("y"))
    more = places.join(known.hint("merge"), ["kind", "value"]).groupBy("row").agg(F.collect_list("y").alias("more"))  # those of one text
    out = found.select("row", "id", *[f"n_{k}" for k in KINDS], "base").join(more.hint("merge"), "row", "left")
    return out.select(F.col("id").alias(id_col), *[f"n_{k}" for k in KINDS], F.sha2(F.expr(_spans("base")), 256).alias("base_sha256"), F.expr(_spans("concat(base, coalesce(more, array()))")).alias("spans"))
