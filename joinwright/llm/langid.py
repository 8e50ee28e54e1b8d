"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed with each: a phrase is the longest match
from where the last one ended, and the language needing fewest phrases wins, once their numbers are normalised by
the log of the automaton's text length: phrases * log2(length) / letters is the cross-parsing estimate of bits per letter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import held, shipped

#: Bounds of the model, whatever the corpus: code points of labelled text per language and in all, rows per language that may be sampled (in the
#: mean), languages. ALPHABET: characters whose moves are in the dense table; those of all others are in a sparse one.
TRAIN_CHARS, TRAIN_TOTAL, TRAIN_ROWS, MOST_LANGUAGES, ALPHABET = 60_000, 240_000, 100, 200, 62
#: Texts are parsed in segments of so many characters side by side; what the cuts between them change is parsed again.
SEGMENT, ROWS = 2048, 512


def automaton(codes: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix automaton of codes as a table of moves (state * width + code -> next state * width; 0: none, for no move leads to the start)
    and rows of moves by codes from width on: state, code, next state."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table, rare = np.zeros(len(moves) * width, np.int32), []
    for state, out in enumerate(moves):
        for c, to in out.items():
            if c < width:
                table[state * width + c] = to * width
            else:
                rare.append((state, c, to))
    return table, np.array(rare, np.int64).reshape(-1, 3)


_FRESH = np.int32(1 << 30)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def points(text: str) -> np.ndarray:
    """The text's letters as lower-case code points; each run of other characters is one space."""
    p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[p]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    return np.where(letter, p, np.uint32(32))[kept]


class Model:
    """Parses texts with all languages at once. texts: language -> labelled text."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        known = {k: points(texts[k]) for k in self.langs}
        seen, often = np.unique(np.concatenate([*known.values(), np.empty(0, np.uint32)]), return_counts=True)
        chars = seen[np.lexsort((seen, -often))]
        # 0 pads, 1 stands for all characters that no language has; from width on are those of the sparse table
        dense = len(chars[:ALPHABET])
        self.width = dense + 2
        self.code = np.ones(0x110000, np.int32)
        self.code[chars[:ALPHABET]] = np.arange(2, dense + 2)
        self.code[chars[ALPHABET:]] = np.arange(self.width, self.width + len(chars) - dense)
        self.rare = len(chars) - dense
        tables, starts, at, keys, nexts = [], [], 0, [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in self.langs:
            t, far = automaton(self.code[known[k]].tolist(), self.width)
            keys.append((at // self.width + far[:, 0]) * self.rare + far[:, 1] - self.width)
            nexts.append(at + far[:, 2] * self.width)
            # A missing move ends the phrase and starts the next with the same character: the move of the start state. All moves that
            # start a phrase are marked. A character that the language never has is a phrase of its own and leads to the start.
            first = np.tile(t[: self.width], len(t) // self.width)
            t = np.where(t > 0, t + at, first + at | _FRESH)
            t[: self.width] |= _FRESH
            t[:: self.width] = np.arange(0, len(t), self.width) + at  # padding changes nothing
            tables.append(t.astype(np.int32))
            starts.append(at)
            at += len(t)
        self.table = np.concatenate(tables) if tables else np.zeros(self.width, np.int32)
        self.starts = np.array(starts, np.int32)
        order = np.argsort(np.concatenate(keys))
        self.keys, self.nexts = np.concatenate(keys)[order], np.concatenate(nexts)[order].astype(np.int32)
        self.bits = np.array([math.log2(max(2, len(known[k]))) for k in self.langs])

    def _moves(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states by codes of the sparse table, and where there is one."""
        key = state.astype(np.int64) // self.width * self.rare + (code - self.width)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.nexts[at], self.keys[at] == key

    def _sparse(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """What the dense table gives, for codes from width on. state: languages x rows."""
        start = np.broadcast_to(self.starts[:, None], state.shape)
        to, known = self._moves(state, code)
        fresh, begins = self._moves(start, code)
        return np.where(known & (state != start), to, np.where(begins, fresh, start) | _FRESH)

    def _advance(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states (languages x rows) after one more code a row, marked where a phrase starts."""
        state = state & (_FRESH - 1)
        far = np.flatnonzero(codes >= self.width) if self.rare else ()
        if len(far):
            moved = self._sparse(state[:, far], codes[far])
            state = self.table.take(state + np.where(codes < self.width, codes, 0))
            state[:, far] = moved
            return state
        state += codes
        return self.table.take(state)

    def phrases(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of phrases (languages x rows) of codes (steps x rows), each parsed from its top, and the states at the end; a pad changes nothing."""
        count = np.zeros((len(self.langs), codes.shape[1]), np.int32)
        state = np.repeat(self.starts[:, None], codes.shape[1], axis=1)
        for row in codes:
            state = self._advance(state, row)
            count += state >> 30
        return count, state & (_FRESH - 1)

    def resumed(self, codes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """How many phrases more than phrases() gives if each row goes on in its state, the states at the end, and whether these are those of phrases().

        Both parses are followed until they are in the same states, from where on they are one.
        """
        more = np.zeros(state.shape, np.int32)
        fresh = np.repeat(self.starts[:, None], codes.shape[1], axis=1)
        for t, row in enumerate(codes):
            state, fresh = self._advance(state, row), self._advance(fresh, row)
            more += (state >> 30) - (fresh >> 30)
            if t % 16 == 15 and not ((state ^ fresh) & (_FRESH - 1)).any():
                return more, state & (_FRESH - 1), True
        return more, state & (_FRESH - 1), False

    def counts(self, texts: list[np.ndarray]) -> np.ndarray:
        """Numbers of phrases (languages x texts) of whole texts, given as points().

        Segments are parsed side by side, then each again from the state in which the one before ends, as far as that makes a difference; if it changes
        the state at its end, the next one is parsed once more.
        """
        sizes = np.array([len(p) for p in texts], np.int64)
        parts = -(-sizes // SEGMENT)
        total = np.zeros((len(self.langs), len(texts)), np.int64)
        if not parts.sum():
            return total
        owner = np.repeat(np.arange(len(texts)), parts)
        flat = self.code[np.concatenate(texts)]
        at = np.concatenate(([0], np.cumsum(sizes)))
        begin = at[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        size = np.minimum(SEGMENT, at[owner + 1] - begin)

        def groups(rows: np.ndarray):
            rows = rows[np.argsort(size[rows], kind="stable")]
            for group in np.array_split(rows, max(1, -(-len(rows) // ROWS))):
                steps = np.arange(int(size[group].max()))[:, None]
                yield group, np.where(steps < size[group][None, :], flat.take(np.minimum(begin[group][None, :] + steps, len(flat) - 1)), 0).astype(np.int32)

        found, ends = np.zeros((len(self.langs), len(owner)), np.int64), np.zeros((len(self.langs), len(owner)), np.int32)
        for group, codes in groups(np.arange(len(owner))):
            found[:, group], ends[:, group] = self.phrases(codes)
        more, open_ = np.zeros_like(found), np.flatnonzero(owner[1:] == owner[:-1]) + 1
        while len(open_):
            changed = []
            for group, codes in groups(open_):
                more[:, group], state, same = self.resumed(codes, ends[:, group - 1])
                if not same:
                    moved = (state != ends[:, group]).any(axis=0)
                    ends[:, group] = state
                    changed.append(group[moved] + 1)
            after = np.unique(np.concatenate(changed)) if changed else np.empty(0, np.int64)
            after = after[after < len(owner)]
            open_ = after[owner[after] == owner[after - 1]]
        for lang in range(len(self.langs)):
            total[lang] = np.bincount(owner, weights=found[lang] + more[lang], minlength=len(texts)).astype(np.int64)
        return total

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """The language of each text (und if it has no letter), a score: by what share the runner-up needs more than the winner, of the runner-up's need,
        and the bits that the winner needs for a character."""
        all_points = [points(t) for t in texts]
        lettered = [bool((p != 32).any()) for p in all_points]
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        need = self.counts([p if ok else p[:0] for p, ok in zip(all_points, lettered, strict=True)]) * self.bits[:, None]
        best = need.argmin(axis=0)
        ordered = np.sort(need, axis=0)
        second = ordered[1] if len(self.langs) > 1 else np.maximum(ordered[0], 1) * 2
        score = np.where(second > 0, 1 - ordered[0] / np.maximum(second, 1e-9), 0.0)
        each = ordered[0] / np.maximum(1, [len(p) for p in all_points])
        pick = lambda values: [float(x) if ok else 0.0 for x, ok in zip(values.tolist(), lettered, strict=True)]
        return [self.langs[i] if ok else "und" for i, ok in zip(best.tolist(), lettered, strict=True)], pick(score), pick(each)


def training_text(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, chars: int = TRAIN_CHARS, rows: int = TRAIN_ROWS) -> dict[str, str]:
    """A bounded sample of labelled text per language: whole texts, joined by line ends.

    Rows are taken by a hash of their id, about `rows` for each language (all if it has fewer), and then whole texts in the order of another hash as
    long as they fit in `chars` code points (TRAIN_TOTAL is shared by the languages). No text may take more than a fourth of that, so that none stands for its language;
    only a language that has no shorter one in the sample is learned from the beginnings of its texts. The texts come to the driver: rows * TRAIN_TOTAL / 4 code points
    in the mean at most. The first MOST_LANGUAGES languages by name are learned, more are an error.
    """
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return {}
    chars = min(chars, TRAIN_TOTAL // len(sizes))
    most = max(1, chars // 4)
    share = F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 30))
    within = F.lit(False)
    for lang, n in sizes.items():
        within = within | ((F.col(lang_col) == lang) & (share < int(min(1.0, rows / n) * (1 << 30))))
    cut = F.length(text_col) > most
    picked = known.filter(within).select(F.col(lang_col).alias("lang"), F.xxhash64(F.lit("order"), id_col).alias("h"), F.substring(F.col(text_col), 1, most).alias("t"), cut.alias("cut")).collect()
    whole = {r["lang"] for r in picked if not r["cut"] and r["t"]}
    out: dict[str, list[str]] = {k: [] for k in sizes}
    room = dict.fromkeys(sizes, chars)
    for r in sorted(picked, key=lambda r: (r["h"], r["t"])):
        if r["t"] and r["cut"] == (r["lang"] not in whole) and len(r["t"]) <= room[r["lang"]]:
            out[r["lang"]].append(r["t"])
            room[r["lang"]] -= len(r["t"])
    return {k: "\n".join(v) for k, v in out.items() if v}


def _model(sent: Broadcast) -> Model:
    """The worker's model of this sample."""
    texts = sent.value
    return held(("langid", hashlib.sha256(repr(sorted(texts.items())).encode("utf-8", "surrogatepass")).digest()), lambda: Model(texts))


def identify(docs: DataFrame, texts: dict[str, str], text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", bits_col: str = "bits_per_char") -> DataFrame:
    """docs with the predicted language of each whole text, a score from 0 to 1, and the bits that its parse needs for a character.

    A text that is null or has no letter is `und`, with score and bits 0; of languages that need the same, the first by name wins,
    with score 0. Without any labelled text all is `und`. Repeated rows are told one by one; an empty table gives an empty table. Rows, order and other
    columns stay; columns named as the new ones are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(texts)  # bounded, see training_text
    new = (lang_col, score_col, bits_col)
    kept = [f for f in docs.schema.fields if f.name not in new]
    src = docs.select(*[docs[f"`{f.name}`"] for f in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent)
        for batch in batches:
            at = batch.schema.names.index(text_col)
            start = 0
            while start < batch.num_rows:
                end, held, values = start, 0, batch.column(at)
                while end < batch.num_rows and held < 2_000_000:
                    held += len(values[end].as_buffer() or b"") if values[end].is_valid else 0
                    end += 1
                langs, scores, bits = model([x or "" for x in values.slice(start, end - start).to_pylist()])
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())], names=[*part.schema.names, *new])
                start = end

    schema = T.StructType([*kept, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType()), T.StructField(bits_col, T.DoubleType())])
    return shipped(src).mapInArrow(run, schema)


def fold(id_col: str, folds: int = 4) -> Column:
    """The fold of a row: crc32 of its id as text, modulo folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def keep_identified(docs: DataFrame, texts: dict[str, str], text_col: str = "text", lang_col: str = "lang", languages: list[str] | None = None, most_bits: float = 8.0) -> DataFrame:
    """docs whose language is told, with it in lang_col; all other columns as they were.

    Rows go whose language is `und` or, if languages are given, none of these; and rows in which even the best language needs more than most_bits bits for
    a character, as texts in a script that none was learned in do: bytes alone would take no more. Cases as in identify(). A column lang_col is added where
    there's none.
    """
    named = identify(docs, texts, text_col, "_lang_pred", "_lang_score", "_lang_bits").filter((F.col("_lang_pred") != "und") & (F.col("_lang_bits") <= most_bits))
    if languages is not None:
        named = named.filter(F.col("_lang_pred").isin(languages))
    return named.withColumn(lang_col, F.col("_lang_pred")).drop("_lang_pred", "_lang_score", "_lang_bits")
