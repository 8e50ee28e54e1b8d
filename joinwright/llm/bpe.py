"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

Each text is cut where a rolling hash of its last 16 bytes says so, so a passage that several documents share is cut
at the same places in each. A chunk's core runs from its first to its last agreement point: a place where the pre-tokenizer starts a new piece
whatever stands further left or right, in any script. Cores are encoded once and reused. A join, from the last agreement point of one core to the first
of the next, is encoded with a little of both cores, and its ids are compared with theirs; where they differ, the window grows, to
the whole text if need be. A chunk without two agreement points is part of a join. Hence the ids are those of the whole text, whatever the cuts.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .scratch import held, shipped

#: The pre-tokenizer's pattern of this family of byte-level vocabularies, white space spelt out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

CHUNK_BITS = 10  # chunks of about 1 KB
CACHE_BYTES = 32_000_000  # of cores that one Python worker keeps
PIECES, PIECE_CHARS = 50_000, 40  # pieces of joins that it keeps, and the longest of them
SLICE_BYTES = 2_000_000  # of text whose ids are held at once


def _byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabularies: bytes that print stand for themselves, others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _classes() -> bytes:
    """By code point below 2^16: 1 letter, 2 number, 3 other visible character, 4 apostrophe, 0 white space and all on which versions of Unicode may differ."""
    old, out = unicodedata.ucd_3_2_0, bytearray(1 << 16)
    for i in range(1 << 16):
        c = chr(i)
        kind = unicodedata.category(c)[0]
        if kind in "LNPSM" and old.category(c)[0] == kind:
            out[i] = 1 if kind == "L" else 2 if kind == "N" else 3
    out[ord("'")] = 4
    return bytes(out)


@lru_cache(maxsize=1)
def _ascii_pairs() -> bytes:
    """By two ASCII characters (the first in the upper 7 bits): 1 if a piece starts at the second whatever surrounds them, 2 if it does so before a visible character."""
    of, out = _classes(), bytearray(1 << 14)
    for a in range(128):
        for b in range(128):
            if of[a]:
                out[a << 7 | b] = 2 if b == 32 else bool(of[b]) and of[a] != 4 and of[a] != of[b] and (of[a], of[b]) != (3, 4)
    return bytes(out)


class _Pieces(dict):
    """The ids of pre-tokenizer pieces as bytes of uint32; emptied when it has PIECES of them."""

    def __init__(self, encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encoding._encode_single_piece(piece), np.uint32).tobytes()
        if len(piece) <= PIECE_CHARS:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encodes and decodes whole texts as the tokenizers library does with the vocabulary file at path."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES, chunk_bits: int = CHUNK_BITS):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = _byte_of_char()
        ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in of for c in token)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {b: i for b, i in ranks.items() if i not in set(special.values())}
        self.pieces = _Pieces(tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special))
        self.find, self.classes = regex.compile(PATTERN).findall, _classes()
        self.pairs = _ascii_pairs()
        self.special = {t: np.array([i], np.uint32).tobytes() for t, i in special.items()}
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")").split if special else None
        of_id = {i: b for b, i in ranks.items()} | {i: t.encode() for t, i in special.items()}
        self.bytes_of = [of_id.get(i, b"") for i in range(max(of_id) + 1)]
        self.bytes_at = np.array(self.bytes_of, object)
        self.names_at = np.array([b",%d" % i for i in range(len(self.bytes_of))], object)
        self.cache: OrderedDict[bytes, bytes] = OrderedDict()
        self.cached, self.cache_bytes = 0, cache_bytes
        self.top = np.uint32(32 - chunk_bits)
        self.gear = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
        self.reused = self.widened = 0

    def _small(self, segment: bytes) -> bytes:
        """The ids of a segment, piece by piece."""
        return b"".join(map(self.pieces.__getitem__, self.find(segment.decode("utf-8"))))

    def _plain(self, segment: bytes) -> bytes:
        try:
            return self.pieces.encoding.encode_to_numpy(segment.decode("utf-8"), disallowed_special=()).tobytes()
        except BaseException as e:  # its regular expression engine gives up on some runs of a million characters
            if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            return self._small(segment)

    def _core(self, segment: bytes) -> bytes:
        key = hashlib.blake2b(segment, digest_size=16).digest() if len(segment) > 64 else segment
        ids = self.cache.get(key)
        if ids is not None:
            self.cache.move_to_end(key)
            self.reused += 1
            return ids
        ids = self.cache[key] = self._plain(segment)
        self.cached += len(ids) + 200
        while self.cached > self.cache_bytes:
            self.cached -= len(self.cache.popitem(last=False)[1]) + 200
        return ids

    def _class(self, data: bytes, i: int) -> int:
        """The class of the character that starts at i; 32 for a space."""
        b = data[i]
        if b < 128:
            return 32 if b == 32 else self.classes[b]
        if b < 0xE0:
            return self.classes[(b & 31) << 6 | data[i + 1] & 63]
        return self.classes[(b & 15) << 12 | (data[i + 1] & 63) << 6 | data[i + 2] & 63] if b < 0xF0 else 0

    def agrees(self, data: bytes, i: int) -> bool:
        """Whether a new piece starts at byte i, whatever stands before the character before it: at a space between visible characters, or where letters,
        numbers and other visible characters meet, but for what may follow an apostrophe."""
        if not 0 < i < len(data) - 1:
            return False
        a, b = data[i - 1], data[i]
        if a < 128 and b < 128:
            kind = self.pairs[a << 7 | b]
            return kind == 1 or kind == 2 and self._class(data, i + 1) in (1, 2, 3, 4)
        if b & 0xC0 == 0x80:
            return False
        j = i - 1
        while data[j] & 0xC0 == 0x80:
            j -= 1
        before, here = self._class(data, j), self._class(data, i)
        if before in (0, 32) or not here:
            return False
        if here == 32:
            return self._class(data, i + 1) in (1, 2, 3, 4)
        return before != 4 and before != here and not (before == 3 and here == 4)

    def _next(self, data: bytes, i: int, end: int) -> int:
        """The first agreement point from i on and before end, or -1."""
        while i < end and not self.agrees(data, i):
            i += 1
        return i if i < end else -1

    def _last(self, data: bytes, i: int, start: int) -> int:
        """The last agreement point up to i and after start, or -1."""
        while i > start and not self.agrees(data, i):
            i -= 1
        return i if i > start else -1

    def cores(self, data: bytes) -> list[tuple[int, int]]:
        """(start, end) of the cores of data, in order."""
        if len(data) < 64:
            return []
        h = self.gear[np.frombuffer(data, dtype=np.uint8)]
        for shift in (1, 2, 4, 8):  # afterwards h[i] sums what 16 bytes up to i stand for, each shifted by its distance
            h[shift:] += h[:-shift] << np.uint32(shift)
        cuts = (np.flatnonzero(h[16:] >> self.top == 0) + 17).tolist()
        out = []
        for s, e in pairwise([0, *cuts, len(data)]):
            first = self._next(data, s, e)
            last = self._last(data, e - 1, first) if first >= 0 else -1
            if last > first:
                out.append((first, last))
        return out

    def _agreed(self, ids: bytes, size: int, core: bytes, tail: bool) -> int:
        """How many bytes of ids stand for the last (tail) or first `size` bytes of a core and are its own; -1 if there's no such token boundary or they differ."""
        done, n, each = 0, 0, np.frombuffer(ids, np.uint32).tolist()
        for i in each if tail else reversed(each):
            if done >= size:
                break
            done += len(self.bytes_of[i])
            n += 4
        if done != size:
            return -1
        return n if (core.endswith(ids[:n]) if tail else core.startswith(ids[-n:])) else -1

    def _join(self, data: bytes, left: tuple[int, int] | None, right: tuple[int, int] | None, before: bytes, after: bytes) -> bytes | None:
        """The ids between two cores (None: the text's start or end), agreed with those of both; None if they agree nowhere."""
        s, e = left[1] if left else 0, right[0] if right else len(data)
        p, q = s, e
        while True:
            p = max(self._last(data, p - 1, left[0]), left[0]) if left else 0
            q = self._next(data, q + 1, right[1]) if right else e
            q = right[1] if q < 0 else q
            ids = self._small(data[p:q])
            head = self._agreed(ids, s - p, before, True) if left else 0
            foot = self._agreed(ids, q - e, after, False) if right else 0
            if head >= 0 and foot >= 0:
                return ids[head : len(ids) - foot]
            self.widened += 1
            if (not left or p == left[0]) and (not right or q == right[1]):
                return None

    def _ordinary(self, data: bytes) -> bytes:
        cores = self.cores(data)
        if not cores:
            return self._plain(data)
        ids = [self._core(data[s:e]) for s, e in cores]
        out = []
        for i in range(len(cores) + 1):
            left, right = (cores[i - 1] if i else None), (cores[i] if i < len(cores) else None)
            joined = self._join(data, left, right, ids[i - 1] if i else b"", ids[i] if right else b"")
            if joined is None:
                return self._plain(data)
            out.append(joined)
            if right:
                out.append(ids[i])
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        parts = self.split(text) if self.split and any(t in text for t in self.special) else [text]
        return np.frombuffer(b"".join(self.special[x] if i % 2 else self._ordinary(x.encode("utf-8")) for i, x in enumerate(parts) if x), np.uint32)

    def decode(self, ids) -> str:
        """The text of ids, special tokens as their strings; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(self.bytes_at[np.asarray(ids, np.int64)].tolist()).decode("utf-8", "replace")

    def listed(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return b"".join(self.names_at[ids].tolist())[1:]


def codec(path: str) -> Codec:
    """The worker's codec, with the cores it has encoded. The file is at path, or where sent() has put it."""
    return held(("bpe", path), lambda: Codec(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))))


def sent(df: DataFrame, path: str) -> DataFrame:
    """df, once the package and the vocabulary file at path on the driver have been sent to the executors; a file that only they have is left there."""
    sc = df.sparkSession.sparkContext
    gone: set[str] = getattr(sc, "_joinwright_files", set())
    if path not in gone and os.path.exists(path):
        sc.addFile(path)
        sc._joinwright_files = gone | {path}
    return shipped(df)


def _slices(batch: pa.RecordBatch, text: pa.Array) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of the batch whose texts have about SLICE_BYTES; one text is never divided."""
    lengths = np.array([0 if x is None else x for x in pa.compute.binary_length(text).to_pylist()], dtype=np.int64)
    part = np.cumsum(lengths) // SLICE_BYTES
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    for s, e in zip(bounds, bounds[1:], strict=False):
        if s < e:
            yield batch.slice(s, e - s), text.slice(s, e - s).to_pylist()


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids_col (array of int): the ids of the whole text, as the tokenizers library gives them with the vocabulary
    file at path and add_special_tokens=False. The file is sent to the executors.

    A null text counts as the empty text, which has no ids. Repeated rows are encoded one by one, an empty table gives an empty table. Rows, order and
    other columns stay; a column of the same name as ids_col is replaced. Memory: one slice of texts and ids, the cached cores, a fixed number of bytes, and the cached pieces.
    """
    kept = [f for f in docs.schema.fields if f.name != ids_col]
    src = docs.select(*[docs[f"`{f.name}`"] for f in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part, texts in _slices(batch, batch.column(batch.schema.names.index(text_col))):
                ids = [c.encode(t) for t in texts]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[*part.schema.names, ids_col])

    return sent(src, path).mapInArrow(run, T.StructType([*kept, T.StructField(ids_col, T.ArrayType(T.IntegerType(), True))]))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with text_col: the text of ids_col, as decode(ids, skip_special_tokens=False) gives it; null ids give the empty text.

    Rows, order and other columns stay; a column named as text_col is replaced. An empty table gives an empty table.
    """
    kept = [f for f in rows.schema.fields if f.name != text_col]
    src = rows.select(*[rows[f"`{f.name}`"] for f in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            at = batch.schema.names.index(ids_col)
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                texts = [c.decode(x or []) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, text_col])

    return sent(src, path).mapInArrow(run, T.StructType([*kept, T.StructField(text_col, T.StringType())]))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Digests of each text's ids and of the text decoded from them: id_col, n_tokens, ids_sha256, decoded_sha256;
    with_ids adds the ids.

    Encodes and decodes with the codec of encode() and decode(), in one pass through one Python worker a task; decoded texts don't go back to the JVM.
    A null text counts as the empty text; null and repeated ids are kept, row by row. Columns other than the id and the text are not read. An empty table
    gives an empty table.
    """
    kind = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    out = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType(), True))] if with_ids else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part, texts in _slices(batch, batch.column(1)):
                sizes, digests, decoded, kept = [], [], [], []
                for t in texts:
                    ids = c.encode(t)
                    sizes.append(len(ids))
                    digests.append(hashlib.sha256(c.listed(ids)).hexdigest())
                    decoded.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                    if with_ids:
                        kept.append(ids.astype(np.int32))
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(kept))))
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return sent(docs, path).select(docs[id_col], docs[text_col]).mapInArrow(run, out)
