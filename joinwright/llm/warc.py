"""A content-addressed web archive: each payload stored once, record headers stored apart.

The archive is two tables in one folder: payloads (digest, payload) and records (the exact header
block of each record, its id, place, and the digest of its payload). Records are rebuilt by a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _header(kind: Column, page: Column, url: Column, digest: Column, refers: Column, length: Column, date: str) -> Column:
    """The header block of one WARC/1.1 record, with the empty line that ends it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    page_name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", page_name(refers)))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", page_name(page)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]+", " ")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(kind == "revisit", revisit).otherwise(F.lit("")),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(length.cast("string"))),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of pages into the archive at path.

    Payloads are the UTF-8 bytes of payload_col (null: none). They are grouped by SHA-256; the set of a group's
    payloads is kept, on the map side first, and the write fails if it has more than one, so a digest names one
    byte string. Of records with equal payloads of at least revisit_from bytes, the one with the largest id is
    the response and the others revisit it; if several rows carry that largest id, all of them are
    responses. A null id is larger than none. Shorter payloads are always responses. An empty table gives an
    empty archive.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("body"))
    rows = rows.withColumn("key", F.unhex(F.sha2("body", 256)))
    stored = rows.groupBy("key").agg(F.collect_set("body").alias("bodies"), F.max("id").alias("response_id"))
    same = F.when(F.size("bodies") == 1, F.col("bodies")[0]).otherwise(F.raise_error(F.lit("two payloads share a SHA-256 digest")).cast("string"))
    payload = F.encode(same, "UTF-8")
    stored.select("key", "response_id", F.octet_length(payload).cast("long").alias("length"), F.sha1(payload).alias("sha1"), payload.alias("payload")).write.parquet(f"{path}/payloads")
    spark = pages.sparkSession
    heads = spark.read.parquet(f"{path}/payloads").select("key", "response_id", "length", "sha1").hint("merge")
    named = rows.select("id", "url", "key").join(heads, "key")
    kind = F.when((F.col("length") >= revisit_from) & (F.col("id") < F.col("response_id")) | (F.col("length") >= revisit_from) & F.col("id").isNull() & F.col("response_id").isNotNull(), "revisit").otherwise("response")
    refers = F.when(F.col("kind") == "revisit", F.col("response_id"))
    named.withColumn("kind", kind).withColumn("refers_to", refers).select(
        "id", "key", "kind", "refers_to", _header(F.col("kind"), F.col("id"), F.col("url"), F.col("sha1"), F.col("refers_to"), F.col("length"), date).alias("header")
    ).write.parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: id, header, kind, refers_to, payload (a revisit has that of the record it refers to).

    The digest of every payload is computed again from its bytes; a payload that no longer matches fails the read.
    """
    records = spark.read.parquet(f"{path}/records")
    payloads = spark.read.parquet(f"{path}/payloads").select("key", "payload")
    sound = F.when(F.unhex(F.sha2("payload", 256)) == F.col("key"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")).cast("binary"))
    payloads = payloads.select("key", sound.alias("payload"), F.sha1(sound).alias("sha1"), F.octet_length(sound).cast("long").alias("length")).hint("merge")
    return records.join(payloads, "key").select("id", "header", "kind", "refers_to", "payload", "sha1", "length")


def record_bytes(archive: DataFrame) -> DataFrame:
    """id and the exact bytes of each WARC record of read_archive(): header block, body (none in a revisit), two line ends."""
    body = F.when(F.col("kind") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return archive.select("id", F.concat(F.encode("header", "UTF-8"), body, F.encode(F.lit(CRLF * 2), "UTF-8")).alias("record"))


def parse_records(records: DataFrame, id_type: str = "bigint", column: str = "record") -> DataFrame:
    """What the bytes of each record say: id, url, kind, refers_to, digest (of the header), body.

    Nothing else is read: fields come from the header block, the body is as long as Content-Length says. Bytes that are no record of
    that length fail the read. A record without an id, as one of a null id has, gives null.
    """
    t = F.decode(column, "ISO-8859-1")  # a character for each byte
    cut = records.select(t.alias("t"), F.instr(t, CRLF * 2).alias("at"))
    cut = cut.select("t", "at", F.substring("t", F.lit(1), F.col("at") + 1).alias("head"))
    field = lambda name: F.decode(F.encode(F.regexp_extract("head", f"(?m)^{name}: ([^\\r\\n]*)\\r?$", 1), "ISO-8859-1"), "UTF-8")
    page = lambda name: F.regexp_extract(field(name), "^<urn:page:(.*)>$", 1).try_cast(id_type)
    size = field("Content-Length").try_cast("int")
    whole = F.startswith("t", F.lit(f"WARC/1.1{CRLF}")) & F.endswith("t", F.lit(CRLF * 2)) & (F.col("at") > 0) & (F.length("t") == F.col("at") + 3 + size + 4)
    sound = F.when(whole, F.col("t")).otherwise(F.raise_error(F.lit("not a WARC record")).cast("string"))
    return cut.select(
        page("WARC-Record-ID").alias("id"), field("WARC-Target-URI").alias("url"), field("WARC-Type").alias("kind"), page("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"), F.encode(F.substring(sound, F.col("at") + 4, size), "ISO-8859-1").alias("body"),
    )


def resolved(parsed: DataFrame) -> DataFrame:
    """parse_records() as id, kind, refers_to, length, sha1: of the body, for a revisit of the body of the response that it refers to.

    A body, or the response of a revisit, that is not of the digest in the header fails the read. The bodies stay where they are; what is joined are
    lengths and digests, from a written table, so that adaptive execution can split a response that many records revisit.
    """
    own = F.sha1("body")
    sound = F.when((F.col("kind") == "revisit") | (own == F.col("digest")), own).otherwise(F.raise_error(F.lit("a payload does not match the digest in its header")).cast("string"))
    read = written(parsed.select("id", "kind", "refers_to", "digest", sound.alias("sha1"), F.octet_length("body").cast("long").alias("length")), "warc-read")
    said = read.filter("kind = 'response'").groupBy(F.col("id").alias("r"), F.col("sha1").alias("s")).agg(F.first("length").alias("n"))
    again = read.filter("kind = 'revisit'").join(said.hint("merge"), (F.col("refers_to") == F.col("r")) & (F.col("digest") == F.col("s")), "left")
    found = F.when(F.col("s").isNotNull(), F.col("s")).otherwise(F.raise_error(F.lit("a revisit refers to no such payload")).cast("string"))
    first = read.filter("kind = 'response'").select("id", "kind", "refers_to", "length", "sha1")
    return first.unionByName(again.select("id", "kind", "refers_to", F.col("n").alias("length"), found.alias("sha1")))


def export_warc(archive: DataFrame, path: str) -> None:
    """The records as WARC files under path, one per task; the two line ends that close a record are the writer's line separator."""
    body = F.when(F.col("kind") == "revisit", F.lit("")).otherwise(F.decode("payload", "UTF-8"))
    archive.select(F.concat("header", body).alias("value")).write.option("lineSep", CRLF * 2).text(path)


def _records_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    end = CRLF.encode() * 2
    for batch in batches:
        for content in batch.column(0):
            data, at = content.as_buffer().to_pybytes(), 0
            while at < len(data):
                head = data.find(end, at)
                size = re.search(rb"\r\nContent-Length: ([0-9]+)\r\n", data[at : head + 2]) if head >= 0 else None
                if not size:
                    raise ValueError("not a WARC file")
                to = head + 4 + int(size[1]) + 4
                yield pa.RecordBatch.from_arrays([pa.array([data[at:to]], pa.binary())], names=["record"])
                at = to


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records (record, binary) of the WARC files under path, each as long as its Content-Length says. A file is read by one task, and held by it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_records_of, "record binary")
