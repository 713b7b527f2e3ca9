"""A content-addressed web archive: payloads once by digest, record headers apart.

``write`` makes two tables below one folder. ``payloads`` holds each distinct payload once
under its SHA-256; ``headers`` holds the exact header bytes of every WARC record with the
digest of its payload. ``read`` puts records together again by a join on the digest and
checks every payload against it. Payload bytes cross the network once, keyed by digest and
page, so copies of one payload do not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_PAGE = -(1 << 63)
CRLF = "\r\n"
# Fixed value: the profile of a revisit by equal payload digests.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_TIME = "1970-01-01T00:00:00Z"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of a hex text whose length is a multiple of ten (forty for SHA-1)."""
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(kind: Column, page: Column, url: Column, sha1: Column, refers: Column, size: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    uri = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "%20")
    return F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", kind), line("WARC-Record-ID", urn(page)), line("WARC-Target-URI", uri),
        line("WARC-Date", F.lit(EMPTY_TIME)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(kind == "revisit", F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", urn(refers)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(size.cast("string"))), F.lit(CRLF),
    ).cast("binary")


def write(pages: DataFrame, path: str, key: str = "page_id", min_bytes: int = 0) -> None:
    """Write a record for every row: payload is ``html`` in UTF-8, null as empty.

    Of rows with equal payloads of ``min_bytes`` or more, that with the largest key is the
    response and the others revisit it; smaller payloads are all responses. A null key
    sorts below all others. Rows that repeat the response's key and payload are responses
    too, of the one stored payload.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("pid", F.coalesce("page", F.lit(NO_PAGE)))
    first = rows.select("digest", "pid").groupBy("digest").agg(F.max("pid").alias("pid"))
    stored = rows.select("digest", "pid", "payload").join(first, ["digest", "pid"]).dropDuplicates(["digest", "pid"])
    stored.select("digest", "payload").write.mode("overwrite").parquet(f"{path}/payloads")
    facts = rows.select("page", "url", "digest", "pid", F.length("payload").cast("long").alias("size"), base32(F.sha1("payload")).alias("sha1"))
    own = facts.join(first.withColumnRenamed("pid", "first"), "digest")
    kind = F.when((F.col("pid") == F.col("first")) | (F.col("size") < min_bytes), "response").otherwise("revisit")
    refers = F.when(F.col("first") != NO_PAGE, F.col("first"))
    header = _header(kind, F.col("page"), F.col("url"), F.col("sha1"), refers, F.col("size"))
    own.select("digest", header.alias("header")).write.mode("overwrite").parquet(f"{path}/headers")


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest and the record's bytes.

    A payload that does not match its digest stops the read. What is not selected, such as
    the payload itself, is not moved.
    """
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))).cast("binary")
    )
    stored = stored.select("digest", sound.alias("payload"))
    stored = stored.select("digest", "payload", F.length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))
    headers = spark.read.schema("digest string, header binary").parquet(f"{path}/headers")
    head = headers.withColumn("_h", F.decode("header", "UTF-8"))
    field = lambda name, what: F.regexp_extract("_h", rf"(?m)^{name}: {what}\r?$", 1)
    page = lambda name: field(name, r"<urn:page:(-?[0-9]+)>")
    number = lambda c: F.when(c != "", c.cast("long"))
    head = head.select(
        "digest", "header", number(page("WARC-Record-ID")).alias("page_id"), field("WARC-Target-URI", "(.*?)").alias("url"),
        field("WARC-Type", "([a-z]+)").alias("record_type"), number(page("WARC-Refers-To")).alias("refers_to"),
    )
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return head.join(stored, "digest").select(
        "page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest",
        F.concat("header", block, F.lit((CRLF + CRLF).encode())).alias("record"),
    )
