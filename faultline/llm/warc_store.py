"""Content-addressed WARC archive: payloads once by verified digest, exact record headers apart."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Payloads shorter than this are never stored by digest; they stay beside their headers.
LEAST_SHARED = 100
#: First pages of payloads are broadcast to the texts up to this many, else joined by a shuffle.
BROADCAST_OWNERS = 100_000
WARC_DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "page_id long, warc_header string, http_header string, digest string, `check` long, inline binary"
PAYLOAD_SCHEMA = "digest string, `check` long, payload binary"


def _uuid(page_id: Column) -> Column:
    """A record id that depends on the page alone."""
    h = F.md5(F.coalesce(page_id.cast("string"), F.lit("")).cast("binary"))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts)), F.lit(">"))


def _one_line(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archive(pages: DataFrame, path: str, date: str = WARC_DATE) -> None:
    """Write ``pages`` (page_id, url, html) as tables ``records`` and ``payloads`` below ``path``.

    Every row gives one WARC record. Among equal payloads of at least
    ``LEAST_SHARED`` bytes, the one with the smallest page_id is a response
    and the others revisit it; shorter payloads are all responses. Payloads
    are equal when SHA-256, a second 64-bit hash and length agree. Null html
    is an empty payload; a null url gives no target header; line breaks in a
    url are percent-encoded. Repeated rows with the smallest page_id are all
    responses on one stored payload. A page without a page_id never is the
    smallest: it revisits a page that has one, and where no page with its
    payload has one, all of them are responses on one stored payload. Only digests, ids and urls are grouped
    and joined; the first copies, whose count is checked, are picked by a
    broadcast, or by a shuffle that moves each payload once. An empty table gives empty tables.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").alias("url"),
        html.alias("payload"),
        F.sha2(html, 256).alias("digest"),
        F.xxhash64(html).alias("check"),
        F.octet_length(html).cast("long").alias("n"),
    )
    key = ["digest", "check", "n"]
    slim = base.select("page_id", "url", *key, F.when(F.col("n") < LEAST_SHARED, F.col("payload")).alias("inline"))
    owners = stored(slim.filter(F.col("n") >= LEAST_SHARED).groupBy(*key).agg(F.min("page_id").alias("owner")))
    owned = slim.join(owners, key, "left")
    revisit = (F.col("owner").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("n").cast("string"),
        F.lit("\r\n\r\n"),
    )
    length = F.octet_length("http_header") + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    field = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", _uuid(F.col("page_id"))),
        field("WARC-Date", F.lit(date)),
        F.coalesce(field("WARC-Target-URI", _one_line(F.col("url"))), F.lit("")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.coalesce(field("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        F.when(
            revisit,
            F.concat(
                field("WARC-Profile", F.lit(REVISIT_PROFILE)),
                field("WARC-Refers-To", _uuid(F.col("owner"))),
                field("X-Refers-To-Page-ID", F.col("owner").cast("string")),
            ),
        ).otherwise(F.lit("")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    records = owned.withColumn("http_header", http).select(
        "page_id", header.alias("warc_header"), "http_header", "digest", "check", "inline"
    )
    records.write.parquet(f"{path}/records")
    first = owners.select(F.col("owner").alias("page_id"), *key)
    if owners.limit(BROADCAST_OWNERS + 1).count() <= BROADCAST_OWNERS:
        first = F.broadcast(first)
    # Null-safe: a payload that only pages without an id have is owned by such a page.
    own = [F.col("p.page_id").eqNullSafe(F.col("f.page_id")), *(F.col(f"p.{c}") == F.col(f"f.{c}") for c in key)]
    kept = base.filter(F.col("n") >= LEAST_SHARED).alias("p").join(first.alias("f"), own).select("p.page_id", *(f"p.{c}" for c in key), "p.payload")
    again = slim.groupBy("page_id").count().filter("`count` > 1")
    if not again.isEmpty():  # a repeated first row would store its payload twice
        kept = kept.dropDuplicates(key)
    kept.select("digest", "check", "payload").write.parquet(f"{path}/payloads")


def record_bytes() -> Column:
    """The record as it stands in a WARC file, without the two line breaks after it; a revisit has no payload."""
    return F.concat(F.col("warc_header").cast("binary"), F.col("http_header").cast("binary"), F.coalesce("payload", F.lit(b"")))


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """(record): every record of an archive as bytes, headers joined with payloads."""
    records = spark.read.schema(RECORD_SCHEMA).parquet(f"{path}/records")
    payloads = spark.read.schema(PAYLOAD_SCHEMA).parquet(f"{path}/payloads")
    # Revisits and inline payloads need no stored one; their key is null and joins nothing.
    sought = (_header("WARC-Type") == "response") & F.col("inline").isNull()
    rows = records.withColumn("sought", F.when(sought, F.col("digest")))
    kept = payloads.select(F.col("digest").alias("sought"), F.col("check").alias("check_"), "payload")
    rows = rows.join(kept, (rows["sought"] == kept["sought"]) & (rows["check"] == kept["check_"]), "left")
    return rows.withColumn("payload", F.coalesce("inline", "payload")).select(record_bytes().alias("record"))


def _header(name: str) -> Column:
    return F.regexp_extract("warc_header", rf"\n{name}: ([^\r\n]*)\r\n", 1)


def parsed(records: DataFrame) -> DataFrame:
    """Fields and payload of WARC records (record: bytes), read from the bytes alone; lengths come from the headers."""
    end = F.lit("\r\n\r\n")
    head = F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1)
    rows = records.withColumn("warc_header", F.concat(head, end))
    stated = _header("Content-Length").try_cast("int")
    rows = rows.withColumn("block", F.substring("record", F.octet_length("warc_header") + 1, stated))
    rows = rows.withColumn("http_header", F.concat(F.substring_index(F.col("block").cast("string"), "\r\n\r\n", 1), end))
    whole = F.octet_length("record") == F.octet_length("warc_header") + stated
    rest = F.substring("block", F.octet_length("http_header") + 1, F.octet_length("block"))
    return rows.select(
        F.nullif(_header("X-Page-ID"), F.lit("")).cast("long").alias("page_id"),
        F.nullif(_header("WARC-Target-URI"), F.lit("")).alias("url"),
        _header("WARC-Type").alias("record_type"),
        F.nullif(_header("X-Refers-To-Page-ID"), F.lit("")).cast("long").alias("refers_to"),
        F.substring(_header("WARC-Payload-Digest"), 8, 64).alias("payload_digest"),
        F.regexp_extract("http_header", r"Content-Length: ([0-9]+)\r\n", 1).cast("long").alias("payload_bytes"),
        F.when(_header("WARC-Type") == "response", rest).alias("payload"),
        "warc_header",
        "http_header",
        whole.alias("whole"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive, rebuilt as bytes and parsed; one row for each record.

    Columns: the fields read from the record, ``payload`` (null for a
    revisit) and ``verified``. A response is verified when the record has its
    stated length and the payload's bytes the digest and the length that the
    headers state; a revisit when the record that it refers to is a response
    with its digest.
    """
    rows = parsed(rebuilt(spark, path))
    sound = (F.sha2("payload", 256) == F.col("payload_digest")) & (F.octet_length("payload") == F.col("payload_bytes"))
    rows = rows.withColumn("sound", F.coalesce(F.col("whole") & sound, F.lit(False)))
    # Of the records table only headers are read for this; no payload moves.
    heads = spark.read.schema(RECORD_SCHEMA).parquet(f"{path}/records").filter(_header("WARC-Type") == "response")
    targets = heads.select(F.col("page_id").alias("refers_to"), F.col("digest").alias("payload_digest"), F.lit(True).alias("there"))
    revisits = F.when(F.col("record_type") == "revisit", F.col("refers_to"))
    rows = rows.withColumn("refers_to", revisits).join(targets.distinct(), ["refers_to", "payload_digest"], "left")
    there = F.coalesce(F.col("whole") & F.col("there"), F.lit(False))
    verified = F.when(F.col("record_type") == "response", F.col("sound")).otherwise(there)
    return rows.withColumn("verified", verified).drop("sound", "there", "whole")


def export_warc(rows: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write rebuilt records as WARC files, one after the other."""
    rows.select(record_bytes().cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option(
        "compression", compression
    ).text(path)


def warc_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read it back; a record that fails its digest is an error."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(pages, path)
    rows = read_archive(spark, path)
    digest = F.when(F.col("verified"), F.col("payload_digest")).otherwise(
        F.raise_error(F.lit("payload does not have the digest of its record"))
    )
    return rows.select(
        "page_id",
        "payload_bytes",
        digest.alias("payload_digest"),
        "record_type",
        "refers_to",
    )
