"""Content-addressed WARC archive.

Each payload is stored once under its SHA-256.  Record headers, byte for byte as they stand in the
record, are kept in a table of their own with the key of their payload.  Reading joins both,
rebuilds the original record, parses it again and checks the payload against the length and
SHA-1 that its header states, so a digest that met two payloads could not pass unseen.

Of records with equal payloads of at least ``min_bytes`` the one with the largest page id is the
response and the others are revisits that refer to it; smaller ones are all responses.

Keys shared by many records are dealt to several tasks on reading.

Defined edge cases: null html is the empty payload; null urls give an empty target and line ends in
urls are percent-encoded; other columns are not archived; very long payloads are one value each; of equal
payloads whose ids are all null, all are responses; a null id is smaller than any other; rows with
the same id and payload are the same record written twice and get the same type.
An empty table gives an empty archive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

MIN_BYTES = 1000
#: Records of one payload that are read together; more are dealt to several tasks.
RECORDS_TOGETHER = 1 << 14
#: Records carry this date, so that archives of the same pages are the same bytes.
DATE = "1970-01-01T00:00:00Z"
END = "\r\n"


@dataclass(frozen=True)
class Archive:
    payloads: DataFrame
    headers: DataFrame


def _record_name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def header_bytes(page_id: Column, url: Column, kind: Column, length: Column, digest: Column, refers_to: Column) -> Column:
    """The header of a WARC/1.1 record up to and with the empty line, as bytes."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    safe_url = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", _record_name(page_id)),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", safe_url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(kind == "revisit", line("WARC-Refers-To", _record_name(refers_to))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(length.cast("string"))),
        F.lit(END),
    ).cast("binary")


def write_archive(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> Archive:
    """Write both tables of the archive to the shared folder.

    Payload bytes cross the network once, pre-aggregated, so a payload that a third of all
    pages share is one row from each task.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    named = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    store = materialize(
        named.groupBy("key").agg(F.max("page_id").alias("last_id"), F.first("payload").alias("payload"), F.count(F.lit(1)).alias("n")).select("key", "last_id", F.length("payload").alias("stored_bytes"), "payload", F.ceil(F.col("n") / RECORDS_TOGETHER).cast("int").alias("deals")), "warc-payloads"
    )
    meta = named.select("page_id", "url", "key", F.length("payload").cast("long").alias("length"), F.sha1("payload").alias("digest"))
    last = store.where((F.col("stored_bytes") >= min_bytes) | (F.col("deals") > 1)).select("key", F.when(F.col("stored_bytes") >= min_bytes, F.col("last_id")).alias("last_id"), "deals")
    known = meta.join(last, "key", "left")
    deal = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("deals", F.lit(1))).cast("int")
    kind = F.when(F.col("last_id").isNull() | F.col("page_id").eqNullSafe(F.col("last_id")), F.lit("response")).otherwise(F.lit("revisit"))
    headers = known.select("page_id", "key", deal.alias("deal"), header_bytes(F.col("page_id"), F.col("url"), kind, F.col("length"), F.col("digest"), F.col("last_id")).alias("header"))
    return Archive(store, materialize(headers, "warc-headers"))


def _field(header: Column, name: str) -> Column:
    return F.regexp_extract(header, f"(?md)^{name}: ([^\\r\\n]*)", 1)


def read_archive(archive: Archive) -> DataFrame:
    """One row per record: page_id, ``record`` (its exact bytes), type, digest, length, refers_to.

    Only responses carry the payload in their record; revisits check the one they refer to.
    """
    stored = archive.payloads.select("key", "payload", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    joined = archive.headers.join(stored, ["key", "deal"]).withColumn("record_type", _field(F.col("header").cast("string"), "WARC-Type"))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    joined = joined.withColumn("record", F.concat("header", body, F.lit(END * 2).cast("binary")))
    # From here on the rebuilt record is parsed; a revisit's payload is that of the record it refers to.
    whole = F.col("record").cast("string")
    at = F.instr(whole, END * 2)
    joined = joined.withColumn("head", F.substring(whole, F.lit(1), at + 1)).withColumn(
        "body", F.when(_field(F.col("head"), "WARC-Type") == "response", F.substring(whole, at + 4, F.length(whole) - at - 7).cast("binary")).otherwise(F.col("payload"))
    )
    joined = joined.withColumns({"payload_digest": F.sha1("body"), "payload_bytes": F.octet_length("body").cast("long")})
    text = F.col("head")
    stated = _field(text, "Content-Length").cast("long")
    is_response = _field(text, "WARC-Type") == "response"
    good = (F.concat(F.lit("sha1:"), F.col("payload_digest")) == _field(text, "WARC-Payload-Digest")) & (stated == F.when(is_response, F.col("payload_bytes")).otherwise(F.lit(0)))
    refers = F.regexp_extract(_field(text, "WARC-Refers-To"), "^<urn:page:(-?[0-9]+)>$", 1)
    own = F.regexp_extract(_field(text, "WARC-Record-ID"), "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(c != "", c).cast("long")
    return joined.select(
        number(own).alias("page_id"),
        F.when(good, F.col("payload_bytes")).otherwise(F.raise_error(F.lit("payload does not match the digest in its header")).cast("long")).alias("payload_bytes"),
        "payload_digest", _field(text, "WARC-Type").alias("record_type"), number(refers).alias("refers_to"), "record",
    )


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archive(write_archive(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes < {MIN_BYTES} OR page_id IS NOT DISTINCT FROM last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < {MIN_BYTES} OR page_id IS NOT DISTINCT FROM last_id THEN NULL ELSE last_id END AS refers_to
FROM d
"""
