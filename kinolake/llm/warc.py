"""Content-addressed WARC archive: payload bytes once by verified digest, record headers apart, records rebuilt by joins.

The payload store is keyed by SHA-256 and has one row per distinct payload, grouped by digest and bytes, so equal digests of
different bytes would show as two rows and stop the write. SHA-1 is only a field of the header: payloads that clash in it are two payloads.
The header store has each record's exact header block and the key of its payload. A record is header + payload (none for a revisit) + two line
ends. Of records with equal payloads of at least `least` bytes that with the largest page_id is the response and the others revisit it;
rows that share the largest page_id are all responses, null page_ids count as smallest. Null html is the
empty payload; a null url is written as an empty target. Empty tables write empty stores; payloads of any length are whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"


def _payload(pages: DataFrame):
    return F.encode(F.coalesce(pages["html"].cast("string"), F.lit("")), "UTF-8")


def write_archive(pages: DataFrame, path: str, least: int = LEAST, date: str = DATE) -> None:
    """Writes path/payloads and path/headers."""
    spark = pages.sparkSession
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), F.coalesce(pages["url"].cast("string"), F.lit("")).alias("url"), _payload(pages).alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("key"), F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("length"))
    payloads = rows.groupBy("key", "payload").agg(F.max("page_id").alias("first_id"))
    payloads.select("key", "first_id", F.octet_length("payload").cast("long").alias("length"), "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    index = spark.read.parquet(f"{path}/payloads").select("key", "first_id")
    clash = index.groupBy("key").count().where("count > 1").limit(1)
    if not clash.isEmpty():
        raise ValueError("two payloads have one digest")
    named = rows.drop("payload").join(index, "key")
    response = (F.col("length") < least) | F.col("page_id").eqNullSafe(F.col("first_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(response, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        F.when(response, F.lit("")).otherwise(F.concat(line("WARC-Refers-To", urn(F.col("first_id"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        F.lit(f"WARC-Date: {date}\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("Content-Length", F.when(response, F.col("length")).otherwise(F.lit(0)).cast("string")),
        F.lit("\r\n"),
    )
    named.select("key", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def read_records(spark: SparkSession, path: str, with_bytes: bool = True) -> DataFrame:
    """One row per record, fields parsed from its header and from the payload that the store holds: page_id, url,
    record_type, refers_to, payload_bytes and payload_digest (taken again from the bytes read), and with_bytes the exact record."""
    store = spark.read.parquet(f"{path}/payloads")
    checked = F.when(F.sha2("payload", 256) == F.col("key"), F.sha1("payload")).otherwise(F.raise_error(F.lit("a stored payload doesn't match its digest")).cast("string"))
    held = store.select("key", F.octet_length("payload").cast("long").alias("payload_bytes"), checked.alias("payload_digest"), *(["payload"] if with_bytes else []))
    heads = spark.read.parquet(f"{path}/headers")
    field = lambda name, value="([^\r]*)": F.regexp_extract("header", f"\r\n{name}: {value}\r\n", 1)
    number = lambda name: F.try_to_number(F.nullif(field(name, "<urn:page:(-?[0-9]+)>"), F.lit("")), F.lit("S9999999999999999999")).cast("long")
    rows = heads.join(held, "key")
    out = [number("WARC-Record-ID").alias("page_id"), field("WARC-Target-URI").alias("url"), field("WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"), "payload_bytes", "payload_digest"]
    if with_bytes:
        body = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
        out.append(F.concat(F.encode("header", "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"))
    return rows.select(*out)


def warc(pages: DataFrame) -> DataFrame:
    """Writes the pages' archive to the shared folder and reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = scratch(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_records(pages.sparkSession, path, with_bytes=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
select page_id, payload_bytes, payload_digest,
       case when payload_bytes < 1000 or page_id is not distinct from first_id then 'response' else 'revisit' end as record_type,
       case when payload_bytes < 1000 or page_id is not distinct from first_id then null else first_id end as refers_to
from (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
             max(page_id) over (partition by coalesce(html, '')) as first_id from pages)
"""
