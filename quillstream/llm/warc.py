"""Content-addressed WARC archive.

``write_archive`` stores every payload once under its digest, compressed before it is shuffled, keeps the exact header bytes of
every record in a table of their own, and ``read_archive`` joins the two back; ``record_bytes`` rebuilds the original
records, ``parse_records`` reads them. A payload is identified by SHA-256, SHA-1 and length together; the write fails if records
agree in SHA-256 only, and the read recomputes the digest of what it loads.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest record key
is the ``response`` and the others are ``revisit`` records that refer to it; shorter payloads are
always ``response``. Rows that repeat key and payload are separate records: the first in url order
is the response, the others revisit the same key. A null payload counts as empty, a null url as
an empty target, a null key sorts below every other key. An empty table gives empty archives.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quillstream.llm import shared

BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@F.pandas_udf(BinaryType())
def packed(payloads: pd.Series) -> pd.Series:
    """Payloads compressed by zstd; Spark has no such function on columns."""
    import zstandard

    return payloads.map(zstandard.ZstdCompressor(3).compress)


@F.pandas_udf(BinaryType())
def unpacked(payloads: pd.Series) -> pd.Series:
    import zstandard

    return payloads.map(zstandard.ZstdDecompressor().decompress)


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of a hex SHA-1, without padding: each ten hex digits are eight base-32 digits."""
    groups = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), BASE32_DIGITS, BASE32)


def _header(date: str) -> Column:
    """Exact header bytes of a record, as text, without the closing empty line."""
    is_revisit = F.col("record_type") == "revisit"
    lines = F.array_compact(
        F.array(
            F.lit("WARC/1.1"),
            F.concat(F.lit("WARC-Type: "), F.col("record_type")),
            F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.col("copy_no"), F.lit(">")),
            F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")),
            F.lit(f"WARC-Date: {date}"),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
            F.when(is_revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.coalesce(F.col("refers_to").cast("string"), F.lit("null")), F.lit(":1>"))),
            F.lit("Content-Type: text/html; charset=UTF-8"),
            F.concat(F.lit("Content-Length: "), F.when(is_revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        )
    )
    return F.concat(F.array_join(lines, "\r\n"), F.lit("\r\n"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write pages(page_id, url, html) as ``path``/payloads and ``path``/headers.

    Only the payload store shuffles payload bytes, compressed and after a map-side aggregation, so a group of copies
    moves at most one payload per input partition. Headers are cut from narrow rows.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    spark = pages.sparkSession
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).select(
        "*", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes")
    )
    store = keyed.withColumn("packed", packed("payload")).groupBy("sha256").agg(
        F.first("packed").alias("packed"), F.min("sha1").alias("low"), F.max("sha1").alias("high"), F.min("payload_bytes").alias("least"), F.max("payload_bytes").alias("most")
    )
    clash = (F.col("low") != F.col("high")) | (F.col("least") != F.col("most"))
    verified = F.when(clash, F.raise_error(F.concat(F.lit("different payloads under digest "), F.col("sha256")))).otherwise(F.col("sha256"))
    store.select(verified.alias("sha256"), "packed").write.option("compression", "none").parquet(f"{path}/payloads")

    narrow = shared.staged(keyed.select("page_id", "url", "sha256", "payload_bytes", base32(F.col("sha1")).alias("payload_digest")), "warc-keys")
    ranked = narrow.withColumn("copy_no", F.row_number().over(Window.partitionBy("sha256", "page_id").orderBy(F.col("url").asc_nulls_first())))
    # Staged, so that Spark can split its join to the records of a common payload.
    holders = shared.staged(narrow.groupBy("sha256").agg(F.max("page_id").alias("holder")), "warc-holders")
    records = (
        ranked.join(holders, "sha256")
        .withColumn("is_holder", (F.col("payload_bytes") < min_bytes) | (F.col("page_id").eqNullSafe(F.col("holder")) & (F.col("copy_no") == 1)))
        .withColumn("record_type", F.when(F.col("is_holder"), "response").otherwise("revisit"))
        .withColumn("refers_to", F.when(~F.col("is_holder"), F.col("holder")))
    )
    records.select("page_id", "copy_no", "sha256", _header(date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    shared.remove(spark, narrow, holders)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored record: its exact header, the digest of its payload and the payload itself.

    Columns: page_id, header, sha256, payload. Payloads cross the join compressed. Fails on a payload whose bytes no longer have its digest.
    """
    joined = spark.read.parquet(f"{path}/headers").join(spark.read.parquet(f"{path}/payloads"), "sha256")
    found = joined.withColumn("payload", unpacked("packed"))
    intact = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary"))
    return found.select("page_id", "copy_no", "header", "sha256", intact.alias("payload"))


def header_field(name: str) -> Column:
    """A header's value, null where the record has none."""
    value = F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)
    return F.when(value != "", value)


def record_bytes(records: DataFrame) -> DataFrame:
    """read_archive()'s rows with the serialized WARC record; a revisit carries no payload block."""
    block = F.when(header_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    crlf = F.lit(b"\r\n")
    return records.withColumn("record", F.concat(F.encode("header", "UTF-8"), crlf, block, crlf, crlf))


def parse_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of rows with a serialized record and its payload.

    All is read from the record's own bytes; only a revisit's payload, which its record does not hold, comes from the join. A
    payload that has not its header's length or digest raises an error.
    """
    head = F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1)
    cut = records.select(head.alias("header"), "record", "payload")
    size = header_field("Content-Length").cast("long")
    block = F.expr("substring(record, octet_length(header) + 5, octet_length(record) - octet_length(header) - 8)")
    split = cut.select("header", header_field("WARC-Type").alias("record_type"), size.alias("size"), block.alias("block"), "payload")
    whole = split.withColumn("payload", F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(F.col("block")))
    told = F.regexp_extract(header_field("WARC-Payload-Digest"), "^sha1:([A-Z2-7]+)$", 1)
    found = whole.select("*", base32(F.sha1("payload")).alias("found"), told.alias("told"))
    good = (F.col("found") == F.col("told")) & (F.col("size") == F.octet_length("block"))
    refers = F.regexp_extract(header_field("WARC-Refers-To"), "^<urn:page:(-?[0-9]+):1>$", 1)
    return found.select(
        F.regexp_extract(header_field("WARC-Record-ID"), "^<urn:page:(-?[0-9]+):", 1).try_cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(good, F.col("found")).otherwise(F.raise_error(F.concat(F.lit("record and payload differ: "), F.col("told")))).alias("payload_digest"),
        "record_type",
        F.when(refers != "", refers.try_cast("long")).alias("refers_to"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, rebuild every record from the archive and list what the records hold."""
    path = shared.work_dir(spark, "warc")
    write_archive(shared.table(spark, sf_dir, "pages"), path)
    return parse_records(record_bytes(read_archive(spark, path)))


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
digits AS (SELECT page_id, list_transform(range(0, 4), lambda i: ('0x' || digest[1 + 10 * i : 10 + 10 * i])::UBIGINT) AS parts FROM p),
coded AS (
  SELECT page_id, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((parts[1 + k // 8] >> (35 - 5 * (k % 8))) & 31 AS BIGINT) + 1, 1)), '') AS code FROM digits),
ranked AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS holder FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, code AS payload_digest, CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM ranked JOIN coded USING (page_id)
"""
