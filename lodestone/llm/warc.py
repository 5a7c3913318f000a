"""Content-addressed WARC archive.

An archive is two Parquet tables: `payloads` holds each distinct payload once under its digest, `records` the exact
header block of every record. reconstruct() joins them to the original record bytes. Payloads are addressed by
SHA-256; reading computes each stored payload's digests and length again and fails on a mismatch with its address, and on
a record whose payload is gone. A record's name is its page's id and a hash of its url and payload, so that rows that share an id
are told apart; byte-identical rows are one record, written as often as it stands.
Of records with equal payloads the one with the largest id is the response, the others are revisits that refer to it.

Defined results: a null page has an empty payload, a null url an empty target; rows that repeat the response's id are
responses too; null ids are smaller than all others (a null id refers to the group's largest id if there is one);
an empty table gives an empty archive; control characters in a url are percent-encoded; other columns are not read.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read_table, until_exit

#: A payload of at least so many bytes may be stored as a revisit of another record's.
MIN_REVISIT_BYTES = 0
CRLF = "\r\n"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of SHA-1: 40 hex digits are 32 base32 digits, 15 and 10 of them fit a 64-bit number."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, at, n), 16, 32), n * 4 // 5, "0") for at, n in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _headers(date: str) -> Column:
    """The header block of a record, as it stands in a WARC file, with its closing empty line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda c, name: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(":"), name, F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    refers = F.concat(line("WARC-Refers-To", urn(F.col("refers_to"), F.col("owner_name"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn(F.col("page_id"), F.col("name"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), F.when(revisit, refers).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")), F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, *, min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str | None = None) -> None:
    """Writes a record per row of pages (page_id, url, html) under path/records, and the payloads once under path/payloads.

    date: when the pages were fetched, as WARC-Date wants it (2024-01-31T12:00:00Z); without it, the time of writing.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).select("page_id", "url", "payload", F.sha2("payload", 256).alias("address"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    name = F.lower(F.hex(F.xxhash64(F.coalesce("url", F.lit("")), "address")))
    light = rows.select("page_id", "url", "address", "payload_bytes", sha1_base32(F.col("payload")).alias("sha1"), name.alias("name"))
    owners = light.groupBy("address").agg(F.max(F.struct("page_id", "name")).alias("top")).select("address", F.col("top.page_id").alias("owner"), F.col("top.name").alias("owner_name"))
    # an address that stands for a third of all pages meets one row here: adaptive execution splits its side
    joined = light.join(owners, "address")
    revisit = (F.col("payload_bytes") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    joined = joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("owner")))
    joined.select("page_id", _headers(date).alias("headers"), "address").write.option("compression", "zstd").parquet(f"{path}/records")
    # copies collapse before the shuffle; equal addresses of unequal bytes would give two rows here, and reading would fail
    rows.groupBy("address", "payload").agg(F.count("*").alias("records")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, headers, payload, and from the headers and the stored payload: payload_bytes, payload_digest, record_type, refers_to.

    Payloads are checked where they lie, so a query that doesn't select them doesn't move them.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("address")
    stored = stored.select("address", "payload", F.when(sound, F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.lit("a payload differs from its digest"))).alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"))
    field = lambda name: F.regexp_extract("headers", f"\\r\\n{name}: ([^\\r\\n]*)", 1)
    records = spark.read.parquet(f"{path}/records").select("page_id", "headers", "address", field("WARC-Type").alias("record_type"), F.expr("try_cast(regexp_extract(headers, '\\r\\nWARC-Refers-To: <urn:page:([^>:]*):', 1) AS bigint)").alias("refers_to"), field("WARC-Payload-Digest").alias("noted"))
    both = records.join(stored, "address", "left")
    wrong = F.when(F.col("payload_digest").isNull(), F.raise_error(F.lit("a record's payload is missing"))).otherwise(F.raise_error(F.lit("a record's digest differs from its payload's")))
    digest = F.when(F.col("noted") == F.concat(F.lit("sha1:"), F.col("payload_digest")), F.col("payload_digest")).otherwise(wrong)
    return both.select("page_id", "headers", "payload", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def _whole(records: DataFrame) -> DataFrame:
    """(page_id, record): headers and block. The digest is looked at for every record, so that a damaged one is an error here too."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select("page_id", F.when(F.col("payload_digest").isNotNull(), F.concat(F.col("headers").cast("binary"), block)).alias("record"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): the whole bytes of each WARC record. A revisit's block is empty, as its headers say."""
    return _whole(read_archive(spark, path)).select("page_id", F.concat("record", F.lit(b"\r\n\r\n")).alias("record"))


def export_warc(spark: SparkSession, path: str, to: str, *, compression: str = "none") -> None:
    """Writes the archive as .warc text files: the text sink ends every record with the two line ends that WARC asks for."""
    records = _whole(read_archive(spark, path)).select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", CRLF * 2).option("compression", compression).text(to)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    until_exit(spark, path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: base32 by fives of bits: DuckDB has no function for it.
OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS owner FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform(range(0, 4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * j)) & 31)::INT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM d
"""
