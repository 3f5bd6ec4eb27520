"""A content-addressed web archive.

``write_archive`` stores two tables: ``payloads`` holds each distinct payload
once under its SHA-256, and ``records`` holds the exact header bytes of every
WARC record with the key of its payload.  ``read_archive`` joins them back:
header bytes + payload (responses) + two line ends are the original record.
Every payload read is hashed again and must have its key.

Records with equal payloads of at least ``least`` bytes: that with the smallest
page_id is the response, the others are revisits that name it.

Nothing is grouped around the payload bytes: rows of one payload meet only as
keys (partial minima), and each distinct payload travels once.

Defined results: null html is the empty payload; null urls give no target
line; line ends in urls are percent-encoded; a null page_id is larger than any
other; equal page_ids with equal payloads are responses all; an empty table
makes an empty archive.  Only the three named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1: 40 hex digits in groups of five make four digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _DIGITS, _BASE32)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit(""))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _page(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("bigint")


def header_bytes(page_id: Column, url: Column, kind: Column, refers_to: Column, size: Column, digest: Column, date: str = DATE) -> Column:
    """The exact bytes of a record before its payload: WARC headers, then HTTP headers."""
    response = kind == "response"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size.cast("string"), F.lit(END + END))
    block = F.length(http) + F.when(response, size).otherwise(0)
    uri = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(f"WARC/1.1{END}"), _line("WARC-Type", kind), _line("WARC-Record-ID", _urn(page_id)),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", uri), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(response, F.lit("")).otherwise(F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _urn(refers_to)))),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", block), F.lit(END), http).cast("binary")


def write_archive(pages: DataFrame, path: str | None = None, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> str:
    """Write ``pages`` as an archive; returns its folder."""
    spark = pages.sparkSession
    path = path or new_path(spark, "archive")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.select("id", "url", "payload", F.unhex(F.sha2("payload", 256)).alias("key"))

    thin = rows.select("id", "url", "key", F.length("payload").cast("bigint").alias("size"), sha1_base32(F.col("payload")).alias("digest"))
    thin.write.parquet(f"{path}/pages")
    thin = spark.read.schema(thin.schema).parquet(f"{path}/pages")
    first = thin.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"), F.max("size").alias("longest"), F.min("size").alias("shortest"))
    first = first.select("key", F.col("first.id").alias("first"), F.assert_true(F.col("longest") == F.col("shortest"), "two payloads with one SHA-256").alias("sound"))

    met = thin.join(first, "key").withColumn("kind", F.when((F.col("size") < least) | F.col("id").eqNullSafe(F.col("first")), "response").otherwise("revisit"))
    met = met.where(F.col("sound").isNull())
    header = header_bytes(F.col("id"), F.col("url"), F.col("kind"), F.col("first"), F.col("size"), F.col("digest"))
    met.select("key", header.alias("header")).write.parquet(f"{path}/records")

    def keyed(df, page):  # null ids as keys of plain columns
        return df.withColumns({"k1": F.coalesce(page, F.lit(0)), "k2": page.isNull()})

    keys = ["key", "k1", "k2"]
    one = keyed(rows.select("key", "id", "payload"), F.col("id")).join(keyed(first, F.col("first")).select(*keys), keys, "left_semi").dropDuplicates(keys)
    one.select("key", "payload").write.parquet(f"{path}/payloads")
    return path


def parse_header(header: Column) -> dict[str, Column]:
    """The fields of a record's header bytes; WARC headers end at the first empty line."""
    text = header.cast("string")
    warc = F.substring_index(text, END + END, 1)

    def field(name):
        return F.nullif(F.regexp_extract(warc, rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))

    return {
        "page_id": _page(field("WARC-Record-ID")), "url": field("WARC-Target-URI"), "record_type": field("WARC-Type"),
        "refers_to": _page(field("WARC-Refers-To")), "header_digest": F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:(.*)$", 1),
        "block_bytes": field("Content-Length").cast("bigint"),
        "http_bytes": (F.length(text) - F.length(warc) - 4).cast("bigint"),
    }


def read_archive(spark, path: str) -> DataFrame:
    """Every record of an archive with its payload: page_id, url, record_type,
    refers_to, header, payload, payload_bytes, payload_digest.

    Each stored payload is verified against its key, and each record against
    its payload's digest and length; a mismatch stops the read.
    """
    store = spark.read.schema("key binary, payload binary").parquet(f"{path}/payloads")
    store = store.select("key", "payload", F.length("payload").cast("bigint").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"), (F.unhex(F.sha2("payload", 256)) == F.col("key")).alias("same"))
    records = spark.read.schema("key binary, header binary").parquet(f"{path}/records")
    records = records.select("key", "header", F.struct(*[c.alias(n) for n, c in parse_header(F.col("header")).items()]).alias("h"))
    full = records.join(store, "key", "left")
    body = F.when(F.col("h.record_type") == "response", F.col("payload_bytes")).otherwise(0)
    sound = F.col("same") & (F.col("h.header_digest") == F.col("payload_digest")) & (F.col("h.block_bytes") == F.col("h.http_bytes") + body)
    full = full.where(F.assert_true(F.coalesce(sound, F.lit(False)), "a record does not match its payload").isNull())
    return full.select("h.page_id", "h.url", "h.record_type", "h.refers_to", "header", "payload", "payload_bytes", "payload_digest")


def records_of(archive: DataFrame) -> Column:
    """The original bytes of a record of ``read_archive``, without the two line ends that follow."""
    return F.when(archive["record_type"] == "response", F.concat(archive["header"], archive["payload"])).otherwise(archive["header"])


def export_warc(archive: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write the records of ``read_archive`` as WARC files (records end with two line ends)."""
    archive.select(records_of(archive).cast("string").alias("value")).write.option("lineSep", END + END).option("compression", compression).text(path)
