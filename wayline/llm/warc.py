"""Content-addressed WARC archive.

Two Parquet tables hold an archive. ``payloads`` has each distinct payload's bytes once, under its
SHA-256, with its length and CRC-32. ``records`` has the exact header block of each WARC/1.1 record,
the digest of its payload and the record that it refers to. ``read_records`` joins the two and gives
the original records back; bytes are checked against digest and length on writing and on reading.

Of records with equal payloads of at least ``least_bytes``, one with the smallest id is a
``response``, all others are ``revisit`` records (profile identical-payload-digest) with an empty
block. Smaller payloads are always responses, though their bytes too are stored once. Rows get
numbers when their index is written, which make record ids unique.

Defined results: a null payload is an empty one; a null url is written as an empty target; a null id
counts as larger than any other, and a reference to a record without an id is null; repeated rows are
separate records, of which one at most is the response of its payload if that is large; a very long
payload is one cell of ``payloads``; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import keep, new_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Orders records without an id after all others.
NO_ID = 2**63 - 1
DATE = "2024-01-01T00:00:00Z"


def _header(kind: Column, record: Column, url: Column, digest: Column, length: Column, refers: Column) -> Column:
    """The header block, ending in an empty line. Line breaks in a url would forge headers: they are percent-encoded."""
    clean = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.concat(F.lit("X-Payload-Length: "), length.cast("string")),
        F.when(refers.isNotNull(), F.concat(F.lit("WARC-Refers-To: "), refers)),
        F.when(refers.isNotNull(), F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(refers.isNull(), length.cast("string")).otherwise(F.lit("0"))),
        F.lit("\r\n"),
    ]
    return F.concat_ws("\r\n", *lines).cast("binary")


def write_archive(pages: DataFrame, path: str, least_bytes: int = 100) -> None:
    """Writes ``pages`` (page_id, url, html) under ``path``/payloads and ``path``/records."""
    spark = pages.sparkSession
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    page = page.withColumn("order_id", F.coalesce("page_id", F.lit(NO_ID))).withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload").cast("long"))
    narrow = keep(page.select("page_id", "order_id", "url", "digest", "length").withColumn("row", F.monotonically_increasing_id()), "warc-index")
    # One row a digest, summed before the shuffle: a payload that a third of all pages share is no burden.
    first = keep(narrow.groupBy("digest").agg(F.min(F.struct("order_id", "row")).alias("f")).select("digest", "f.order_id", F.col("f.row").alias("first_row")), "warc-first")
    # Each payload is taken from its first page; the join moves every page's payload once.
    stored = page.join(first, ["digest", "order_id"]).dropDuplicates(["digest"]).select("digest", "payload", "length", F.crc32("payload").alias("crc32"))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    again = spark.read.parquet(f"{path}/payloads")
    wrong = again.where((F.sha2("payload", 256) != F.col("digest")) | (F.octet_length("payload") != F.col("length")) | (F.crc32("payload") != F.col("crc32")))
    if not wrong.isEmpty():
        raise ValueError("a stored payload does not match its digest")
    again = (F.col("length") >= least_bytes) & (F.col("row") != F.col("first_row"))
    uri = lambda page_id, row: F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), row.cast("string"), F.lit(">"))
    joined = narrow.join(first.withColumnRenamed("order_id", "first_id"), "digest")
    refers = F.when(again, uri(F.nullif("first_id", F.lit(NO_ID)), F.col("first_row")))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    joined.select("page_id", "digest", _header(kind, uri(F.col("page_id"), F.col("row")), F.col("url"), F.col("digest"), F.col("length"), refers).alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.col("header").cast("string"), rf"(?m)^{name}: ([^\r\n]*)$", 1), F.lit(""))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, rebuilt: page_id, record_type, refers_to, url, header, payload and what the header says of the payload.

    The join is by digest; where one payload has very many records, the records' side is split at run time.
    """
    records = spark.read.parquet(f"{path}/records").select(F.col("digest").alias("payload_digest"), "header")
    payloads = spark.read.parquet(f"{path}/payloads").select(F.col("digest").alias("payload_digest"), "payload")
    number = lambda name: F.regexp_extract(_field(name), r"^<urn:page:(-?\d+):\d+>$", 1)
    return records.join(payloads, "payload_digest").select(
        F.nullif(number("WARC-Record-ID"), F.lit("")).cast("long").alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        F.nullif(number("WARC-Refers-To"), F.lit("")).cast("long").alias("refers_to"),
        F.coalesce(_field("WARC-Target-URI"), F.lit("")).alias("url"),
        _field("WARC-Payload-Digest").alias("said_digest"),
        _field("X-Payload-Length").cast("long").alias("said_length"),
        "header",
        "payload",
    )


def record_bytes() -> Column:
    """A record as it would stand in a .warc file: header block, block, two line ends."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return F.concat(F.col("header"), block, F.lit(b"\r\n\r\n"))


def archive_digests(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Writes an archive and describes each record as read back: lengths and digests are those of the rebuilt payloads.

    A rebuilt payload that does not match its record's digest or length ends the query with an error.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archive(pages, path, least_bytes)
    digest, length = F.sha2("payload", 256), F.octet_length("payload").cast("long")
    whole = F.concat(F.lit("sha256:"), digest).eqNullSafe(F.col("said_digest")) & length.eqNullSafe(F.col("said_length"))
    checked = F.when(whole, digest).otherwise(F.raise_error("a rebuilt payload does not match its record"))
    return read_records(spark, path).select("page_id", length.alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")
