"""Content-addressed WARC archive.

Two tables: `payloads` holds each distinct payload once under its SHA-256, `records` holds the exact bytes of
each record's headers (WARC and HTTP) and the key of its payload. Of the records with equal payloads of at least
`least` bytes the one with the largest page_id is a response and the others are revisits that name it; all smaller
ones are responses. Reading joins the tables again and checks length, SHA-1 and SHA-256 of what it finds.
Null html is the empty payload, a null url leaves out its header line, a null page_id writes an empty id and loses
against any other; rows that repeat page_id and payload are both responses. Line ends in a url are percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_spread, new_path, stored

LEAST_BYTES = 1000
RECORD_ID = "<urn:page:"
LINE = "\r\n"


def write_archive(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    """Write the records of `pages` (page_id, url, html) under `path`."""
    spark = pages.sparkSession
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    payload = pages.select(body.alias("payload")).select(F.sha2("payload", 256).alias("key"), "payload")
    payload.dropDuplicates(["key"]).write.option("compression", "zstd").parquet(f"{path}/payloads")

    rows = stored(
        pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload")).select(
            "page_id", "url", F.sha2("payload", 256).alias("key"), F.sha1("payload").alias("digest"), F.length("payload").cast("long").alias("n_bytes")),
        "warc-rows")
    groups = stored(rows.groupBy("key").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n_rows")), "warc-groups")
    whole = join_spread(rows, groups.select("key", "first_id"), "key", groups.select("key", "n_rows"), "n_rows", "page_id")
    revisit = (F.col("n_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    whole.select(header(revisit).alias("header"), "key").write.option("compression", "zstd").parquet(f"{path}/records")
    spark.catalog.refreshByPath(path)


def header(revisit: Column) -> Column:
    """WARC and HTTP headers of a record, to the byte."""
    urn = lambda c: F.concat(F.lit(RECORD_ID), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(LINE))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes"), F.lit(LINE + LINE))
    block = F.length(F.encode(http, "utf-8")) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    text = F.concat(
        F.lit("WARC/1.1" + LINE),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("first_id"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(LINE), http,
    )
    return F.encode(text, "utf-8")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: header and payload bytes, what the header says, and `verified`.

    Digests are computed where the payload is read, before the join, so a caller that does not select the
    payload moves none.
    """
    payloads = spark.read.schema("key string, payload binary").parquet(f"{path}/payloads").select(
        "key", "payload", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        (F.sha2("payload", 256) == F.col("key")).alias("intact"))
    records = spark.read.schema("header binary, key string").parquet(f"{path}/records")
    said = F.decode("header", "utf-8")
    field = lambda name: F.nullif(F.regexp_extract(said, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    id_of = lambda name: F.nullif(F.regexp_extract(said, rf"\r\n{name}: {RECORD_ID}(-?\d*)>\r\n", 1), F.lit("")).cast("long")
    parsed = records.select(
        "key", "header", id_of("WARC-Record-ID").alias("page_id"), field("WARC-Type").alias("record_type"),
        field("WARC-Target-URI").alias("url"), id_of("WARC-Refers-To").alias("refers_to"), field("WARC-Payload-Digest").alias("said_digest"))
    sizes = stored(records.groupBy("key").agg(F.count("*").alias("n_rows")), "warc-sizes")
    return join_spread(parsed, payloads, "key", sizes, "n_rows", "page_id").select(
        "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "header", "payload",
        (F.col("intact") & (F.col("said_digest") == F.concat(F.lit("sha1:"), F.col("payload_digest")))).alias("verified"))


def record_bytes(archive: DataFrame) -> DataFrame:
    """(page_id, record): each record as it stands in a WARC file; a revisit has no payload of its own."""
    own = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "utf-8"))
    return archive.select("page_id", F.concat("header", own, F.encode(F.lit(LINE + LINE), "utf-8")).alias("record"))


def archive_pages(pages: DataFrame, path: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """Write the archive of `pages` and read it back."""
    path = path or new_path(pages.sparkSession, "warc")
    write_archive(pages, path, least)
    return read_archive(pages.sparkSession, path)
