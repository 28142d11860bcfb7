"""Content-addressed WARC archive.

An archive is two Parquet tables in a shared folder:

* ``payloads(sha256, sha1, n_bytes, payload)``: every distinct payload once, under its SHA-256;
* ``headers(record_id, sha256, header)``: the exact header bytes of every record, WARC's and HTTP's.

``records`` puts each original record together again by a join on the digest and parses it.  Payload bytes are
hashed again while they are read; a stored payload that no longer has its digest, a block that has not the declared
length or digest, and a record without its payload stop the job.

Rows: a null payload or URL is an empty one.  Of rows with equal payloads of at least ``min_bytes``
the one with the largest id is the response (null is the smallest id; among repeated ids, the first
row stored); the others are revisits of it.  Where that id is null, so is what they refer to.  Shorter
payloads are all responses.  All records carry one date, the archive's.  An empty table
gives an empty archive.  Columns beyond id, url and html are ignored.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, new_path, or_empty, scanned, table

MIN_REVISIT_BYTES, BROADCAST_ROWS = 1000, 2_000_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def _value(c: Column) -> Column:
    """A header value: control characters, which would end the line, as percent codes."""
    for code in (0x25, 0x0D, 0x0A, 0x00):
        c = F.replace(c, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return c


def _urn(page: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), row.cast("string"), F.lit(">"))


def _http(n_bytes: Column) -> Column:
    return F.concat(F.lit(HTTP_HEAD), n_bytes.cast("string"), F.lit("\r\n\r\n"))


def _header(revisit: Column, date: str) -> Column:
    http = _http(F.col("n_bytes"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), F.col("record_id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _value(or_empty("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), F.when(revisit, F.sha2(F.encode(http, "utf-8"), 256)).otherwise(F.col("block_sha256"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), F.col("refers_to_id"))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))).cast("string")),
    ]
    return F.encode(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), http), "utf-8")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES, date: str | None = None) -> str:
    """Writes the archive of ``pages`` under ``path`` and returns ``path``; ``date`` (UTC, ISO 8601) is now by default.

    Digests are taken in one scan and stored; the rows whose payloads are kept come from them, so a payload that a
    third of all rows share is read once more and never shuffled as often.  Headers need digests only.
    """
    pages = scanned(pages)
    spark = pages.sparkSession
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.encode(or_empty(F.col(body_col).cast("string")), "utf-8").alias("payload"),
    )
    n_bytes = F.octet_length("payload").cast("long")
    block = F.sha2(F.concat(F.encode(_http(n_bytes), "utf-8"), F.col("payload")), 256)
    slim = rows.select("row", "page_id", "url", n_bytes.alias("n_bytes"), F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), block.alias("block_sha256"))
    slim.write.option("compression", "zstd").parquet(f"{path}/rows")
    slim = spark.read.parquet(f"{path}/rows")
    lead = F.struct(F.col("page_id"), (-F.col("row")).alias("first"))
    slim.groupBy("sha256", "n_bytes", "sha1").agg(F.max(lead).alias("lead")).write.option("compression", "zstd").parquet(f"{path}/leads")
    leads = spark.read.parquet(f"{path}/leads").select("sha256", "n_bytes", "sha1", F.col("lead.page_id").alias("lead_page"), (-F.col("lead.first")).alias("lead_row"))

    kept = leads.select(F.col("lead_row").alias("row"))
    kept = rows.select("row", "payload").join(broadcast_if_small(kept, kept.count(), BROADCAST_ROWS), "row", "left_semi")
    kept.select(F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), n_bytes.alias("n_bytes"), "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")

    revisit = (F.col("n_bytes") >= min_bytes) & (F.col("lead_row") != F.col("row"))
    heads = slim.join(leads.select("sha256", "lead_page", "lead_row"), "sha256").withColumns({"record_id": _urn(F.col("page_id"), F.col("row")), "refers_to_id": _urn(F.col("lead_page"), F.col("lead_row"))})
    heads.select("record_id", "sha256", _header(revisit, date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The payload store, each payload checked against its digests and length."""
    raw = spark.read.parquet(f"{path}/payloads")
    sound = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("n_bytes")) & (F.sha1("payload") == F.col("sha1"))
    return raw.select(
        "sha256", F.when(sound, F.sha1("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256")))).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), "payload",
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record: ``record``, its exact bytes, its parsed header fields, its payload and the payload's digest.

    A revisit's record holds no payload bytes of its own; ``payload`` has those it refers to.  A response's payload is
    cut from its record again, and block length and digest are those of the record's bytes.
    """
    heads = spark.read.parquet(f"{path}/headers")
    text = F.decode("header", "utf-8")

    def field(name: str) -> Column:
        return F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)

    def page(urn: Column) -> Column:
        return F.regexp_extract(urn, r"^<urn:x-page:(-?[0-9]+):", 1).try_cast("long")

    parsed = heads.select(
        "sha256", "header", field("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("record_type"), field("WARC-Target-URI").alias("target_uri"), field("WARC-Date").alias("date"),
        field("WARC-Payload-Digest").alias("declared_digest"), field("WARC-Block-Digest").alias("block_digest"), field("Content-Length").cast("long").alias("block_bytes"),
        page(field("WARC-Record-ID")).alias("page_id"), page(field("WARC-Refers-To")).alias("refers_to"),
        # Where the block begins: behind the WARC header's empty line.
        F.octet_length(F.concat(F.substring_index(text, "\r\n\r\n", 1), F.lit("\r\n\r\n"))).alias("at"),
    )
    whole = parsed.join(read_payloads(spark, path), "sha256", "left")
    response = F.col("record_type") == "response"
    end = F.lit(b"\r\n\r\n")
    whole = whole.withColumn("record", F.concat("header", F.when(response, F.col("payload")).otherwise(F.lit(b"")), end))
    block = F.substr("record", F.col("at") + 1, F.octet_length("record") - F.col("at") - 4)
    own = F.when(response, F.sha1(F.substr("record", F.octet_length("header") + 1, F.octet_length("record") - F.octet_length("header") - 4))).otherwise(F.col("payload_digest"))
    sound = (F.concat(F.lit("sha1:"), own) == F.col("declared_digest")) & (F.octet_length(block) == F.col("block_bytes")) & (F.concat(F.lit("sha256:"), F.sha2(block, 256)) == F.col("block_digest"))
    checked = F.when(sound, own).otherwise(F.raise_error(F.concat(F.lit("no payload for "), F.col("record_id"))))
    return whole.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to", "record_id", "date", "target_uri", "payload", "record")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archive(table(spark, sf_dir, "pages"), new_path(spark, "archive"))
    return records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, row_number() OVER (PARTITION BY payload_digest, payload_bytes ORDER BY page_id DESC NULLS LAST) AS rn,
         max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS lead_page FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND rn > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND rn > 1 THEN lead_page END AS refers_to
FROM q
"""
