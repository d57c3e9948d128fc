"""Operator 5, WARC: a content-addressed archive of web pages.

Payload bytes are stored once per SHA-256 in one table, exact record headers in another; joins on the digest rebuild the
original records, and every stored payload is hashed again on reading. Among pages with equal payloads the one with the
largest id is the response, the others are revisits of it.

Defined results: null html is an empty payload; a null url gives an empty target; a null id takes part like any other page
but is never preferred as response; ids are whole numbers; repeated rows give repeated records; no pages give empty tables; other columns of the
input are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.storage import new_path

CRLF = "\r\n"
DATE = "2020-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits at a time become four digits of base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    return pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]", "").alias("url"),
        payload.alias("payload"),
    )


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write ``payloads`` (one row per digest) and ``headers`` (one row per page) under ``path``."""
    rows = _pages(pages, id_col, url_col, html_col).withColumn("payload_sha256", F.sha2("payload", 256))
    # map-side first() and max() send each payload at most once per task, so a hot payload does not pile up
    rows.groupBy("payload_sha256").agg(F.max("page_id").alias("response_id"), F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    known = rows.sparkSession.read.parquet(f"{path}/payloads").select("payload_sha256", "response_id")
    described = rows.select("page_id", "url", "payload_sha256", F.octet_length("payload").cast("bigint").alias("n_bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    joined = described.join(known, "payload_sha256").withColumn("is_response", F.col("response_id").isNull() | F.col("page_id").eqNullSafe(F.col("response_id")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF + CRLF))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    block = F.octet_length(http) + F.when(F.col("is_response"), F.col("n_bytes")).otherwise(0)
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(F.col("is_response"), "response").otherwise("revisit"),
        F.lit(f"{CRLF}WARC-Record-ID: "), urn("page_id"),
        F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), F.col("url"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(F.col("is_response"), F.lit("")).otherwise(F.concat(F.lit(f"{CRLF}WARC-Refers-To: "), urn("response_id"), F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), block.cast("string"), F.lit(CRLF + CRLF), http,
    )
    joined.select(head.alias("header"), "payload_sha256").write.parquet(f"{path}/headers")
    return path


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The payload store; a payload whose bytes no longer have their digest stops the read."""
    intact = F.when(F.sha2("payload", 256) == F.col("payload_sha256"), F.col("payload_sha256")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("payload_sha256"))))
    return spark.read.parquet(f"{path}/payloads").select(intact.alias("payload_sha256"), "payload")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record, payload): the exact bytes of every original record, and the payload it stands for.

    Headers join payloads by content digest; a digest that very many headers share is split by the join, as the payload side has
    one row for it.
    """
    headers = spark.read.parquet(f"{path}/headers")
    block = F.when(F.col("header").contains(f"{CRLF}WARC-Type: response{CRLF}"), F.col("payload")).otherwise(F.lit(b""))
    return headers.join(read_payloads(spark, path), "payload_sha256").select(F.concat(F.encode("header", "UTF-8"), block).alias("record"), "payload")


def parse(rebuilt: DataFrame) -> DataFrame:
    """Fields read out of the bytes of ``rebuilt`` (record, payload): one row per record.

    The size is that of the HTTP header, the digest that of the WARC header; both are held against the payload's bytes, and for a
    response against the bytes inside the record itself.
    """
    text = F.decode("record", "UTF-8")
    warc = F.substring_index(text, CRLF + CRLF, 1)
    heads = F.substring_index(text, CRLF + CRLF, 2)
    body = F.expr("substring(record, octet_length(heads) + 5)")
    named = rebuilt.withColumn("warc", warc).withColumn("heads", heads)
    field = lambda name, of: F.regexp_extract("warc", rf"\r\n{name}: {of}(?:\r\n|$)", 1)
    number = lambda name, none: F.expr(f"try_cast(nullif(regexp_extract(warc, '\\r\\n{name}: <urn:page:([^>]*)>', 1), '{none}') AS bigint)")
    fields = named.select(
        number("WARC-Record-ID", "none").alias("page_id"),
        F.regexp_extract("heads", r"\r\n\r\n[\s\S]*\r\nContent-Length: ([0-9]+)$", 1).cast("bigint").alias("payload_bytes"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("payload_digest"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        number("WARC-Refers-To", "").alias("refers_to"),
        F.octet_length("payload").cast("bigint").alias("stored_bytes"),
        base32_sha1(F.col("payload")).alias("stored_digest"),
        ((field("WARC-Type", "([a-z]+)") != "response") | (body == F.col("payload"))).alias("whole"),
        "payload",
    )
    intact = (F.col("payload_digest") == F.col("stored_digest")) & (F.col("payload_bytes") == F.col("stored_bytes")) & F.col("whole")
    checked = F.when(intact, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record differs from its payload")))
    return fields.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to", "payload")


def index(spark: SparkSession, path: str) -> DataFrame:
    """One row per rebuilt record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return parse(records(spark, path)).drop("payload")


def export_warc(spark: SparkSession, path: str, target: str, gzip: bool = True) -> None:
    """Write plain WARC/1.1 files; the line separator of the text writer is the end of a WARC record."""
    text = F.decode("record", "UTF-8").alias("value")
    records(spark, path).select(text).write.text(target, compression="gzip" if gzip else "none", lineSep=CRLF + CRLF)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "archive"))
    return index(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS response_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       translate(list_aggregate(list_transform(range(8), lambda k: lpad(to_base(CAST('0x' || substr(x, CAST(1 + 5 * k AS INT), 5) AS BIGINT), 32), 4, '0')), 'string_agg', ''),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response_id THEN NULL ELSE response_id END AS refers_to
FROM d
"""
