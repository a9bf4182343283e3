"""WARC archives without repeated payloads.

Headers (digest, length, id) are shuffled by payload digest with map-side maxima. The
resulting table has one row per payload that occurs more than once; every page is joined with
it, and pages that repeat an original become revisit records, which carry headers only.
Records are written by Spark's own writers to any store Spark knows; the record separator of
WARC is the writer's line separator. Reading goes by Content-Length, so payloads may
hold anything. No archive exceeds ``HARD_BYTES`` unless one record does.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.tables import table
from basketlens.sources.scratch import reserve, written

END = "\r\n\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
LEAST_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
HARD_BYTES = 1 << 30

RECORDS = (
    "record_id string, record_type string, page_id long, url string, refers_to_record string, "
    "refers_to long, payload_bytes long, payload_digest string"
)


def originals(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One row for each payload of at least ``least_bytes`` on several pages: its largest page_id."""
    headers = pages.select("page_id", *_payload_columns(F.col("html")))
    return (
        headers.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("original_id"), F.count(F.lit(1)).alias("copies"))
        .where((F.col("copies") > 1) & F.col("original_id").isNotNull())
        .drop("copies")
    )


def _payload_columns(html: Column) -> tuple[Column, Column]:
    text = F.coalesce(html, F.lit(""))
    return F.sha1(text).alias("payload_digest"), F.octet_length(text).cast("long").alias("payload_bytes")


def resolve(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``page_id, url, html`` with digest, length, record_type and refers_to.

    Among equal payloads the largest page_id is the response. A page without an id is a
    revisit of it; if no copy has an id, all are responses. Rows that repeat the whole
    original are responses as well. Null html is an empty payload.
    """
    pages = pages.select("page_id", "url", "html")
    found = written(originals(pages, least_bytes), "warc-originals")  # its size is known from now on
    mine = pages.select("page_id", "url", "html", *_payload_columns(F.col("html")))
    joined = mine.join(found, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("original_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original_id"))
    return joined.select(
        "page_id",
        "url",
        "html",
        "payload_digest",
        "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("original_id")).alias("refers_to"),
    )


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """One header line, or nothing for null; a line end in the value is percent-encoded."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def record_text(resolved: DataFrame) -> DataFrame:
    """One column ``value``: header and block of each record, without the two closing line ends."""
    c = F.col
    revisit = c("record_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        c("payload_bytes").cast("string"),
        F.lit(END),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.coalesce(c("html"), F.lit(""))))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", c("record_type")),
        _line("WARC-Record-ID", _record_id(c("page_id"), c("payload_digest"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", c("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(c("refers_to"), c("payload_digest")))),
        _line("X-Page-Id", c("page_id")),
        _line("X-Refers-To-Page-Id", c("refers_to")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    return resolved.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write one record per page to gzipped archives in the new folder ``path``."""
    sizes = pages.agg(
        F.avg(F.octet_length("html")).alias("mean"), F.max(F.octet_length("html")).alias("most")
    ).first()
    mean, most = (sizes["mean"] or 0) + 700, (sizes["most"] or 0) + 5000
    records = max(1, int(min(ARCHIVE_BYTES // mean, HARD_BYTES // most)))
    (
        record_text(resolve(pages, least_bytes))
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records)
        .text(path)
    )


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record of a plain or gzipped archive."""
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) < size or stream.read(4) != END.encode():
            raise ValueError(f"truncated record {head.get('warc-record-id')}")
        yield head, block


def _long(text: str | None) -> int | None:
    return int(text) if text else None


def record_row(head: dict[str, str], block: bytes) -> tuple:
    """A row of ``RECORDS``; the digest of a response is taken from its payload and must fit its header."""
    http, _, payload = block.partition(END.encode())
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
    if head["warc-type"] == "response":
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {head['warc-record-id']} does not fit its digest")
    return (
        head["warc-record-id"],
        head["warc-type"],
        _long(head.get("x-page-id")),
        head.get("warc-target-uri"),
        head.get("warc-refers-to"),
        _long(head.get("x-refers-to-page-id")),
        size,
        digest,
    )


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives in ``path``; ``payload`` adds the bytes (empty for revisits)."""
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * payload
    longs = {"page_id", "refers_to", "payload_bytes"}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(found: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(found, columns=names, dtype=object)
            return out.assign(**{c: out[c].astype("Int64") for c in longs})

        for batch in batches:
            for content in batch["content"]:
                found, held = [], 0
                for head, block in parse_archive(content):
                    row = record_row(head, block)
                    if payload:
                        body = block.partition(END.encode())[2] if row[1] == "response" else b""
                        row, held = (*row, body), held + len(body)
                    found.append(row)
                    if len(found) >= 5000 or held > ARCHIVE_BYTES:
                        yield frame(found)
                        found, held = [], 0
                yield frame(found)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(rows, RECORDS + ", payload binary" * payload)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = reserve(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
