"""WARC archives of captured pages, and their transactions put together again.

``write_archives`` writes a request, a response and a metadata record per page into
archives of bounded size, with Spark's text writer: a record's lines end as the format
wants them, and its block is the HTTP message with the page in UTF-8. Of pages with equal
payloads (by SHA-1 and length) of at least ``least`` bytes, the one with the smallest id
is a response; the others are revisits, without the payload, that refer to it. Pages
meet their group by page id and digest together, so a payload that many pages share
does not gather in one task.

``read_records`` parses whole archives by their content lengths and checks each payload
against its digest. ``assemble`` joins request and metadata records to the response or
revisit that they are concurrent to: one nested row per capture.

Files are compressed as a whole. Defined results: null html is an empty payload; a null
url gives no target URI; a null page id comes after all others and stays null; a page
that is repeated row for row is captured as often, and only the first is a response;
an empty table gives archives without records and an empty result. Control characters
in a url are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabgauge.functions.expr import col
from tabgauge.llm.common import LAST_ID, id_key, saved, whole_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST = 0
ARCHIVE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
RECORDS_TOGETHER = 256


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits give four letters."""
    digest = F.sha1(text)
    parts = [
        F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    numbers, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return F.translate(F.concat(*parts), numbers, letters)


def record_id(kind: str, page: Column, digest: Column, copy: Column) -> Column:
    """A name that depends on the capture only, so a task that runs again repeats it."""
    h = F.md5(F.concat_ws(":", F.lit(kind), page.cast("string"), digest, copy.cast("string")))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(
        F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">")
    )


def record(kind: Column | str, name: Column, headers: list, block: Column) -> Column:
    """One record without its last line end. Headers with a null value are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    fixed = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", F.lit(DATE))]
    length = ("Content-Length", F.octet_length(block).cast("string"))
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in [*fixed, *headers, length]]
    head = F.concat_ws(END, F.lit("WARC/1.1"), *lines)
    return F.concat(head, F.lit(END * 2), block, F.lit(END))


def roles(pages: DataFrame, page_col: str, html_col: str, least: int) -> DataFrame:
    """(page, digest, n_bytes, keep): the page that equal payloads refer to."""
    html = whole_text(html_col)
    pairs = saved(
        pages.select(
            id_key(page_col).alias("page"),
            base32_sha1(html).alias("digest"),
            F.octet_length(html).cast("bigint").alias("n_bytes"),
        )
        .groupBy("page", "digest", "n_bytes")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    first = pairs.groupBy("digest", "n_bytes").agg(F.min("page").alias("keep"))
    return pairs.join(first, ["digest", "n_bytes"]).withColumn(
        "keep", F.when(F.col("n_bytes") >= least, F.col("keep")).otherwise(F.col("page"))
    )


def write_archives(
    pages: DataFrame,
    path: str,
    page_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: int = LEAST,
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    groups = saved(roles(pages, page_col, html_col, least))
    size = groups.agg(F.sum(F.col("copies") * (F.col("n_bytes") + 1500))).first()[0] or 0
    keys = ["page", "digest", "n_bytes"]
    html = whole_text(html_col)
    rows = pages.select(
        id_key(page_col).alias("page"),
        F.regexp_replace(
            F.regexp_replace(col(url_col).cast("string"), "[\\x00-\\x09\\x0B-\\x1F]", "%0D"),
            "\\n",
            "%0A",
        ).alias("url"),
        html.alias("html"),
        base32_sha1(html).alias("digest"),
        F.octet_length(html).cast("bigint").alias("n_bytes"),
    ).repartition(size // archive_bytes + 1, *keys)
    one = Window.partitionBy(*keys).orderBy("url")
    placed = rows.join(groups, keys).withColumn("copy", F.row_number().over(one))
    c = F.col
    is_first = (c("keep") == c("page")) & ((c("copy") == 1) | (c("n_bytes") < least))
    kind = F.when(is_first, "response").otherwise("revisit")
    name = record_id("answer", c("page"), c("digest"), c("copy"))
    target = ("WARC-Target-URI", c("url"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c("digest")))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        c("n_bytes").cast("string"),
        F.lit(END * 2),
    )
    when_revisit = lambda value: F.when(~is_first, value)
    answer = record(
        kind,
        name,
        [
            target,
            digest,
            ("WARC-Profile", when_revisit(F.lit(PROFILE))),
            (
                "WARC-Refers-To",
                when_revisit(record_id("answer", c("keep"), c("digest"), F.lit(1))),
            ),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.concat(head, F.when(is_first, c("html")).otherwise("")),
    )
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^[A-Za-z]+://([^/]+)", 1)
    place = F.regexp_replace(F.coalesce("url", F.lit("")), "^[A-Za-z]+://[^/]+", "")
    request = record(
        "request",
        record_id("request", c("page"), c("digest"), c("copy")),
        [
            target,
            ("WARC-Concurrent-To", name),
            ("Content-Type", F.lit("application/http;msgtype=request")),
        ],
        F.concat(
            F.lit("GET "),
            F.when(place == "", "/").otherwise(F.replace(place, F.lit(" "), F.lit("%20"))),
            F.lit(f" HTTP/1.1{END}Host: "),
            host,
            F.lit(END * 2),
        ),
    )
    known = lambda page: F.when(page != LAST_ID, page.cast("string"))
    fields = [
        ("page-id", known(c("page"))),
        ("payload-length", c("n_bytes").cast("string")),
        ("refers-to-page-id", when_revisit(known(c("keep")))),
    ]
    metadata = record(
        "metadata",
        record_id("metadata", c("page"), c("digest"), c("copy")),
        [
            target,
            ("WARC-Concurrent-To", name),
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.concat(
            F.concat_ws(END, *[F.concat(F.lit(f"{k}: "), v) for k, v in fields]), F.lit(END)
        ),
    )
    # The writer ends each capture with one more line end.
    lines = placed.select(F.concat_ws(END, request, answer, metadata).alias("value"))
    (
        lines.write.option("lineSep", END)
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .text(path)
    )


HEADER = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of every record of an archive."""
    at, end = 0, len(content)
    while at < end:
        stop = content.find(b"\r\n\r\n", at)
        if not content.startswith(b"WARC/", at) or stop < 0:
            raise ValueError(f"no record at byte {at}")
        head = content[content.index(b"\r\n", at) + 2 : stop + 2]
        headers = {k.decode().lower(): v.decode() for k, v in HEADER.findall(head)}
        start = stop + 4
        at = start + int(headers["content-length"])
        if content[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record does not end at byte {at}")
        yield headers, content[start:at]
        at += 4


def plain(content: bytes) -> bytes:
    """The bytes of an archive, whether compressed as one or record by record."""
    if not content.startswith(b"\x1f\x8b"):
        return content
    out, rest = [], content
    while rest:
        inflate = zlib.decompressobj(31)
        out.append(inflate.decompress(rest))
        rest = inflate.unused_data
    return b"".join(out)


RECORD_SCHEMA = (
    "type string, record_id string, concurrent_to string, refers_to string, uri string, "
    "digest string, http string, payload binary, payload_bytes bigint, fields map<string,string>"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives; payloads are checked against their digests."""

    def one(headers: dict[str, str], block: bytes) -> dict:
        kind, http, payload, fields = headers["warc-type"], None, None, None
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "metadata":
            found = HEADER.findall(block)
            fields = [(k.decode(), v.decode()) for k, v in found]
        else:
            stop = block.index(b"\r\n\r\n") + 4
            http, payload = block[:stop].decode("utf-8", "replace"), block[stop:]
        if kind == "response" and digest:
            own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if own != digest:
                raise ValueError(f"damaged payload in {headers['warc-record-id']}")
        return {
            "type": kind,
            "record_id": headers["warc-record-id"],
            "concurrent_to": headers.get("warc-concurrent-to"),
            "refers_to": headers.get("warc-refers-to"),
            "uri": headers.get("warc-target-uri"),
            "digest": digest,
            "http": http,
            "payload": payload if kind == "response" else None,
            "payload_bytes": len(payload) if kind == "response" else None,
            "fields": fields,
        }

    types = pa.schema(
        [(n, pa.string()) for n in RECORD_SCHEMA.replace(" string", "").split(", ")[:7]]
        + [("payload", pa.binary()), ("payload_bytes", pa.int64())]
        + [("fields", pa.map_(pa.string(), pa.string()))]
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column(0):
                held = []
                for headers, block in parse(plain(content.as_py())):
                    held.append(one(headers, block))
                    if len(held) >= RECORDS_TOGETHER:
                        yield pa.RecordBatch.from_pylist(held, types)
                        held = []
                yield pa.RecordBatch.from_pylist(held, types)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata.

    A capture without a request or metadata has null there; of several, the one with
    the smallest record id counts. ``payload=False`` moves no payloads.
    """
    answers = records.where(F.col("type").isin("response", "revisit"))
    parts = ["type", "record_id", "refers_to", "uri", "digest", "http", "payload_bytes"]
    answer = F.struct(*parts, *(["payload"] if payload else [])).alias("response")
    others = (
        records.where(F.col("type").isin("request", "metadata"))
        .groupBy("concurrent_to")
        .agg(
            F.min_by(
                F.when(F.col("type") == "request", F.struct("record_id", "uri", "http")),
                F.when(F.col("type") == "request", F.col("record_id")),
            ).alias("request"),
            F.min_by(
                F.when(F.col("type") == "metadata", F.struct("record_id", "fields")),
                F.when(F.col("type") == "metadata", F.col("record_id")),
            ).alias("metadata"),
        )
    )
    return (
        answers.select(answer)
        .join(others, F.col("response.record_id") == F.col("concurrent_to"), "left")
        .select("request", "response", "metadata")
    )


def captures(transactions: DataFrame) -> DataFrame:
    """Page id, payload size and digest, record type and referred page of each capture."""
    field = lambda name: F.col("metadata.fields")[name]
    return transactions.select(
        field("page-id").cast("bigint").alias("page_id"),
        F.coalesce("response.payload_bytes", field("payload-length").cast("bigint")).alias(
            "payload_bytes"
        ),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        field("refers-to-page-id").cast("bigint").alias("refers_to"),
    )
