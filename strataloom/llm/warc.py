"""WARC archives with revisit resolution.

Headers (page id, URL, payload digest, payload size) are shuffled by payload digest; payloads aren't. Of records with
equal payloads of at least `least_bytes` bytes the one with the largest page id is the response, and the others are
joined to it as revisits; smaller payloads are all responses. Frequent digests are joined by broadcast, at most
`hot_parts` of them by their share of the rows, the rest by a shuffle. Pages whose
digest may repeat, as a bitmap of fixed size tells, meet their verdicts by page id, which no hot payload can skew; the
others are responses without a shuffle. All are written as gzipped WARC/1.1 files in Spark's own writer, one record a row.

A null page id sorts below all others, a null html is an empty payload, a null url an empty one. Rows that repeat a
page id and payload are records of their own; one of them is the response, the rest revisit it.

Reading back streams each file through its split at the version line and trusts Content-Length alone, so that payloads
may contain anything, version lines included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .bitmap import BITS, collect_bitmap
from .common import shared_dir, ship

VERSION = "WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _payload():
    return F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")


def headers_of(pages: DataFrame) -> DataFrame:
    """page_id, payload_digest, payload_bytes, rows (how often the three occur)."""
    shared_dir(pages.sparkSession)
    headers = pages.select(F.col("page_id").cast("long"), F.sha1(_payload()).alias("payload_digest"), F.octet_length(_payload()).cast("long").alias("payload_bytes"))
    return headers.groupBy("page_id", "payload_digest", "payload_bytes").agg(F.count("*").alias("rows")).checkpoint()


def verdicts(headers: DataFrame, *, least_bytes: int = 1000, hot_parts: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(page_id, payload_digest, payload_bytes, original) for each page id and digest, where original is the page id of the
    response, or null if the record is small; and the digests that more than one large record has."""
    large = headers.filter(F.col("payload_bytes") >= least_bytes)
    winners = large.groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n"), F.sum("rows").alias("records")).checkpoint()
    total = headers.count()
    is_hot = F.col("n") * hot_parts > total
    hot = winners.filter(is_hot).select("payload_digest", "original")
    cold = winners.filter(~is_hot).select("payload_digest", "original")
    settled = large.join(F.broadcast(hot), "payload_digest")
    rest = large.join(F.broadcast(hot.select("payload_digest")), "payload_digest", "left_anti").join(cold, "payload_digest")
    small = headers.filter(F.col("payload_bytes") < least_bytes).withColumn("original", F.lit(None).cast("long"))
    return settled.unionByName(rest).unionByName(small).drop("rows"), winners.filter("records > 1").select("payload_digest")


def _position(digest):
    """The first 26 bits of a hex digest."""
    return F.shiftright(F.conv(F.substring(digest, 1, 7), 16, 10).cast("long"), 28 - BITS)


def record_id(page_id, digest):
    """A stable urn:uuid of a record."""
    h = F.md5(F.encode(F.concat_ws("|", F.lit("record"), F.coalesce(page_id.cast("string"), F.lit("")), digest), "UTF-8"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write_archives(pages: DataFrame, path: str, *, least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record for each row of pages, as gzipped text parts in `path`."""
    spark = pages.sparkSession
    ship(spark)
    v, repeated = verdicts(headers_of(pages), least_bytes=least_bytes)
    v = v.select(F.col("page_id").alias("v_id"), F.col("payload_digest").alias("v_digest"), "original")
    # Pages whose digest no bit stands for have no copy: they are responses, and their payloads need no shuffle.
    bitmap = spark.sparkContext.broadcast(collect_bitmap(repeated.select(_position("payload_digest").alias("p")), "p"))

    @F.pandas_udf("boolean")
    def maybe(at: pd.Series) -> pd.Series:
        p = at.to_numpy(np.int64)
        return pd.Series((bitmap.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) != 0)

    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumns({"digest": F.sha1(_payload()), "bytes": F.octet_length("html").cast("long")})
    rows = rows.withColumn("maybe", maybe(_position("digest")))
    alone = rows.filter("NOT maybe").withColumns({"original": F.lit(None).cast("long"), "nth": F.lit(1), "revisit": F.lit(False)})
    rows = rows.filter("maybe").join(v, rows["page_id"].eqNullSafe(v["v_id"]) & (rows["digest"] == v["v_digest"]))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("v_id", "v_digest").orderBy("url")))
    revisit = (F.col("bytes") >= least_bytes) & (~F.col("page_id").eqNullSafe(F.col("original")) | (F.col("nth") > 1))
    rows = rows.withColumn("revisit", revisit).drop("v_id", "v_digest").unionByName(alone)
    crlf = F.lit("\r\n")
    http = F.when(F.col("revisit"), F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")).otherwise(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, crlf)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.concat_ws("#", text("page_id"), F.when(F.col("nth") > 1, F.col("nth").cast("string"))), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Page-ID", text("page_id")),
        line("X-Payload-Bytes", text("bytes")),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("original"), F.col("digest"))), line("X-Refers-To-Page", text("original")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
    )
    out = rows.withColumn("http", http)
    block = F.when(F.col("revisit"), F.col("http")).otherwise(F.concat("http", "html"))
    length = F.octet_length("http") + F.when(F.col("revisit"), F.lit(0).cast("long")).otherwise(F.col("bytes"))
    out.select(F.concat(head, line("Content-Length", length.cast("string")), crlf, block).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


RECORDS = StructType(
    [StructField("page_id", LongType()), StructField("record_type", StringType()), StructField("url", StringType()), StructField("payload_digest", StringType()), StructField("payload_bytes", LongType()), StructField("refers_to", LongType()), StructField("payload", BinaryType())]
)


def parse_block(head: dict[str, str], block: bytes) -> tuple:
    """A row of RECORDS; raises if a response's payload doesn't have the digest that its header states."""
    number = lambda k: int(head[k]) if head.get(k) else None
    digest, kind, payload = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], None
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of record {head.get('warc-record-id')} doesn't match its digest")
    return number("x-page-id"), kind, head.get("warc-target-uri", ""), digest, len(payload) if payload is not None else number("x-payload-bytes"), number("x-refers-to-page"), payload


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """The records of all archives in `path`; payload is null for revisits, or everywhere if payloads is false."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []  # pieces of the record that isn't complete yet
        have = want = 0
        for batch in batches:
            rows: list[tuple] = []
            for piece in batch.column(0):
                data = piece.as_py().encode("utf-8")
                if not held:
                    if not data:
                        continue  # before the first version line of a file
                    want = _length(data)
                    held, have = [data], len(data)
                else:
                    held += (VERSION.encode(), data)
                    have += len(VERSION) + len(data)
                    want = want or _length(b"".join(held))
                if want and have >= want:
                    whole = b"".join(held)
                    end = whole.index(b"\r\n\r\n")
                    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in whole[:end].decode().split("\r\n"))}
                    row = parse_block(head, whole[end + 4 : end + 4 + int(head["content-length"])])
                    rows.append(row if payloads else (*row[:-1], None))
                    held, have, want = [], 0, 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()))], RECORDS.names)
        if held:
            raise ValueError("an archive ends inside a record")

    return spark.read.option("lineSep", VERSION).text(path).mapInArrow(run, RECORDS)


def _length(data: bytes) -> int:
    """Bytes that the record beginning here takes after its version line; 0 if its header isn't complete."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return 0
    at = data.lower().rindex(b"\r\ncontent-length:", 0, end + 2)
    return end + 4 + int(data[at + 17 : data.index(b"\r\n", at + 2)])
