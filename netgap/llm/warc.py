"""WARC archives: writing captures, reading records back, and assembling transactions.

Every capture is written as three records: a request, a response (or a revisit of an equal payload) and a metadata
record.  The request and the metadata name the response in ``WARC-Concurrent-To``.  Records are text of defined bytes,
so Spark's text writer with CRLF as line end writes the archive itself; each archive is one gzip stream whose number of
records follows from the mean size of the payloads (about ``FILE_BYTES`` a file).

Reading streams through each archive, checks payload digests and yields one row per record.  ``transactions`` joins
request and metadata to response through the concurrent-to identifiers and emits one nested row per capture.

Defined results: null html is the empty payload; null urls are written as ``urn:page:<id>``.  Of equal payloads of at least
``revisit_from`` bytes the one with the largest id is the response, the others revisit it.  Records are named after id
and payload: rows that repeat an id (null too) with different payloads are told apart; those that repeat both are
captures of one name, and each gets that name's first request and metadata, so there are as many captures as rows.
Payloads of any length are kept whole; extra columns are not read; an empty table gives no captures.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import storage

CRLF = "\r\n"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, page_id long, payload_bytes long, payload_digest string, payload binary"


#: Bytes of payload of an archive, on average.
FILE_BYTES = 1 << 25


def _record_id(kind: str, number: Column, digest: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + ":"), F.coalesce(number.cast("string"), F.lit("null")), F.lit(":"), digest))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit("WARC/1.1" + CRLF + "WARC-Type: "), kind, F.lit(CRLF))]
    lines += [F.when(v.isNotNull(), F.concat(F.lit(k + ": "), v, F.lit(CRLF))).otherwise(F.lit("")) for k, v in fields]
    lines += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block, F.lit(CRLF)]
    return F.concat(*lines)  # the writer's line end is the record's last CRLF


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to of every page."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.translate(F.col(url_col).cast("string"), "\r\n", ""), F.concat(F.lit("urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("url"), payload.alias("payload"))
    page = page.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    big = page.filter(F.col("payload_bytes") >= revisit_from).groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select(F.col("payload_digest").alias("d"), "last")
    big = storage.written(big, "payloads")
    joined = page.join(big, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") >= revisit_from), "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id") < F.col("last"), F.col("last"))).drop("d", "last")


def write(captured: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", records_per_file: int | None = None) -> None:
    """Writes the archives of ``captures``; ``date`` stands in every record."""
    n, c = F.col("page_id"), F.col
    name = lambda kind, of=n: _record_id(kind, of, c("payload_digest"))
    if records_per_file is None:
        mean = captured.agg(F.avg("payload_bytes")).first()[0] or 0
        records_per_file = 3 * max(1, min(1 << 14, int(FILE_BYTES // (mean + 1))))
    revisit = c("refers_to").isNotNull()
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), c("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    when, target = ("WARC-Date", F.lit(date)), ("WARC-Target-URI", c("url"))
    to = ("WARC-Concurrent-To", name("response"))
    request = _record(F.lit("request"), [("WARC-Record-ID", name("request")), when, target, to, ("Content-Type", F.lit("application/http;msgtype=request"))], F.concat(F.lit("GET "), c("url"), F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    response = _record(
        F.when(revisit, "revisit").otherwise("response"),
        [
            ("WARC-Record-ID", name("response")),
            when,
            target,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c("payload_digest"))),
            ("WARC-Refers-To", F.when(revisit, name("response", c("refers_to")))),
            ("WARC-Profile", F.when(revisit, PROFILE)),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.when(revisit, head).otherwise(F.concat(head, c("payload"))),
    )
    fields = F.concat(F.lit("page-id: "), F.coalesce(n.cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record(F.lit("metadata"), [("WARC-Record-ID", name("metadata")), when, target, to, ("Content-Type", F.lit("application/warc-fields"))], fields)
    rows = captured.select(F.explode(F.array(request, response, metadata)).alias("value"))
    rows.write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class _Stream:
    """Reads a gzip file held in memory piece by piece."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held = memoryview(data), 0, bytearray()
        self.unzip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        piece = self.data[self.at : self.at + (1 << 18)]
        self.at += len(piece)
        if self.unzip is None:
            self.held += piece
            return True
        while len(piece):
            self.held += self.unzip.decompress(piece)
            piece = self.unzip.unused_data
            if piece:
                self.unzip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (k := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self._more():
                return None
        out = bytes(self.held[:k])
        del self.held[: k + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(data: bytes) -> Iterator[tuple]:
    """The records of one archive, as rows of ``RECORD``."""
    s = _Stream(data)
    while (head := s.until(b"\r\n\r\n")) is not None:
        first, *lines = head.decode("utf-8").split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        f = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        block = s.take(int(f["content-length"]))
        if s.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        kind, page, size, digest, payload = f["warc-type"], None, None, f.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
        if kind in ("response", "revisit"):
            http, _, body = block.partition(b"\r\n\r\n")
            size = next(int(x.split(b":")[1]) for x in http.split(CRLF.encode()) if x.lower().startswith(b"content-length:"))
            if kind == "response":
                payload = body
                if len(body) != size or hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"payload of {f['warc-record-id']} is damaged")
        elif kind == "metadata":
            value = block.decode("utf-8").partition("page-id: ")[2].strip()
            page = int(value) if value else None
        yield f["warc-record-id"], kind, f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-date"), page, size, digest, payload


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; ``payloads=False`` leaves the (checked) payloads out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in batches:
            for data in b.column(0):
                held: list[tuple] = []
                size = 0
                for row in parse(data.as_py()):
                    held.append(row if payloads else (*row[:-1], None))
                    size += len(row[-1] or b"") if payloads else 0
                    if len(held) >= 4096 or size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(work, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with its request and metadata; missing parts are null."""
    first = lambda kind, *cols: records.filter(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min(F.struct(*cols)).alias(kind))
    main = records.filter(F.col("type").isin("response", "revisit")).select("record_id", F.struct("type", "target_uri", "date", "refers_to", "payload_bytes", "payload_digest", "payload").alias("response"))
    request, metadata = first("request", F.col("record_id"), "target_uri", "date"), first("metadata", F.col("record_id"), "page_id")
    return main.join(request, "record_id", "left").join(metadata, "record_id", "left")


def resolved(captured: DataFrame) -> DataFrame:
    """``transactions`` with ``refers_to_page``: the page id of the response that a revisit names."""
    named = captured.filter(F.col("response.type") == "response").groupBy(F.col("record_id").alias("rid")).agg(F.min("metadata.page_id").alias("refers_to_page"))
    target = captured.filter(F.col("response.refers_to").isNotNull()).select(F.col("response.refers_to").alias("rid")).distinct()
    known = storage.written(named.join(target, "rid", "left_semi"), "responses")
    return captured.join(known, F.col("response.refers_to") == F.col("rid"), "left").drop("rid")
