"""WARC archives: write captures with revisit records, read them back, assemble transactions.

Each page gives three records: the request, the response (or a revisit of an equal payload's response)
and metadata; request and metadata name the capture in WARC-Concurrent-To. Archives are written by Spark's
text writer, whose line separator is the blank pair of lines that ends a WARC record. Its reader takes them apart at
the same separator, and a task puts the pieces together again to a stream: files may have any size, one record is in memory.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dutymark.llm.common import saved, shared_dir, table

#: Equal payloads of at least so many bytes become revisits of the first; pages of one archive file at most.
REVISIT_BYTES, FILE_ROWS = 100, 20_000
#: Up to so many repeated payloads (about 100 bytes each) are broadcast; more join by a shuffle.
BROADCAST_PAYLOADS = 200_000
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORDS = "type string, record_id string, target_uri string, concurrent_to array<string>, refers_to string, content_type string, http string, fields map<string,string>, payload binary, payload_bytes long, payload_digest string, stated_digest string"


def _record(kind: str, record_id: Column, headers: list[Column], content_type: str, block: Column) -> Column:
    """One record without the two line ends that close it. A null header is left out."""
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}"), F.concat(F.lit("WARC-Record-ID: "), record_id), *headers, F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block))]
    return F.concat(F.concat_ws("\r\n", *head), F.lit("\r\n\r\n"), block)


def _urn(text: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), text, F.lit(">"))


def _repeated(rows: DataFrame) -> DataFrame:
    """(digest, first_page, first_place, ties) of the payloads that repeat: smallest page_id (null first), a row with it, and how many have it."""
    each = rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest", "page_id").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("ties"))
    first = each.groupBy("digest").agg(F.min(F.struct("page_id", "place", "ties")).alias("first"), F.sum("ties").alias("n")).filter("n > 1")
    return saved(first.select("digest", F.col("first.page_id").alias("first_page"), F.col("first.place").alias("first_place"), F.col("first.ties").alias("ties")), "repeated")


def write_warc(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html) to path as gzipped WARC files.

    Null html is an empty payload, a null url gives no target header, line ends in a url are percent-encoded.
    Of equal payloads of REVISIT_BYTES or more the one with the smallest page_id (null first; of repeated
    rows any one) is the response. Only digests are compared; what is found joins the pages, by broadcast if it is small.
    A revisit's metadata record also has the page and the length of the payload that it stands for.
    """
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select("page_id", url.alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html")).withColumn("place", F.monotonically_increasing_id())
    repeated = _repeated(rows)
    if not repeated.filter("ties > 1").isEmpty():  # rows told apart by their place alone: write it down, so that it stays
        rows = saved(rows, "pages")
        repeated = _repeated(rows)
    few = repeated.count() <= BROADCAST_PAYLOADS
    rows = rows.join(F.broadcast(repeated) if few else repeated, "digest", "left")
    is_first = F.col("ties").isNotNull() & F.col("page_id").eqNullSafe(F.col("first_page")) & ((F.col("ties") == 1) | (F.col("place") == F.col("first_place")))
    rows = rows.withColumn("is_first", is_first).withColumn("revisit", F.col("ties").isNotNull() & ~F.col("is_first") & (F.col("size") >= REVISIT_BYTES))
    shared = _urn(F.concat_ws("-", *[F.substring("digest", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
    rows = rows.withColumn("capture", F.when(F.col("is_first"), shared).otherwise(_urn(F.uuid()))).withColumn("original", shared)

    target, with_capture = F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("WARC-Concurrent-To: "), F.col("capture"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    http = F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8{END}")
    request = _record("request", _urn(F.uuid()), [target, with_capture], "application/http; msgtype=request", F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{END}")))
    response = _record("response", F.col("capture"), [target, digest], "application/http; msgtype=response", F.concat(http, F.col("html")))
    profile = F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    revisit = _record("revisit", F.col("capture"), [target, digest, profile, F.concat(F.lit("WARC-Refers-To: "), F.col("original"))], "application/http; msgtype=response", http)
    fields = [F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))]
    fields += [F.when(F.col("revisit"), F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))) for name, c in (("refersToPageId", "first_page"), ("payloadLength", "size"))]
    metadata = _record("metadata", _urn(F.uuid()), [target, with_capture], "application/warc-fields", F.concat(F.concat_ws("\r\n", *fields), F.lit("\r\n")))
    text = F.concat_ws(END, request, F.when(F.col("revisit"), revisit).otherwise(response), metadata)
    rows.select(text.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).text(path)


def parse_warc(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of an open archive, one in memory at a time; Content-Length, not the text, ends a block."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        head: dict[str, list[str]] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(head["content-length"][0])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("the archive ends within a record")
        one = lambda name: head.get(name, [None])[0]
        kind, content = one("warc-type"), one("content-type") or ""
        http, payload, fields = None, block, None
        if content.startswith("application/http"):
            before, _, payload = block.partition(b"\r\n\r\n")
            http = before.decode("utf-8", "replace")
        elif content.startswith("application/warc-fields"):
            pairs = [x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if ":" in x]
            fields = {k.strip(): v.strip() for k, _, v in pairs}
        yield {
            "type": kind, "record_id": one("warc-record-id"), "target_uri": one("warc-target-uri"), "concurrent_to": head.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"),
            "content_type": content, "http": http, "fields": fields, "payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "stated_digest": one("warc-payload-digest"),
        }


class _Pieces(io.RawIOBase):
    """The bytes of pieces, with END between them."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.rest, self.inner = pieces, memoryview(b""), False

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not len(self.rest):
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.rest = memoryview(END.encode() + piece if self.inner else piece)
            self.inner = True
        n = min(len(into), len(self.rest))
        into[:n] = self.rest[:n]
        self.rest = self.rest[n:]
        return n


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """RECORDS of the *.gz archives under path. payload=False leaves the bytes out once their size and digest are known."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 3 + [pa.list_(pa.string())] + [pa.string()] * 3 + [pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def batch(rows: list[dict]) -> pa.RecordBatch:
            columns = [[r[n] for r in rows] for n in names]
            columns[7] = [None if f is None else list(f.items()) for f in columns[7]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        lines = ((f, v) for b in batches for f, v in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        rows, held = [], 0
        for _, file in groupby(lines, key=lambda x: x[0]):
            for r in parse_warc(io.BufferedReader(_Pieces(v.as_py() for _, v in file), 1 << 17)):
                if not payload:
                    r["payload"] = None
                rows.append(r)
                held += len(r["payload"] or b"") + 500
                if held > 8_000_000:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    lines = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path)
    return lines.select("_metadata.file_path", F.col("value").cast("binary").alias("value")).mapInArrow(read, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, type, refers_to, capture struct, requests and metadata arrays.

    A capture is a response, revisit or resource. Requests and metadata join it through WARC-Concurrent-To in
    either direction, metadata also through its request. Records that name no capture found are left out;
    repeated links count once.
    """
    is_capture = F.col("type").isin("response", "revisit", "resource")
    captures, others = records.filter(is_capture), records.filter(F.col("type").isin("request", "metadata"))
    named = others.select("record_id", F.explode("concurrent_to").alias("to"))
    back = captures.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("to"))
    links = named.unionByName(back).distinct()
    direct = links.join(captures.select(F.col("record_id").alias("to")).distinct(), "to", "left_semi")
    via = links.join(direct.select(F.col("record_id").alias("to"), F.col("to").alias("capture")), "to").select("record_id", F.col("capture").alias("to"))
    owner = direct.unionByName(via.join(direct.select("record_id"), "record_id", "left_anti")).distinct()
    part = F.struct("record_id", "type", "target_uri", "content_type", "http", "fields", "payload_bytes", "payload_digest", "payload")
    parts = others.select("record_id", "type", part.alias("part")).join(owner, "record_id")
    held = parts.groupBy(F.col("to").alias("record_id")).agg(
        F.collect_list(F.when(F.col("type") == "request", F.col("part"))).alias("requests"), F.collect_list(F.when(F.col("type") == "metadata", F.col("part"))).alias("metadata")
    )
    return captures.select("record_id", "type", "refers_to", "stated_digest", part.alias("capture")).join(held, "record_id", "left")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    records = saved(read_warc(spark, path, payload=False), "records")
    field = lambda name: F.try_element_at(F.get("metadata", F.lit(0))["fields"], F.lit(name)).try_cast("long")
    revisit = F.col("type") == "revisit"
    # a revisit has no payload of its own: its records state that of the response it refers to
    return assemble(records).select(
        field("pageId").alias("page_id"), F.when(revisit, field("payloadLength")).otherwise(F.col("capture.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.replace("stated_digest", F.lit("sha256:"), F.lit(""))).otherwise(F.col("capture.payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(revisit, field("refersToPageId")).alias("refers_to"),
    )


OP1_SQL = f"""
with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as digest from pages),
f as (select *, min(page_id) over (partition by digest) as head from p)
select page_id, n as payload_bytes, digest as payload_digest, case when n >= {REVISIT_BYTES} and head < page_id then 'revisit' else 'response' end as record_type,
  case when n >= {REVISIT_BYTES} and head < page_id then head end as refers_to from f
"""
