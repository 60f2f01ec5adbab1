"""WARC archives: writing captures and assembling them again.

``write_archives`` writes a request, a response or revisit, and a metadata
record per page into gzip-compressed WARC/1.1 files.  A record is one text row
whose row separator is the blank line that ends a record, so Spark's own
writer, with its retry-safe commit, makes valid files on any file system.

``read_records`` reads files as binary, one file after the other per task, and
cuts records by their Content-Length.  ``assemble`` joins requests and
metadata to the response or revisit they are concurrent to, and emits one
nested row per capture.

Equal payloads of at least ``least`` bytes are stored once: the row with the
smallest (page_id, url) is the response, others are revisits that refer to it.
Only digests that occur twice enter that table; it is written before the join,
so a payload shared by a third of all pages is a skewed join that AQE splits.

Edge cases: null html is an empty payload; a null url is an empty target; a
null page_id comes before all ids and stands for a page like others; pages
that repeat page_id, url and html share their record ids, every one has its
own row again after assembly; a truncated last record is an error; captures
without request or metadata keep a null struct; an empty table gives an empty
table and no archive.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.session import scratch_path, scratch_scope

LEAST_BYTES = 100
FILE_BYTES = 32 << 20            # uncompressed payload per archive, about
DATE = "2024-01-01T00:00:00Z"    # captures carry no time; all records get one
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def record_id(kind: str, page_id: Column, url: Column, digest: Column) -> Column:
    """A urn:uuid made from what identifies the record."""
    h = F.md5(F.concat_ws("\n", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("null")), F.coalesce(url, F.lit("")), digest).cast("binary"))
    cut = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str, id_: Column, body: Column, *headers: tuple[str, Column]) -> Column:
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: "), id_]
    for name, value in headers:
        lines += [F.lit(f"\r\n{name}: "), value]
    return F.concat(*lines, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body)


def _one_line(c: Column) -> Column:
    """A header value: no line breaks."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")


def write_archives(pages: DataFrame, root: str, least: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """``pages(page_id, url, html, ...)`` -> WARC files under ``root``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"),
                     F.sha2(payload.cast("binary"), 256).alias("digest"))
    who = F.struct(F.col("page_id").alias("id"), F.coalesce("url", F.lit("")).alias("url"))
    first = p.where(F.col("bytes") >= least).groupBy("digest").agg(F.min(who).alias("first"), F.count("*").alias("n"))
    first = written(first.where("n > 1").select(F.col("digest").alias("shared"), "first"), "warc-shared")
    j = p.join(first, p.digest == first.shared, "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(who)

    page, url, digest = F.col("page_id"), F.col("url"), F.col("digest")
    capture = F.when(revisit, record_id("revisit", page, url, digest)).otherwise(record_id("response", page, url, digest))
    target, sha = ("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest))
    http, kind = F.lit("application/http; msgtype="), "Content-Type"
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    ask = F.concat(F.lit("GET "), _one_line(url), F.lit(" HTTP/1.1" + END))
    about = F.concat(F.lit("pageId: "), F.coalesce(page.cast("string"), F.lit("")), F.lit("\r\n"))
    response = _record("response", capture, F.concat(head, F.col("payload")), target, sha, (kind, F.concat(http, F.lit("response"))))
    again = _record("revisit", capture, head, target, sha, (kind, F.concat(http, F.lit("response"))), ("WARC-Profile", F.lit(PROFILE)),
                    ("WARC-Refers-To", record_id("response", F.col("first.id"), F.col("first.url"), digest)))
    request = _record("request", record_id("request", page, url, digest), ask, target, ("WARC-Concurrent-To", capture),
                      (kind, F.concat(http, F.lit("request"))))
    metadata = _record("metadata", record_id("metadata", page, url, digest), about, target, ("WARC-Concurrent-To", capture),
                       (kind, F.lit("application/warc-fields")))
    files = int((p.agg(F.sum("bytes")).first()[0] or 0) // file_bytes) + 1
    # a salt from the record spreads copies over the files
    out = j.select(F.array(request, F.when(revisit, again).otherwise(response), metadata).alias("records"), F.xxhash64(page, url).alias("salt"))
    (out.repartition(files, "salt").select(F.explode("records").alias("value"))
        .write.mode("overwrite").option("lineSep", END).option("compression", "gzip").text(root))


# -- reading ----------------------------------------------------------------

RECORD = ("type string, record_id string, concurrent_to string, refers_to string, target string, "
          "payload_bytes long, payload_digest string, http string, fields map<string,string>, payload binary")
SCHEMA = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()),
                    ("target", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("http", pa.string()),
                    ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def _inflated(data: bytes, piece: int = 1 << 20):
    """The bytes of a plain or gzip file, piece by piece (many members too)."""
    if not data.startswith(b"\x1f\x8b"):
        yield from (data[i:i + piece] for i in range(0, len(data), piece))
        return
    rest = data
    while rest:
        z = zlib.decompressobj(31)
        while not z.eof:
            got = z.decompress(rest, piece)
            rest = z.unused_data if z.eof else z.unconsumed_tail
            if got:
                yield got
            elif not rest and not z.eof:
                raise ValueError("truncated gzip member")


def records(data: bytes):
    """(headers, block) of every record of an archive."""
    parts, held = _inflated(data), bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(parts, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while fill(2) and held.startswith(b"\r\n"):
            del held[:2]
        if not held:
            return
        seen = 0
        while (at := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError("truncated record header")
        head = _headers(bytes(held[:at]))
        n = int(head["content-length"])
        if not fill(at + 4 + n):
            raise ValueError("truncated record block")
        yield head, bytes(held[at + 4:at + 4 + n])
        del held[:at + 4 + n]


def read_records(spark: SparkSession, root: str, with_payload: bool = True) -> DataFrame:
    """One row per record.  ``payload_bytes`` and ``payload_digest`` are of the
    full payload: measured for a response; of a revisit, which holds none,
    those its headers give."""

    def rows(data):
        for head, block in records(data):
            kind, http, payload, n, digest, fields = head.get("warc-type"), None, None, None, None, None
            if head.get("content-type", "").startswith("application/http"):
                top, _, body = block.partition(b"\r\n\r\n")
                http = top.decode("utf-8", "replace")
                if kind == "response":
                    payload, n, digest = body, len(body), hashlib.sha256(body).hexdigest()
                elif kind == "revisit":
                    n = int(_headers(top).get("content-length", 0))
                    digest = head.get("warc-payload-digest", "").rpartition(":")[2]
            elif kind == "metadata":
                fields = list(_headers(block).items())
            yield (kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"),
                   n, digest, http, fields, payload if with_payload else None)

    def run(batches):
        for b in batches:
            for data in b.column("content"):
                held, size = [], 0
                for r in rows(data.as_py()):
                    held.append(r)
                    size += 500 + len(r[-1] or b"")
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), SCHEMA)], schema=SCHEMA)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), SCHEMA)], schema=SCHEMA)

    return spark.read.format("binaryFile").load(root).select("content").mapInArrow(run, RECORD)


def assemble(recs: DataFrame) -> DataFrame:
    """One nested row per response or revisit record: ``capture`` (the record),
    ``request`` and ``metadata`` (concurrent to it; the smallest record id if
    there are several), ``refers_to`` (the metadata of the capture a revisit
    refers to)."""
    def beside(kind, *cols):
        r = recs.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        return r.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min_by(F.struct("record_id", *cols), "record_id").alias(kind))

    capture = recs.where("type in ('response', 'revisit')").select("record_id", F.struct("*").alias("capture"))
    metadata = written(beside("metadata", "fields"), "warc-metadata")
    request = written(beside("request", "http"), "warc-requests")
    whole = capture.join(request, "record_id", "left").join(metadata, "record_id", "left")
    origin = metadata.select(F.col("record_id").alias("origin"), F.col("metadata").alias("refers_to"))
    return whole.join(origin, F.col("capture.refers_to") == F.col("origin"), "left").drop("origin")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, read them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to per page."""
    spark = pages.sparkSession
    with scratch_scope(spark):
        root = scratch_path(spark, "warc")
        write_archives(pages, root)
        recs = written(read_records(spark, root, with_payload=False).drop("payload"), "warc-records", outer=True)
    page = lambda c: F.expr(f"cast(nullif({c}.fields['pageid'], '') as long)")
    return assemble(recs).select(page("metadata").alias("page_id"), F.col("capture.payload_bytes").alias("payload_bytes"),
                                 F.col("capture.payload_digest").alias("payload_digest"), F.col("capture.type").alias("record_type"),
                                 page("refers_to").alias("refers_to"))


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
