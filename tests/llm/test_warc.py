import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import LONG
from tidemark.llm import warc as W
from tidemark.session import scratch_path


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("type", F.lit("x")).withColumn("digest", F.lit("y"))


def brute(rows):
    first = {}
    for i, url, html in rows:
        b = (html or "").encode()
        if len(b) >= 100:
            first[b] = min(first.get(b, (1 << 60, "")), (-1 if i is None else i, url or ""))
    out = []
    for i, url, html in rows:
        b = (html or "").encode()
        again = len(b) >= 100 and first[b] != (-1 if i is None else i, url or "")
        out.append((str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b][0] if again else None))
    return sorted(out, key=str)


BIG = "x" * 120
ROWS = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", BIG), (3, "http://c/", BIG), (9, "http://d/", BIG), (4, "http://e/", "<p>é</p>"), (5, None, None),
        (6, "http://f/\r\nX: y", ""), (7, "http://g/", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n" * 4), (8, "http://h/", LONG),
        (10, "http://i/", "\r\n\r\n"), (11, "http://j/", "end\r\n\r\n\r\n"), (12, "http://k/", "\x00\u2028\ufeff")]


def test_round_trip(spark):
    got = W.round_trip(frame(spark, ROWS)).collect()
    assert sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(ROWS)


def test_archives_are_valid_and_captures_are_whole(spark):
    root = scratch_path(spark, "warc-test")
    W.write_archives(frame(spark, ROWS), root, file_bytes=4096)
    recs = W.read_records(spark, root)
    assert recs.count() == 3 * len(ROWS)
    captures = {r["metadata"]["fields"]["pageid"]: r for r in W.assemble(recs).collect()}
    assert len(captures) == len(ROWS)
    for i, url, html in ROWS:
        r = captures[str(i)]
        assert r["request"]["http"].startswith("GET ") and r["capture"]["http"].startswith("HTTP/1.1 200")
        if r["capture"]["type"] == "response":
            assert bytes(r["capture"]["payload"]) == (html or "").encode()
        else:
            assert r["refers_to"]["fields"]["pageid"] == "2" and r["capture"]["payload"] is None
    names = [r[0] for r in spark.read.format("binaryFile").load(root).select("path").collect()]
    assert len(names) > 3 and all(n.endswith(".txt.gz") for n in names)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "u", BIG), (1, "u", BIG), (2, "v", BIG), (2, "v", BIG), (None, "w", "short"), (3, "u", None), (3, "u", None)]
    got = W.round_trip(frame(spark, rows)).collect()
    assert sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(rows)
    assert W.round_trip(frame(spark, [])).count() == 0


def test_reader_takes_many_members_and_refuses_cut_files():
    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    assert [b for _, b in W.records(gzip.compress(one) + gzip.compress(one))] == [b"ab\r\nc"] * 2
    assert [b for _, b in W.records(one * 3)] == [b"ab\r\nc"] * 3
    assert list(W.records(b"")) == []
    for cut in (one[:-8], one[:20], gzip.compress(one)[:-12]):
        with pytest.raises(ValueError):
            list(W.records(cut))
