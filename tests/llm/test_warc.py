import gzip
import hashlib
import io
import random
import uuid

import pytest

from dutymark.llm.common import shared_dir
from dutymark.llm.warc import assemble, op1_warc, parse_warc, read_warc, write_warc

PAGES = "page_id long, url string, html string, type string"
SAME = "<p>" + "same words " * 30 + "</p>"


def archive(spark, rows):
    path = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    write_warc(spark.createDataFrame(rows, PAGES), path)
    return path


def test_round_trip_and_revisits(spark):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\n\r\nbody\r\n\r\nWARC/1.1\r\n" + "é" * 60
    rows = [(5, "http://a/5", SAME, "x"), (2, "http://a/2", SAME, "x"), (9, "http://a/9\r\nX: y", SAME, "x"), (1, "http://b", "tiny", "x"), (3, "http://b", "tiny", "x"), (4, None, None, "x"), (6, "http://t", tricky, "x"), (7, "http://t", "", "x")]
    captures = {int(r["metadata"][0]["fields"]["pageId"]): r for r in assemble(read_warc(spark, archive(spark, rows))).collect()}
    assert sorted(captures) == [1, 2, 3, 4, 5, 6, 7, 9]
    assert all(len(r["requests"]) == 1 and len(r["metadata"]) == 1 for r in captures.values())
    assert {k for k, r in captures.items() if r["type"] == "revisit"} == {5, 9}
    assert captures[5]["refers_to"] == captures[9]["refers_to"] == captures[2]["record_id"]
    assert bytes(captures[6]["capture"]["payload"]) == tricky.encode() and bytes(captures[2]["capture"]["payload"]) == SAME.encode()
    assert captures[6]["capture"]["payload_digest"] == hashlib.sha256(tricky.encode()).hexdigest()
    assert bytes(captures[4]["capture"]["payload"]) == b"" and captures[4]["capture"]["target_uri"] is None
    assert captures[9]["capture"]["target_uri"] == "http://a/9%0D%0AX: y"


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "u", SAME, "x"), (1, "u", SAME, "x"), (None, "u", "other" * 40, "x"), (2, "u", "other" * 40, "x")]
    found = assemble(read_warc(spark, archive(spark, rows))).collect()
    assert sorted(r["type"] for r in found) == ["response", "response", "revisit", "revisit"]
    assert len({r["record_id"] for r in found}) == 4


def test_pages_of_any_bytes_and_sizes(spark):
    rng = random.Random(3)
    rows = [(i, f"http://big/{i}", "".join(rng.choice("\r\n\r\na\0é") for _ in range(rng.randrange(3000))), "x") for i in range(60)]
    rows += [(100 + i, "http://big", "\r\n" * i + "x" * 3_000_000 + "\r\n" * i, "x") for i in range(6)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = assemble(read_warc(spark, archive(spark, rows))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {int(r["metadata"][0]["fields"]["pageId"]): bytes(r["capture"]["payload"]) for r in found} == {i: html.encode() for i, _, html, _ in rows}


def test_query_on_repeated_and_null_rows_and_none(spark, tmp_path):
    rows = [(1, "u", SAME, "x"), (3, "u", SAME, "x"), (2, "u", None, "x"), (7, None, "other" * 40, "x"), (4, "u", "other" * 40, "x"), (4, "u", "other" * 40, "x")]
    for name, own in (("some", rows), ("none", [])):
        spark.createDataFrame(own, PAGES).write.parquet(f"{tmp_path}/{name}/pages.parquet")
    got = sorted(tuple(r) for r in op1_warc(spark, f"{tmp_path}/some").collect())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(1, SAME, "response", None), (2, None, "response", None), (3, SAME, "revisit", 1), (4, "other" * 40, "response", None), (4, "other" * 40, "revisit", 4), (7, "other" * 40, "revisit", 4)]
    assert got == [(i, len(t or ""), sha(t), kind, to) for i, t, kind, to in want]
    assert op1_warc(spark, f"{tmp_path}/none").count() == 0


def test_empty_table(spark):
    assert assemble(read_warc(spark, archive(spark, []))).count() == 0


def test_links_in_both_directions_and_through_the_request(spark):
    rows = [("response", "c1", ["q1"]), ("request", "q1", []), ("metadata", "m1", ["q1"]), ("metadata", "m2", ["c1"]), ("metadata", "m3", ["nowhere"]), ("revisit", "c2", []), ("warcinfo", "i", [])]
    schema = "type string, record_id string, concurrent_to array<string>, target_uri string, refers_to string, content_type string, http string, fields map<string,string>, payload binary, payload_bytes long, payload_digest string, stated_digest string"
    records = spark.createDataFrame([(*r, None, None, None, None, None, None, None, None, None) for r in rows], schema)
    got = {r["record_id"]: r for r in assemble(records).collect()}
    assert sorted(got) == ["c1", "c2"]
    assert [x["record_id"] for x in got["c1"]["requests"]] == ["q1"] and sorted(x["record_id"] for x in got["c1"]["metadata"]) == ["m1", "m2"]
    assert got["c2"]["requests"] is None


def test_broken_archives_are_told():
    with pytest.raises(ValueError):
        list(parse_warc(io.BytesIO(b"hello\r\n")))
    with pytest.raises(ValueError):
        list(parse_warc(io.BytesIO(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 9\r\n\r\nabc")))
    data = gzip.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    assert next(parse_warc(gzip.open(io.BytesIO(data))))["payload"] == b"abc"
