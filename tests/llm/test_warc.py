from __future__ import annotations

import gzip
import hashlib
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from panelspark.llm import warc
from panelspark.llm.storage import fresh_path

LONG = "<p>" + "x" * 120
ROWS = [(5, "http://a/1", LONG), (3, "http://a/2", LONG), (9, "http://b/ 3\r\nX: y", LONG), (1, None, "short"), (2, "http://b/4", "short"), (4, "http://c", None), (6, "http://c", "é" * 60), (3, "http://a/2", LONG), (None, "http://n", "n" * 200)]


def _written(spark, rows, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash")).withColumn("refers_to", F.lit(1))
    path = fresh_path(spark, "warc")
    warc.write(warc.with_revisits(df, F.col("html").cast("binary"), "page_id"), path, "page_id", "url", **options)
    return path


def test_round_trip_with_revisits(spark):
    got = warc.resolved(warc.read(spark, _written(spark, ROWS, file_bytes=400))).collect()
    assert len(got) == len(ROWS)
    want = []
    for page, _, html in ROWS:
        body = (html or "").encode()
        first = min((p for p, _, h in ROWS if h == html and p is not None), default=None)
        revisit = len(body) >= 100 and first is not None and first != page
        want.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_predicates_reach_the_reader_and_payloads_can_be_skipped(spark):
    path = _written(spark, ROWS)
    revisits = warc.read(spark, path).where((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http://a"))
    assert revisits.count() == 1
    assert warc.read(spark, path, payload=False).where("payload is not null").count() == 0
    assert warc.read(spark, path).where("record_type in ('response', 'none')").count() == len(ROWS) - 2


def test_reader_skips_unwanted_members(tmp_path):
    rows = [{"record_id": f"urn:id:{k}", "record_type": "response" if k % 2 else "revisit", "target_uri": "u", "date": "d", "payload_digest": "x", "refers_to": None, "http_length": 50_000, "payload": bytes([k]) * 50_000} for k in range(6)]
    (tmp_path / "own.warc.gz").write_bytes(b"".join(warc.member(warc.record(r)) for r in rows))
    (tmp_path / "plain.warc").write_bytes(b"".join(warc.record(r) for r in rows))
    (tmp_path / "foreign.warc.gz").write_bytes(b"".join(gzip.compress(warc.record(r)) for r in rows))
    reader = warc.Reader(f"file://{tmp_path}", (tmp_path / "plain.warc").stat().st_size, True)
    assert len(reader.partitions()) == 2
    rest = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("http_length",), 1)]))
    assert [x.attribute for x in rest] == [("http_length",)]
    got = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert sorted(r["record_id"] for r in got) == sorted(["urn:id:1", "urn:id:3", "urn:id:5"] * 3)
    assert all(r["payload"] == bytes([int(r["record_id"][-1])]) * 50_000 for r in got)
    assert gzip.decompress((tmp_path / "own.warc.gz").read_bytes()) == (tmp_path / "plain.warc").read_bytes()


def _read(reader):
    return [[row for batch in reader.read(part) for row in batch.to_pylist()] for part in reader.partitions()]


def _rows(n, size, seed=1):
    rng = random.Random(seed)
    return [{"record_id": f"urn:id:{k}", "record_type": "response", "target_uri": "u", "date": "d", "payload_digest": "x", "refers_to": None, "http_length": size, "payload": rng.randbytes(size)} for k in range(n)]


def test_one_large_file_in_many_tasks(tmp_path):
    rows = _rows(60, 5000)
    members = [gzip.compress(warc.record(r)) for r in rows]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "foreign.warc.gz").write_bytes(b"".join(members))
    parts = _read(warc.Reader(f"file://{tmp_path}/a", 20_000, True))
    assert len(parts) > 10 and max(map(len, parts)) <= 5
    assert sorted(r["record_id"] for p in parts for r in p) == sorted(r["record_id"] for r in rows)
    assert {r["record_id"]: r["payload"] for p in parts for r in p} == {r["record_id"]: r["payload"] for r in rows}
    batch = pa.RecordBatch.from_pylist([{**r, "content_length": None} for r in rows])
    writer = warc.Writer(f"file://{tmp_path}/b", 1 << 30, 10_000)
    writer.commit([writer.write(iter([batch]))])
    parts = _read(warc.Reader(f"file://{tmp_path}/b", 20_000, True))
    assert len(parts) > 10 and sorted(r["record_id"] for p in parts for r in p) == sorted(r["record_id"] for r in rows)


def test_many_records_in_one_member(tmp_path):
    rows = _rows(7, 3000)
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(warc.record(r) for r in rows)))
    for payload in (True, False):
        for size in (1 << 20, 4000):
            got = [r for p in _read(warc.Reader(f"file://{tmp_path}", size, payload)) for r in p]
            assert [r["record_id"] for r in got] == [r["record_id"] for r in rows]
            assert {r["http_length"] for r in got} == {3000}


def test_long_http_header_without_payload(tmp_path):
    http = b"HTTP/1.1 200 OK\r\nX-Long: " + b"y" * 5000 + b"\r\nContent-Length: 3\r\n\r\nabc"
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    (tmp_path / "plain.warc").write_bytes(one * 2)
    (tmp_path / "own.warc.gz").write_bytes(warc.member(one) + warc.member(one))
    (tmp_path / "foreign.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(one))
    for payload in (True, False):
        got = [r for p in _read(warc.Reader(f"file://{tmp_path}", 1 << 20, payload)) for r in p]
        assert [(r["http_length"], r["payload"]) for r in got] == [(3, b"abc" if payload else None)] * 6


def test_large_records_in_linear_time(tmp_path):
    row = _rows(1, 64 << 20)[0]
    (tmp_path / "one.warc.gz").write_bytes(warc.member(warc.record(row), 1))
    began = time.process_time()
    got = [r for p in _read(warc.Reader(f"file://{tmp_path}", 1 << 30, True)) for r in p]
    assert got[0]["payload"] == row["payload"] and time.process_time() - began < 8


def test_the_shuffled_join_gives_the_same(spark, monkeypatch):
    key = lambda r: tuple(str(x) for x in r)
    first = sorted(map(tuple, warc.resolved(warc.read(spark, _written(spark, ROWS))).collect()), key=key)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, warc.resolved(warc.read(spark, _written(spark, ROWS))).collect()), key=key) == first


def test_empty_table_and_missing_folder(spark):
    assert warc.read(spark, _written(spark, [])).count() == 0
    assert warc.read(spark, fresh_path(spark, "nothing")).count() == 0
