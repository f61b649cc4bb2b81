from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline import errors
from plumbline.functions import cron, hashing, histogram, jsonpath, timestamps
from plumbline.operators import metrics
from plumbline.operators.versions import Clock, Snapshots
from plumbline.streaming.watch import TokenBucket


def test_instants(spark):
    assert timestamps.parse("2021-02-31T00:00:00Z") == timestamps.parse("2021-03-03 00:00:00")
    assert timestamps.parse("1970-01-01T00:00:00.1239Z") == 123
    assert timestamps.render(1500) == "1970-01-01T00:00:01.500Z" and timestamps.render(1000) == "1970-01-01T00:00:01Z"
    for bad in ("2021-13-01T00:00:00Z", "2021-01-32T00:00:00Z", "2021-01-01", "2021-01-01T24:00:00Z", "2021-01-01T00:00:00+02:00"):
        with pytest.raises(errors.InvalidTimestamp):
            timestamps.parse(bad)
    texts = ["2021-02-31T00:00:00Z", "1999-12-31 23:59:59.98765", "2021-01-01T00:00:00+02:00", "nonsense", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(timestamps.parsed(F.col("t")).alias("at")).collect()
    assert [r["at"] for r in rows] == [datetime(2021, 3, 3), datetime(1999, 12, 31, 23, 59, 59, 987000), None, None, None]


@pytest.mark.parametrize("text, at, want", [("*/15 9-17 * * 1-5", datetime(2024, 1, 1, 9, 30), True), ("*/15 9-17 * * 1-5", datetime(2024, 1, 6, 9, 30), False), ("0 0 13 * 5", datetime(2024, 1, 5), True), ("0 0 13 * 5", datetime(2024, 1, 13), True), ("0 0 13 * *", datetime(2024, 1, 5), False), ("5,7 1-3/2 * 2 0", datetime(2024, 2, 4, 3, 7), True), ("0 0 * * 7", datetime(2024, 1, 7), True)])
def test_cron(spark, text, at, want):
    assert cron.matches(text, at) is want
    assert spark.createDataFrame([(at,)], "t timestamp_ntz").select(cron.matched(text, F.col("t"))).head()[0] is want


@pytest.mark.parametrize("text", ["* * * *", "60 * * * *", "*/0 * * * *", "a * * * *", "5-1 * * * *"])
def test_cron_refuses(text):
    with pytest.raises(errors.EngineError):
        cron.parse(text)


def test_paths_never_convert(spark):
    docs = ['{"a":{"b":1}}', '{"a":{"b":"1"}}', '{"a":{"b":true}}', '{"a":{"b":null}}', '{"a":[1]}', '{"a":{"b":-0.0}}', "not json", '{"a.b":5}', None]
    frame = spark.createDataFrame([(d,) for d in docs], "d string")
    got = {k: [r[0] for r in frame.select(jsonpath.typed(F.col("d"), "a.b", k)).collect()] for k in jsonpath.KINDS}
    assert got["number"] == [1.0, None, None, None, None, 0.0, None, None, None]
    assert got["string"] == [None, "1", *[None] * 7] and got["boolean"] == [None, None, True, *[None] * 6]
    for bad in ("", "a..b", "x" * 129):
        with pytest.raises(errors.InvalidIndexField):
            jsonpath.check_path(bad)


def test_digests(spark):
    assert hashing.fnv1a_64(b"") == 0xCBF29CE484222325 and hashing.fnv1a_64(b"a") == 0xAF63DC4C8601EC8C
    assert len(hashing.domain_prefix("d")) == 16
    rows = spark.createDataFrame([(b"hi",), (b"\xff\xfe\xfd",), (b"",), (None,)], "v binary").select(*hashing.as_text(F.col("v"))).collect()
    assert [tuple(r) for r in rows] == [("hi", "utf8"), ("//79", "base64"), ("", "utf8"), (None, None)]


def test_histogram_percentiles(spark):
    at = datetime(2024, 1, 1)
    ops = [("d", at, "read", 50, True)] * 99 + [("d", at, "read", 2_000_000, False)] + [("d", at, "write", 5, None), ("e", at, "rejected", None, None)]
    seconds = metrics.per_second(spark.createDataFrame(ops, "domain string, ts timestamp_ntz, kind string, micros long, hit boolean"))
    rows = {r["domain"]: r for r in metrics.summary(seconds).collect()}
    assert (rows["d"]["p50"], rows["d"]["p99"], rows["d"]["hit_rate"], rows["d"]["writes"]) == (50, 50, 0.99, 1)
    assert (rows["e"]["p50"], rows["e"]["hit_rate"], rows["e"]["rejections"]) == (0, 0.0, 1)
    assert len(histogram.BUCKETS) == 7


def test_clock_and_bucket_and_snapshots():
    clock = Clock(lambda: 5)
    a, b = clock.tick(), clock.tick()
    assert a == 5 << 16 and b == a + 1
    clock.observe(10 << 16)
    assert clock.tick() == (10 << 16) + 1
    now = [0]
    bucket = TokenBucket(10, lambda: now[0])
    assert all(bucket.admit() for _ in range(10)) and not bucket.admit()
    now[0] = 100
    assert bucket.admit() and not bucket.admit()
    held = Snapshots()
    held.open(5), held.open(3), held.open(3)
    held.close(3)
    assert held.watermark() == 3
    held.close(3)
    assert held.watermark() == 5
