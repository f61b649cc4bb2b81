"""Key-value and document domains, archives, logs and streams."""

import json
import time

import pytest
from pyspark.sql import functions as F

from plumbline import errors
from plumbline.operators import versions as V
from plumbline.operators.documents import Documents
from plumbline.operators.kv import Domains, KeyValues, Value
from plumbline.sources import archive, logs, ndjson
from plumbline.streaming import watch


def test_reads_have_three_states(spark, tmp_path):
    kv = KeyValues(spark, str(tmp_path / "kv"))
    assert kv.get("a") == Value("absent")
    kv.put("a", b"1")
    snap = kv.snapshot()
    kv.put("a", b"2")
    kv.set_null("b")
    kv.put("gone", b"x", ttl=0)
    kv.put("later", b"", ttl=100)
    assert kv.get("a") == Value("present", b"2") and kv.get("a", snap) == Value("present", b"1")
    assert kv.get("b") == Value("null") and kv.get("gone") == Value("absent") and kv.get("later") == Value("present", b"")
    kv.delete("a")
    assert kv.get("a") == Value("absent") and [r["key"] for r in kv.prefix("").collect()] == ["b", "later"]
    kv.compact()
    assert kv.get("a", snap) == Value("present", b"1") and kv.get("a") == Value("absent")
    assert kv.batch([("x", V.PUT, b"1", 0), ("y", V.PUT, b"2", 0)]) and kv.log().where("key in ('x', 'y')").select("ts").distinct().count() == 1
    for bad, kind in ((("", b""), errors.KeyTooLong), (("k" * 257, b""), errors.KeyTooLong), (("k", b"x" * 600_000), errors.ValueTooLarge)):
        with pytest.raises(kind):
            kv.put(*bad)


@pytest.mark.parametrize(
    "rows, watermark, kept",
    [
        ([(1, "put", 0), (5, "put", 0), (9, "put", 0)], 6, [5, 9]),
        ([(1, "put", 0), (5, "del", 0)], 6, []),
        ([(1, "put", 0), (5, "del", 0)], 5, [5]),
        ([(1, "put", 0), (5, "del", 0)], None, [5]),
        ([(1, "put", 0), (5, "put", 50)], None, []),
        ([(7, "put", 50), (9, "put", 0)], 6, [7, 9]),
        ([(1, "put", 0), (7, "put", 50)], 6, [1, 7]),
        ([(1, "put", 50), (9, "put", 0)], 6, [9]),
        ([(1, "put", 0), (5, "put", 50)], 6, []),
        ([(1, "null", 0)], 6, [1]),
        ([(1, "put", 500)], 6, [1]),
    ],
)
def test_compaction(spark, rows, watermark, kept):
    log = spark.createDataFrame([("k", b"v", ts, op, e) for ts, op, e in rows], V.SCHEMA)
    assert sorted(r["ts"] for r in V.compact(log, watermark, 100).collect()) == kept


def test_documents(spark, tmp_path):
    docs = Documents(spark, str(tmp_path / "docs"))
    docs.create({"city": "Essen", "age": 30, "tags": [1]}, "a")
    docs.create_index("city", "string")
    docs.create_index("age", "number")
    b = docs.create({"city": "Berlin", "age": -5}, "b")
    docs.create({"city": "Essen", "age": "30"}, "c")
    assert docs.search({"city": "Essen"}).total == 1  # made before the index
    assert docs.reindex()["status"] == "completed" and docs.reindex()["documents"] == 3
    assert [d.key for d in docs.search({"city": "Essen"}).documents] == ["a", "c"]
    assert [d.key for d in docs.search({"city": "Essen", "age": {"$gte": 0}}).documents] == ["a"]
    assert [d.key for d in Documents(spark, docs.path).search({"age": {"$lt": 0}}).documents] == ["b"]
    for bad, kind in (({}, errors.EmptyFilter), ({"zip": 1}, errors.UnknownIndex), ({"city": 1}, errors.TypeMismatch), ({"age": True}, errors.TypeMismatch)):
        with pytest.raises(kind):
            docs.search(bad)
    again = docs.upsert("b", [1, 2], expected=b.etag)
    assert again.version == 2 and again.generation == b.generation and docs.get("b").content == [1, 2]
    with pytest.raises(errors.VersionConflict):
        docs.upsert("b", 1, expected=b.etag)
    with pytest.raises(errors.AlreadyExists):
        docs.create({}, "b")
    assert docs.delete("b") and not docs.delete("b") and docs.get("b") is None
    assert docs.create({}, "b").generation != b.generation
    page = docs.list(limit=2, offset=1)
    assert [d.key for d in page.documents] == ["b", "c"] and page.total == 3


def test_ndjson(spark, tmp_path):
    text = '{"_key":"k1","_version":9,"a":{"b":[1,"x"]},"c":null}\n\nnot json\n[1,2]\n{"_content":"plain"}\n{"_key":"k1","a":2}\n'
    (tmp_path / "in.ndjson").write_text(text)
    good, bad = ndjson.parsed(ndjson.numbered(spark, str(tmp_path / "in.ndjson")))
    assert [r["error"] for r in bad.orderBy("line").collect()] == ["line 3", "line 4"]
    rows = good.orderBy("line").collect()
    assert [r["line"] for r in rows] == [1, 5, 6] and json.loads(rows[0]["content"]) == {"a": {"b": [1, "x"]}, "c": None}
    assert rows[1]["content"] == '"plain"' and len(rows[1]["key"]) == 36
    docs = Documents(spark, str(tmp_path / "docs"))
    assert docs.load(good.where("key = 'k1'")) == 2
    assert docs.get("k1").content == {"a": 2} and docs.get("k1").version == 2
    docs.create({}, "e")
    docs.create("s", "t")
    ndjson.write(docs.live(), str(tmp_path / "out"))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines, key=lambda x: x["_key"]) == [{"_key": "e", "_version": 1}, {"_key": "k1", "_version": 2, "a": 2}, {"_key": "t", "_version": 1, "_content": "s"}]


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    (tmp_path / "long.txt").write_text("".join(f"text {i}\n" for i in range(1, 3001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = ndjson.numbered(spark, str(tmp_path / "long.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r["start"] for r in rows}) > 3 and sorted((r["line"], r["text"]) for r in rows) == [(i, f"text {i}") for i in range(1, 3001)]


def test_archives(spark, tmp_path):
    kvs, docs = Domains(spark, str(tmp_path / "kv")), Domains(spark, str(tmp_path / "docs"), Documents)
    kv, doc = kvs.create("shop"), docs.create("shop")
    kv.put("a", b"\xff\x00")
    kv.set_null("n")
    kv.put("late", b"x", ttl=1)
    doc.create({"q": "ü"}, "d")
    doc.create_index("q", "string")
    path = str(tmp_path / "backup")
    archive.export(spark, path, {"shop": kv}, {"shop": doc})
    with pytest.raises(errors.AlreadyExists):
        archive.restore(spark, path, kvs, docs)
    time.sleep(2.2)
    report = archive.restore(spark, path, kvs, docs, only="shop", rename="copy")
    assert report == {"kv": 2, "doc": 1, "expired": 1}
    assert kvs.get("copy").get("a") == Value("present", b"\xff\x00") and kvs.get("copy").get("n") == Value("null")
    assert docs.get("copy").search({"q": "ü"}).total == 1
    part = next((tmp_path / "backup" / "lines").glob("part-*"))
    part.write_text(part.read_text().replace("shop", "shap"))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(errors.ArchiveCorrupt):
        archive.read(spark, path)


def test_domains(spark, tmp_path):
    domains = Domains(spark, str(tmp_path))
    domains.create("a").put("k", b"v")
    with pytest.raises(errors.InvalidDomain):
        domains.create("no space")
    with pytest.raises(errors.AlreadyExists):
        domains.create("a")
    domains.delete("a")
    with pytest.raises(errors.DomainDeleting):
        domains.get("a")
    assert Domains(spark, str(tmp_path)).purge() == ["a"] and Domains(spark, str(tmp_path)).names() == []


def test_logs(spark, tmp_path):
    (tmp_path / "x.log").write_text("".join(f"line {i} {'odd' if i % 2 else 'even'}\n" for i in range(100)))
    path = str(tmp_path / "x.log")
    assert logs.tail(spark, path, 3).lines == ["line 97 odd", "line 98 even", "line 99 odd"]
    assert logs.tail(spark, path, 2, "even") == logs.Tail(["line 96 even", "line 98 even"], False)
    found = logs.tail(spark, path, 50, "even", budget=120)
    assert found.truncated and len(found.lines) < 50
    assert [r["path"].rsplit("/")[-1] for r in logs.files(spark, str(tmp_path)).collect()] == ["x.log"]


def test_streams(spark, tmp_path):
    kv = KeyValues(spark, str(tmp_path / "kv"))
    kv.put("user:1", b"a")
    kv.set_null("user:2")
    kv.put("other", b"b")
    kv.delete("user:1")
    got = []
    query = watch.watch(spark, kv.folder, "user:", lambda df, _: got.extend(df.collect()), str(tmp_path / "check"), once=True)
    query.awaitTermination(60)
    assert [(r["key"], r["event"]) for r in sorted(got, key=lambda r: r["ts"])] == [("user:1", "set"), ("user:2", "set"), ("user:1", "delete")]
    rows = [("d", f"2024-01-01 00:00:{s:02d}", "read", 5, True) for s in range(0, 40, 10)]
    ops = spark.createDataFrame(rows, "domain string, t string, kind string, micros long, hit boolean").select("domain", F.col("t").cast("timestamp").alias("ts"), "kind", "micros", "hit")
    ops.write.parquet(str(tmp_path / "ops"))
    stream = watch.ticker(spark.readStream.schema(ops.schema).parquet(str(tmp_path / "ops")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("ticks").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.sql("SELECT max(reads) FROM ticks").head()[0] == 4
