"""Readers, index tables and the ingest stream, including a restart and a replay."""

import base64

import pytest

from pyspark.sql import functions as F

from evidentia.sources import documents as D
from evidentia.sources import index as IX
from evidentia.streaming import ingest, trace


def test_read_whole_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text("# One\n\nTwo", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes(b"caf\xff")
    rows = {r.doc_name: r.text for r in D.read_documents(spark, str(tmp_path)).collect()}
    assert rows == {"a.md": "# One\n\nTwo", "b.txt": "caf�"}


def test_csv_quoting(spark, tmp_path):
    (tmp_path / "t.csv").write_text('name,note\nReed,"a, ""b"""\nMoss,\n,\n', encoding="utf-8")
    rows = D.read_csv(spark, str(tmp_path / "t.csv"))
    got = {r.text for r in D.csv_texts(rows, ["name", "note"], []).collect()}
    assert got == {'name: Reed · note: a, "b"', "name: Moss"}


def test_text_pages(spark):
    text = "\n\n".join(c * 40 for c in "abcdef")
    docs = spark.createDataFrame([(1, text), (2, "short")], "i int, text string")
    pages = [(r.i, r.page, r.text) for r in D.text_pages(docs, ["i"], limit=100).orderBy("i", "page").collect()]
    assert [p[:2] for p in pages] == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert "\n\n".join(p[2] for p in pages[:3]) == text


def test_index_replace_and_replay(spark, tmp_path):
    path = str(tmp_path / "index")
    IX.create_index(spark, path)
    first = spark.createDataFrame([("a#0", "a", "one"), ("a#1", "a", "two"), ("b#0", "b", "three")], "chunk_id string, doc_id string, content string")
    IX.publish(path, first, 0)
    older = {f: f.stat().st_mtime_ns for f in (tmp_path / "index").rglob("*.parquet")}
    newer = spark.createDataFrame([("a#0", "a", "ONE")], "chunk_id string, doc_id string, content string")

    def stored(at=path):
        return {(r.chunk_id, r.content) for r in IX.read_index(spark, at).collect()}

    for _ in range(2):
        IX.publish(path, newer, 1)
        assert stored() == {("a#0", "ONE"), ("b#0", "three")}
    # A batch of one document writes no file of another version anew.
    assert older and all(f.stat().st_mtime_ns == t for f, t in older.items())
    IX.compact(spark, path, str(tmp_path / "compact"), 1)
    assert stored(str(tmp_path / "compact")) == stored()
    IX.retract(path, spark.createDataFrame([("b",)], "doc_id string"), 2)
    assert stored() == {("a#0", "ONE")}
    IX.publish(path, first.where("doc_id = 'b'"), 3, spark.createDataFrame([("a",), ("b",)], "doc_id string"))
    assert stored() == {("b#0", "three")}


def test_index_rejects_blank_keys(spark, tmp_path):
    path = str(tmp_path / "index")
    IX.create_index(spark, path)
    rows = spark.createDataFrame([(" ", "a", "one")], "chunk_id string, doc_id string, content string")
    with pytest.raises(Exception, match="without a chunk_id"):
        IX.publish(path, rows, 0)
    assert IX.read_index(spark, path).count() == 0


def test_ingest_stream_restarts(spark, tmp_path):
    source, index, status, checkpoint = (str(tmp_path / n) for n in ("in", "index", "status", "checkpoint"))
    IX.create_index(spark, index)

    def add(rows, n):
        spark.createDataFrame([(i, base64.b64encode(t.encode()).decode() if t is not None else "%%") for i, t in rows], "doc_id long, payload string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, payload string").parquet(source)
        ingest.run_available(stream, checkpoint, index, status)
        return {r.doc_id: (r.status, r.chunks) for r in ingest.latest_status(spark, status).collect()}

    assert add([(1, "first text of some length"), (2, None), (3, "  ")], 0) == {"1": ("indexed", 1), "2": ("failed", 0), "3": ("failed", 0)}
    assert add([(4, "line\n" * 900)], 1)["4"] == ("indexed", 2)
    rows = IX.read_index(spark, index).select("doc_id", F.size("vector").alias("n")).collect()
    assert sorted(r.doc_id for r in rows) == ["1", "4", "4"] and {r.n for r in rows} == {384}


def test_stream_sessions_equal_batch(spark, tmp_path):
    rows = [(r, i, f"2026-01-01 {10 + i // 2:02d}:{(i % 2) * 20:02d}:00", "error" if i == 5 else "retrieval.started") for r in range(3) for i in range(12)]
    frames = spark.createDataFrame(rows, "run_id int, sequence_number int, created_at string, step_type string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    frames.write.parquet(str(tmp_path / "in"))
    stream = trace.sessions(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in")), "15 minutes", "1 minute")
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    closed = {tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()}
    whole = {tuple(r) for r in trace.sessions(frames, "15 minutes").collect()}
    assert closed and closed <= whole
    # Only the sessions that the watermark has not yet passed are still open.
    assert len(whole - closed) <= 2 * 3


def test_reading_the_index_does_not_shuffle_its_vectors(spark, tmp_path):
    path = str(tmp_path / "index")
    IX.create_index(spark, path)
    rows = spark.createDataFrame([("a#0", "a", "one"), ("a#1", "a", "two"), ("b#0", "b", "three")], "chunk_id string, doc_id string, content string")
    IX.publish(path, rows, 0)
    IX.publish(path, rows.where("chunk_id = 'a#1'"), 1)
    IX.retract(path, rows.where("doc_id = 'b'"), 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        read = IX.read_index(spark, path)
        assert "SortMergeJoin" not in read._jdf.queryExecution().executedPlan().toString()
        assert [r.chunk_id for r in read.collect()] == ["a#1"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
