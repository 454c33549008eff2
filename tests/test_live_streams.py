"""Lifecycle timers and report joins over many small batches, late rows included."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evidentia.streaming import lifecycle as LC
from evidentia.streaming import trace as TR

START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


def run(spark, tmp_path, stream, name):
    """Each call reads what has arrived since the one before."""
    out = str(tmp_path / name)
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).option("path", out)
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def test_lifecycle_over_batches_and_restarts(spark, tmp_path):
    folder, schema = str(tmp_path / "events"), "doc_id string, sequence long, at timestamp, event string"
    batches = [
        [("a", 1, at(0), "uploaded"), ("a", 2, at(1), "started"), ("b", 1, at(1), "uploaded"), ("z", 1, at(1), "completed")],
        [("a", 4, at(3), "deleted"), ("a", 3, at(2), "completed"), ("b", 2, at(2), "started"), ("b", 3, at(3), "deleted"), ("c", 1, at(3), "uploaded")],
        [("d", 1, at(16), "uploaded"), ("b", 4, at(14), "errored")],
        [("a", 5, at(17), "errored"), ("e", 1, at(40), "uploaded"), ("c", 2, at(40), "started")],
        [("f", 1, at(80), "uploaded")],
    ]
    with LC.rocksdb_state(spark):
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(schema).parquet(folder)
            changes = run(spark, tmp_path, LC.lifecycle(stream), "changes")
    got = {(r.doc_id, (r.at - START) / timedelta(hours=1), r.event, r.status, r.error) for r in changes.collect()}
    assert got == {
        ("a", 0.0, "uploaded", "pending", None), ("a", 1.0, "started", "indexing", None), ("a", 2.0, "completed", "indexed", None), ("a", 3.0, "deleted", "deleted", None),
        ("b", 1.0, "uploaded", "pending", None), ("b", 2.0, "started", "indexing", None), ("b", 3.0, "deleted", "refused", LC.BUSY),
        ("b", 14.0, "errored", "failed", None), ("c", 3.0, "uploaded", "pending", None), ("c", 15.0, "timer", "failed", LC.STUCK),
        ("d", 16.0, "uploaded", "pending", None), ("d", 28.0, "timer", "failed", LC.STUCK), ("e", 40.0, "uploaded", "pending", None), ("e", 52.0, "timer", "failed", LC.STUCK),
        ("f", 80.0, "uploaded", "pending", None)}
    now = {r.doc_id: r.status for r in LC.current_status(changes).collect()}
    assert now == {"a": "deleted", "b": "failed", "c": "failed", "d": "failed", "e": "failed", "f": "pending"}


def test_reports_meet_steps_in_any_order(spark, tmp_path):
    rs, ss = "report_id long, run_id long, created_at timestamp", "run_id long, sequence_number long, step_at timestamp"
    batches = [
        ([(1, 7, at(1)), (2, 8, at(1))], []),
        ([], [(7, 70, at(2)), (7, 71, at(2.5)), (7, 72, at(9)), (9, 90, at(4))]),
        ([(3, 9, at(3.5)), (4, 10, at(10))], [(1, 1, at(12))]),
        ([(5, 11, at(30))], [(11, 110, at(31))]),
        # Far behind the watermark: the stream drops this step of report 4.
        ([(6, 12, at(32))], [(10, 100, at(11)), (1, 2, at(33))]),
    ]
    for told, done in batches:
        spark.createDataFrame(told, rs).coalesce(1).write.mode("append").parquet(str(tmp_path / "reports"))
        spark.createDataFrame(done, ss).coalesce(1).write.mode("append").parquet(str(tmp_path / "steps"))
        joined = TR.with_steps_stream(spark.readStream.schema(rs).parquet(str(tmp_path / "reports")), spark.readStream.schema(ss).parquet(str(tmp_path / "steps")))
        streamed = run(spark, tmp_path, joined, "joined")
    pairs = lambda df: sorted((r.report_id, r.sequence_number) for r in df.select("report_id", F.coalesce("sequence_number", F.lit(0)).alias("sequence_number")).collect())
    assert pairs(streamed) == [(1, 70), (1, 71), (2, 0), (3, 90), (4, 0), (5, 110)]
    stored = spark.read.schema(rs).parquet(str(tmp_path / "reports")), spark.read.schema(ss).parquet(str(tmp_path / "steps"))
    assert pairs(TR.settled(streamed, *stored)) == [(1, 70), (1, 71), (2, 0), (3, 90), (4, 100), (5, 110), (6, 0)]
