"""Streams and searches over inputs in the shapes of a real store."""

import os
import subprocess
import sys

from compare import DATA

from evidentia.operators import dense
from evidentia.plans import catalog
from evidentia.plans.q_streams import drain, stream_of
from evidentia.streaming import trace as TR


def test_streams_read_every_file_of_a_table(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    table = spark.read.parquet(f"{tmp_path}/events.parquet")
    assert len(table.inputFiles()) == 4
    assert drain(stream_of(table).select("event_id"), "all").count() == events.count()
    for name in ("x3_idempotent_stream", "x4_session_stream"):
        one = catalog.QUERIES[name](spark, f"{DATA}/sf0.001")
        four = catalog.QUERIES[name](spark, str(tmp_path))
        assert four.exceptAll(one).isEmpty() and one.exceptAll(four).isEmpty()


def test_stream_gives_open_sessions_too(spark):
    frames = spark.createDataFrame(
        [(1, 1, "2024-01-01 00:00:00", "query.received"), (1, 2, "2024-01-01 00:10:00", "answer.completed"), (1, 3, "2024-01-01 09:00:00", "query.received"), (2, 4, "2024-01-01 09:05:00", "error")],
        "run_id long, sequence_number long, created_at string, step_type string")
    every = TR.sessions(frames)
    closed = every.where("ended < '2024-01-01 05:00:00'")
    got = TR.with_open_sessions(closed, frames)
    assert closed.count() == 1 and sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect()))


def test_dense_search_of_vectors_that_are_not_unit(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, [float(-i), 1.0], "a" if i % 2 else "b") for i in range(20)], "chunk_id long, vector array<double>, kind string")
    asked = spark.createDataFrame([(1, [1e5, 0.0], None), (2, [20.0, 0.0], ["a"]), (3, [0.0, 1.0], ["b"])], "query_id long, vector array<double>, allowed array<string>")
    want = {1: [0, 1, 2, 3], 2: [1, 3, 5, 7], 3: [0, 2, 4, 6]}
    for scores in (1, 7, 1 << 22):
        monkeypatch.setattr(dense, "SCORES", scores)
        got = dense.nearest(chunks, asked, 4, label="kind").orderBy("query_id", "rank").collect()
        assert {q: [r.chunk_id for r in got if r.query_id == q] for q in want} == want
    few = dense.nearest(chunks.where("chunk_id = 9"), asked.where("query_id = 2"), 4, label="kind").first()
    assert few.chunk_id == 9 and few.score == -180.0


def test_workers_find_the_package_from_any_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from evidentia.plans import catalog
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert catalog.QUERIES["r3_exact_dense"](spark, "{DATA}/sf0.001").count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=180, capture_output=True)


def test_frames_that_share_a_place_do_not_depend_on_how_they_are_read(spark):
    rows = [(1, 1, "2024-01-01 08:00:00"), *[(1, 2, f"2024-01-01 09:{m:02d}:00") for m in range(20)], (1, 3, "2024-01-01 09:05:00")]
    for given in (rows, rows[::-1]):
        frames = spark.createDataFrame(given, "run_id long, sequence_number long, created_at string").coalesce(1)
        assert [(r.sequence_number, r.created_at[11:16]) for r in TR.out_of_order(frames).collect()] == [(3, "09:05")]
