"""The live index: equal to a rebuild after any history, atomic versions, conflicts, replays, merges."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evidentia.sources import retrieval as R
from evidentia.sources import segments as S

SCHEMA = "chunk_id string, doc_id string, text string"
TEXTS = {
    "a": ["the river turned turquoise near the pier", "boats keep away from the river"],
    "b": ["a bloom of plankton by the pier", "samples are taken twice"],
    "c": ["guests stay inside until the storm has passed"],
    "d": ["river samples hold carbonates", "the storm moved the boats", "plankton feeds the fish"],
}
ASKED = ["turquoise river", "plankton bloom samples", "storm boats", "guests and fish by the pier"]


def rows(spark, texts):
    return spark.createDataFrame([(f"{d}#{i}", d, t) for d, parts in texts.items() for i, t in enumerate(parts)], SCHEMA)


def found(spark, index):
    asked = spark.createDataFrame(list(enumerate(ASKED)), "query_id int, question string")
    lexical = {(r.query_id, r.chunk_id, r.score, r.rank) for r in R.search_lexical(index, asked, 5).collect()}
    dense = {(r.query_id, r.chunk_id, round(r.score, 6), r.rank) for r in R.search_dense(index, asked, 5).collect()}
    counts = {(r.term, r.df, r.total_len) for r in index.counts.collect()}
    return lexical, dense, counts


def check(spark, path, texts, tmp_path):
    rebuilt = R.build_index(rows(spark, texts), str(tmp_path / f"rebuild{len(list(tmp_path.iterdir()))}"))
    want = found(spark, rebuilt)
    assert found(spark, S.load(spark, path)) == want and want[0]


def test_history_equals_a_rebuild(spark, tmp_path):
    path, texts = str(tmp_path / "live"), {}
    S.create(spark, path)
    for step in ({"a": TEXTS["a"], "b": TEXTS["b"]}, {"c": TEXTS["c"]}, {"a": ["the pier is closed"], "d": TEXTS["d"]}, {"b": TEXTS["c"] + TEXTS["a"]}):
        S.publish(path, rows(spark, step))
        texts |= step
    check(spark, path, texts, tmp_path)
    S.remove(path, spark.createDataFrame([("d",), ("unknown",)], "doc_id string"))
    del texts["d"]
    check(spark, path, texts, tmp_path)
    # A batch of one document writes one segment and no other file; removed documents may come back.
    before = {f for f in (tmp_path / "live" / "segments").iterdir()}
    S.publish(path, rows(spark, {"d": TEXTS["d"]}))
    texts["d"] = TEXTS["d"]
    assert len({f for f in (tmp_path / "live" / "segments").iterdir()} - before) == 1
    check(spark, path, texts, tmp_path)
    # Merging some segments, then all, changes no result, and what follows still counts right.
    seen = S.snapshot(spark, path)
    S.merge(spark, path, seen.ids[1:4])
    check(spark, path, texts, tmp_path)
    S.publish(path, rows(spark, {"c": ["a quiet season"]}))
    texts["c"] = ["a quiet season"]
    check(spark, path, texts, tmp_path)
    last = S.merge(spark, path, S.snapshot(spark, path).ids)
    assert len(last.segments) == 1 and last.segments[0]["kills"] == 0 and last.segments[0]["chunks"] == sum(map(len, texts.values()))
    check(spark, path, texts, tmp_path)
    # An older version reads as it was.
    old = found(spark, S.load(spark, path, seen))
    assert old != found(spark, S.load(spark, path)) and S.versions(spark, path) == list(range(last.version + 1))


def test_of_two_writers_of_one_version_one_fails(spark, tmp_path):
    path = str(tmp_path / "live")
    base = S.create(spark, path)
    S.publish(path, rows(spark, {"a": TEXTS["a"]}), base=base)
    with pytest.raises(S.VersionConflict):
        S.publish(path, rows(spark, {"b": TEXTS["b"]}), base=base)
    assert [r.doc_id for r in S.live_documents(spark, path, S.snapshot(spark, path)).collect()] == ["a"]
    S.publish(path, rows(spark, {"b": TEXTS["b"]}))
    check(spark, path, {k: TEXTS[k] for k in "ab"}, tmp_path)
    with pytest.raises(S.VersionConflict):
        S.create(spark, path)


def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "live")
    S.create(spark, path)
    S.publish(path, rows(spark, {"a": TEXTS["a"]}))
    embed = S.dense.embed

    def dies(*args, **options):
        monkeypatch.setattr(S.dense, "embed", embed)
        return embed(*args, **options).withColumn("vector", F.when(F.raise_error(F.lit("executor lost")).isNull(), F.col("vector")))

    monkeypatch.setattr(S.dense, "embed", dies)
    with pytest.raises((PySparkException, Py4JJavaError)):
        S.publish(path, rows(spark, {"a": ["changed"], "b": TEXTS["b"]}))
    assert len(list((tmp_path / "live" / "segments").iterdir())) == 2  # half a segment that no version names
    check(spark, path, {"a": TEXTS["a"]}, tmp_path)
    S.publish(path, rows(spark, {"b": TEXTS["b"]}))
    check(spark, path, {k: TEXTS[k] for k in "ab"}, tmp_path)


def test_replays_keys_and_policy(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "live")
    S.create(spark, path)
    for batch in (0, 1, 1, 0):
        S.publish(path, rows(spark, {f"d{batch}": TEXTS["a"]}), writer="stream", batch=batch)
    assert S.snapshot(spark, path).version == 2
    with pytest.raises(PySparkException, match="without a chunk_id"):
        S.publish(path, spark.createDataFrame([(" ", "x", "t")], SCHEMA))
    with pytest.raises(PySparkException, match="occurs twice"):
        S.publish(path, spark.createDataFrame([("k", "x", "t"), ("k", "y", "t")], SCHEMA))
    monkeypatch.setattr(S, "FANOUT", 3)
    assert S.merge(spark, path).version == 2  # two segments are not due
    S.publish(path, rows(spark, {"e": TEXTS["b"]}))
    assert len(S.merge(spark, path).segments) == 1
    with pytest.raises(FileNotFoundError):
        S.snapshot(spark, path, 99)


def test_kills_go_to_the_rows_of_chunks(spark, tmp_path):
    path = str(tmp_path / "live")
    S.create(spark, path)
    S.publish(path, rows(spark, {"a": TEXTS["a"], "b": TEXTS["b"]}))
    S.publish(path, rows(spark, {"a": TEXTS["c"]}))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        index = S.load(spark, path)
        for table in (index.postings, index.vectors):
            assert "SortMergeJoin" not in table._jdf.queryExecution().executedPlan().toString()
        # Dead chunks go before the terms of a chunk are unfolded.
        plan = index.postings._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Generate") < plan.index("LeftAnti")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    check(spark, path, {"a": TEXTS["c"], "b": TEXTS["b"]}, tmp_path)
