"""Shapes of the physical plans that the scale argument rests on."""

import re

import pytest
from compare import DATA

from evidentia.plans import catalog

SF = f"{DATA}/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return re.sub(r"== Initial Plan ==.*?(?=\n\S|\Z)", "", plan_of(df), flags=re.S)


def test_bm25_reads_postings_and_cuts_before_the_shuffle(spark):
    plan = final_plan(catalog.QUERIES["r1_bm25"](spark, SF))
    # Scores of a chunk are summed where its bucket lies, and each task hands on its best rows only.
    below = plan[plan.index("row_number(), 10, Partial"):]
    scan = below[:below.index("FileScan parquet spark_catalog.default.evidentia_postings")]
    assert "Exchange" not in scan and "Bucketed: true" in below


def test_stored_index_is_searched_without_the_corpus(spark, tmp_path):
    from evidentia.sources import retrieval

    chunks = spark.createDataFrame([(i, f"common word{i % 7} text{i}", "a" if i % 2 else "b") for i in range(60)], "chunk_id int, text string, kind string")
    asked = spark.createDataFrame([(1, "word3 common", ["a"]), (2, "text12", None)], "query_id int, question string, allowed array<string>")
    built = retrieval.build_index(chunks, str(tmp_path / "index"), "kind", buckets=3)
    again = retrieval.open_index(spark, str(tmp_path / "index"))
    for search in (retrieval.search_lexical, retrieval.search_dense):
        got = [sorted(map(tuple, search(index, asked, 5, True).collect())) for index in (built, again)]
        assert got[0] == got[1] and {r[1] % 2 for r in got[0] if r[0] == 1} == {1}
        plan = plan_of(search(again, asked, 5, True))
        # The texts of chunks are not among what is read.
        assert "ExistingRDD[chunk_id" not in plan and "FileScan parquet" in plan


@pytest.mark.parametrize("name", ["r1_bm25", "r5_hybrid_search", "r3_exact_dense", "c5_record_chunks", "v10_gate", "c15_boilerplate", "v13_section_completion"])
def test_no_cross_products(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(catalog.QUERIES["s11_delete_documents"](spark, SF))
    assert "EqualTo(c_mktsegment,BUILDING)" in plan
    scan = plan_of(catalog.QUERIES["x4_run_completion"](spark, SF))
    assert re.search(r"ReadSchema: struct<event_id:bigint,user_id:bigint>", scan)


def test_only_bounded_groups_go_to_python(spark):
    assert "FlatMapGroupsInPandas" not in plan_of(catalog.QUERIES["r5_hybrid_search"](spark, SF))


def test_an_arm_is_built_when_it_is_searched(spark, monkeypatch):
    from evidentia.plans import q_retrieval as Q
    from evidentia.plans.inputs import load

    monkeypatch.setattr(Q, "_INDEXES", {})
    t = lambda name: load(spark, SF, name)
    catalog.QUERIES["r3_dense_text"](spark, SF)
    [built] = Q._INDEXES.values()
    assert built.postings is None and built.vectors is not None
    both = Q.stored(t)
    assert both.vectors is built.vectors and both.postings is not None


def test_terms_are_counted_inside_a_row_before_the_shuffle(spark):
    from evidentia.operators import lexical

    df = spark.createDataFrame([(1, "reports of the reefs"), (2, None)], "chunk_id int, text string")
    plan = plan_of(lexical.postings(df))
    assert plan.index("Generate") < plan.index("Exchange") < plan.index("MapInArrow") and "Aggregate" not in plan


def test_candidates_go_to_the_vectors(spark):
    from evidentia.operators import retrieve

    pool = spark.createDataFrame([(1, 7), (1, 9), (2, 7)], "query_id int, chunk_id int")
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(20)], "chunk_id int, vector array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = retrieve.with_vectors(pool, vectors)
        assert "SortMergeJoin" not in plan_of(joined)
        assert sorted((r.query_id, r.chunk_id, r.vector[0]) for r in joined.collect()) == [(1, 7, 7.0), (1, 9, 9.0), (2, 7, 7.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
