"""Whole documents are cut in one pass: the same chunks as by lines, with few shuffles."""

import pytest
from compare import DATA
from pyspark.sql import functions as F

from evidentia.functions import labels as L
from evidentia.functions import text as X
from evidentia.functions import vectors as V
from evidentia.operators import structure as C
from evidentia.plans import q_ingest as Q
from evidentia.plans.inputs import load
from test_plans import plan_of

BODY = "The responders keep the boundary closed until two consecutive samples are clear. " * 3
ODD = {
    "empty": "", "blank": "  \n \r\n", "marker": "[[PAGE 7]]", "markers": f"[[PAGE 1]]\n  [[PAGE 2]]  \r\n{BODY}\n[[PAGE 3]]\n# Then\n{BODY}\n[[PAGE 4]]\n\n{BODY}",
    "late": f"{BODY}\n[[PAGE 5]]\n#### fourth level\n{BODY}\n#\n#no blank\n{BODY}\n   ## 4. Chapter four  \n{BODY}",
    "long": "## 2. Long\n" + "\n\n".join(f"{i} {BODY}" for i in range(60)),
    "a": f"""[[PAGE 1]]
  # Register \r
{BODY}
## 3. Orders — first
[[PAGE 2]]
### INC-1 — Delay \t
Initial risk level: HIGH
{BODY} Field Note FN-A, observer 1 saw a  bloom near the pier on 2026-06-14 at noon. Laboratory Note LAB-C. The sample held carbonates but was small.
#### Field Note FN-B
Field Note FN-B. A note of its own below a heading of the fourth level stands here.
#
Field Note FN-A
# x
| WS-5 | Emerald Canopy | 2026-01-02 | Low | clear |
| WS-5 | Emerald Canopy | 2026-01-02 | Low | again |
  | WS-5 | Emerald Canopy | 2026-01-03 | 24.1 | clear |
| no id | 1 | 2 |
### Knowledge Card KC-2
{BODY}
###
### INC-1 — Delay
[[PAGE 99999]]
{BODY} See MED-1, XINC-7, INC-7x, A_INC-8 and POL-3.
## Not a chapter
[[PAGE 12]]

{BODY}
   
{BODY}""",
}


def by_lines(docs, threshold):
    """The modes as they are defined over lines."""
    lines = C.explode_lines(docs, ["doc_id"]).cache()
    modes = C.chunking_mode(lines, threshold)
    aware = C.corpus_chunks(lines.join(modes.where("mode = 'record_aware'"), "doc_id", "left_semi"))
    uploads = C.upload_chunks(lines.join(modes.where("mode = 'narrative'"), "doc_id", "left_semi"), docs.select("doc_id", "doc_name")).select(
        F.concat_ws("-", "doc_id", F.lit("up"), F.col("piece").cast("string"), F.col("window_no").cast("string")).alias("chunk_id"), "doc_id",
        F.col("piece").alias("ordinal"), "title", "section", "page", F.lit("narrative").alias("record_type"),
        L.evidence_quality(F.lit("narrative"), F.col("content")).alias("evidence_quality"), "content")
    return aware.unionByName(uploads, allowMissingColumns=True)


@pytest.mark.parametrize("threshold", [0, 3, 5, 100])
def test_same_chunks_as_by_lines(spark, threshold):
    docs = spark.createDataFrame([(k, f"Name of {k}", v) for k, v in ODD.items()] + [("none", "n", None)], "doc_id string, doc_name string, text string")
    want, got = by_lines(docs, threshold), C.chunk_documents(docs, threshold)
    assert got.columns == want.columns
    a, b = ({tuple(r) for r in df.collect()} for df in (got, want))
    assert a == b and len(a) > 5


def test_documents_are_cut_with_few_shuffles(spark):
    docs = spark.createDataFrame([("a", "n", ODD["a"])], "doc_id string, doc_name string, text string")
    # Repeats of a table row, and repeats of a key; the documents themselves were placed before.
    assert plan_of(C.chunk_documents(docs, 3)).count("Exchange hashpartitioning") <= 2
    assert plan_of(C.document_parts(docs, 3)).count("Exchange hashpartitioning") == 1


def test_register_is_the_same_by_lines_and_by_orders(spark):
    t = lambda name: load(spark, f"{DATA}/sf0.001", name)
    lines = t("record_lines").groupBy("doc_id").agg(F.expr("listagg(text, '\n') within group (order by line_no)").alias("text"))
    want, got = ({tuple(r) for r in df.select("doc_id", "text").collect()} for df in (lines.join(Q.register_documents(t).select("doc_id"), "doc_id"), Q.register_documents(t)))
    assert got == want and "Generate" not in plan_of(Q.register_documents(t))


def test_vectors_are_stored_as_bytes(spark, tmp_path):
    from evidentia.operators.dense import embed
    from evidentia.sources import index as IX

    path = str(tmp_path / "index")
    IX.create_index(spark, path)
    rows = spark.createDataFrame([("a#1", "a", "two words"), ("b#1", "b", ""), ("c#1", "c", None)], "chunk_id string, doc_id string, content string")
    exact = embed(rows, "content").withColumn("vector", F.col("vector").cast("array<float>"))
    IX.publish(path, embed(rows, "content", single=True).unionByName(rows.selectExpr("concat('x', chunk_id) chunk_id", "concat('x', doc_id) doc_id", "content"), True), 0)
    assert dict(spark.read.parquet(path).dtypes)["vector"] == "binary"
    read = {r.chunk_id: r.vector for r in IX.read_index(spark, path).collect()}
    assert {k: v for k, v in read.items() if k[0] != "x"} == {r.chunk_id: r.vector for r in exact.collect()}
    assert [read[k] for k in ("xa#1", "xb#1", "xc#1")] == [None] * 3
    assert "ArrowEvalPython" not in plan_of(IX.read_index(spark, path).groupBy("doc_id").count())


def test_packed_vectors_come_back():
    import pyarrow as pa

    vectors = pa.array([[1.5, 2.25], None, [], [3.0, None]], pa.list_(pa.float64()))
    for part in (vectors, vectors.slice(1, 2), vectors.slice(0, 0)):
        want = [None if v is None else [x or 0.0 for x in v] for v in part.to_pylist()]
        assert V.unpack_floats().func(V.pack_floats().func(part)).to_pylist() == want


def test_any_phrase_is_found(spark):
    phrases = ["a.b", "^x", "-y", "[z]", "&&q", "did not"]
    rows = spark.createDataFrame([(p,) for p in phrases] + [("axb",), ("x",), ("y",), ("z",), ("q",), ("",)], "t string")
    assert [r[0] for r in rows.select(X.contains_any(F.col("t"), phrases)).collect()] == [True] * 6 + [False] * 6
