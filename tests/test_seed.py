"""The register is chunked after one shuffle of narrow rows, and what is stored of it is packed."""

import os
from collections import Counter

import pytest
from compare import DATA
from test_ingest_chunks import BODY, ODD
from pyspark.sql import functions as F
from test_plans import plan_of

from evidentia.functions import durable as DU
from evidentia.functions import vectors as V
from evidentia.operators import structure as C
from evidentia.plans import catalog
from evidentia.plans import q_ingest as Q
from evidentia.plans.inputs import load, register_lines

SF = f"{DATA}/sf0.001"
MORE = {
    "hashes": f"#no blank\n{BODY}\n#\nField Note FN-A, one that is long enough to be kept as a note.\n# One\n#two Laboratory Note LAB-C. Another that is long enough to be kept here.\n{BODY}",
    "repeats": "\n".join(["| WS-1 | a | b | c | 2026-01-02 |", "| WS-1 | a | b | c | 2026-01-03 |", "|| SV-2 | x ||", " | SV-2 | x | y"] * 2),
    "records": f"### INC-7 — A\n{BODY}\n[[PAGE 3]]\n## 1. One\n### INC-7 — A\nField Note FN-B. {BODY}\n### INC-7\n[[PAGE 4]]\n## 2. Two\n{BODY}",
}


def odd_lines(spark, step=3):
    rows = [(k, i * step - 7, line) for k, v in (ODD | MORE).items() for i, line in enumerate(v.split("\n"))]
    return spark.createDataFrame([*rows, ("null", 0, None), ("null", 1, "# x"), ("null", 2, None)], "doc_id string, line_no long, text string")


def chunks_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("step", [1, 70_000])
def test_documents_in_a_task_and_in_blocks_give_the_same_chunks(spark, step):
    lines = odd_lines(spark, step)
    placed, blocks = C._placed_chunks(lines), C._block_chunks(lines)
    assert placed.dtypes == blocks.dtypes and placed.columns == C.CHUNK_COLUMNS
    assert chunks_of(placed) == chunks_of(blocks) and placed.count() > 20


def test_large_documents_are_scanned_in_blocks(spark, monkeypatch):
    lines = odd_lines(spark)
    want, seen, blocks = chunks_of(C.corpus_chunks(lines)), [], C._block_chunks
    monkeypatch.setattr(C, "LARGE_LINES", 20)
    monkeypatch.setattr(C, "_block_chunks", lambda rows: seen.extend(r[0] for r in rows.select("doc_id").distinct().collect()) or blocks(rows))
    assert chunks_of(C.corpus_chunks(lines)) == want
    assert sorted(seen) == ["a", "long"]


def test_rendered_lines_are_the_register(spark):
    lines = register_lines(load(spark, SF, "customer"), load(spark, SF, "orders"))
    want = load(spark, SF, "record_lines")
    assert lines.dtypes == want.dtypes and chunks_of(lines) == chunks_of(want)


@pytest.mark.parametrize("many", [0, 8])
def test_register_is_chunked_with_one_shuffle(spark, monkeypatch, many):
    if many:
        monkeypatch.setattr(C, "LARGE_LINES", many * 14)
    chunks = Q.register_chunks(lambda name: load(spark, SF, name))
    assert chunks_of(chunks) == chunks_of(C._block_chunks(load(spark, SF, "record_lines")))
    if many:
        # Rows of large documents are dropped before the others are placed.
        few = F.broadcast(spark.createDataFrame([("C1",)], "doc_id string"))
        rows = plan_of(register_lines(load(spark, SF, "customer"), load(spark, SF, "orders"), few))
        assert rows.index("LeftAnti") > rows.index("Exchange hashpartitioning")
    else:
        plan = plan_of(catalog.QUERIES["u1_corpus_chunks"](spark, SF))
        assert plan.count("Exchange") == plan.count("Exchange hashpartitioning") == 1
        # Texts do not exist yet where the rows are shuffled.
        assert "Generate" not in plan[plan.index("Exchange hashpartitioning"):]


def shared_files(folder):
    return {os.path.join(at, f): os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files if f.startswith("part-")}


def test_vectors_are_packed_without_their_zeros():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    vectors = [None, [], [0.0], [float("inf"), -0.0], *[(rng.random(n) * (rng.random(n) < 0.15)).astype("f4").tolist() for n in (384, 1, 7, 8, 9, 383, 384)], None, [0.0] * 384]
    for rows in (vectors, vectors[::-1], [None, None], [], [[]], [[0.0], None]):
        packed = V.pack_floats().func(pa.array(rows, pa.list_(pa.float32())))
        assert repr(V.unpack_floats().func(packed).to_pylist()) == repr(rows)
        assert all(b is None if v is None else len(b) == 4 + 4 * -(-len(v) // 32) + 4 * sum(str(x) != "0.0" for x in v) for v, b in zip(rows, packed.to_pylist(), strict=True))


def test_seeded_index_is_packed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(DU, "shared_folder", lambda session: str(tmp_path))
    n = catalog.QUERIES["s12_bulk_seed"](spark, SF).first().chunks
    files = {k: v for k, v in shared_files(tmp_path).items() if "version=0" in k}
    assert files and all(k.endswith(".zstd.parquet") for k in files)
    assert n > 2000


def test_inventory_stores_no_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(DU, "shared_folder", lambda session: str(tmp_path))
    chunks = Q.register_chunks(lambda name: load(spark, SF, name))
    problems = catalog.QUERIES["s12_inventory"](spark, SF).count()
    files = shared_files(tmp_path)
    assert problems and files
    # A bit more than the keys of chunks with a problem, which are one in twelve.
    assert sum(files.values()) < 0.1 * chunks.selectExpr("sum(length(content))").first()[0]
    kept = spark.read.parquet(*{os.path.dirname(f) for f in files})
    assert "content" not in kept.columns and kept.where("chunk_id IS NOT NULL").count() <= problems
