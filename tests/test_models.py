"""Operators without a SQL check against small brute-force models, and the block-wise scans."""

import random

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from evidentia.functions import scan
from evidentia.functions import text as X
from evidentia.operators import boilerplate, dense, fusion
from evidentia.operators.listing import widen_starved


def pack_model(pieces, limit, overlap, sep):
    out, buf = [], ""
    for p in pieces:
        if buf and len(buf) + len(p) + len(sep) > limit:
            out.append(buf.strip())
            buf = buf[-overlap:] + sep + p
        else:
            buf = buf + sep + p if buf else p
    return out + ([buf.strip()] if buf.strip() else [])


def sentence_model(sentences, limit, overlap):
    out, buf = [], ""
    for s in sentences:
        if buf and len(buf) + len(s) + 1 > limit:
            out.append(buf.strip())
            tail = buf[-overlap:]
            buf = tail[tail.index(" ") + 1:] + " " if " " in tail else ""
        buf += s + " "
    return out + ([buf.strip()] if buf.strip() else [])


def test_packing(spark):
    rnd = random.Random(7)
    texts = ["\n\n".join("w" * rnd.randint(1, 9) + " " + "x" * rnd.randint(1, 30) for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", X.pack_paragraphs(F.col("t"), 60, 15).alias("p"), X.pack_sentences(F.split("t", "\n\n"), 60, 15).alias("s")).collect()
    for r in rows:
        paragraphs = texts[r.i].split("\n\n")
        assert r.p == ([texts[r.i]] if len(texts[r.i]) <= 60 else pack_model(paragraphs, 60, 15, "\n\n"))
        assert r.s == sentence_model(paragraphs, 60, 15)


def test_pack_whole_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    for r in docs.select("text", X.pack_paragraphs(F.col("text"), 3200, 480, "\n").alias("p")).collect():
        parts = [p for p in r.text.split("\n") if p.strip()]
        assert r.p == ([r.text] if len(r.text) <= 3200 else pack_model(parts, 3200, 480, "\n"))


@pytest.mark.parametrize("block", [3, 1000])
def test_block_scans(spark, block):
    rnd = random.Random(1)
    # One key holds most of the rows.
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randint(0, 4)}", i, rnd.choice([None, None, f"v{i}"])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o long, v string")
    last, count, prev = {}, {}, {}
    want = {}
    for k, o, v in rows:
        before = prev.get(k)
        last[k] = v or last.get(k)
        count[k] = count.get(k, 0) + 1
        want[o] = (last[k], count[k], before)
        prev[k] = v
    filled = {r.o: r.v for r in scan.carry_forward(df, "k", "o", ["v"], block).collect()}
    placed = {r.o: r.v for r in scan.carry_forward(scan.place_blocks(df, "k", "o", block), "k", "o", ["v"]).collect()}
    numbered = {r.o: r.n for r in scan.number_rows(df, "k", "o", "n", block).collect()}
    previous = {r.o: r.p for r in scan.previous_value(df.withColumn("v", F.coalesce("v", F.lit("-"))), "k", "o", "v", "p", block).collect()}
    assert filled == placed == {o: w[0] for o, w in want.items()}
    assert numbered == {o: w[1] for o, w in want.items()}
    assert previous == {o: (None if w[1] == 1 else w[2] or "-") for o, w in want.items()}


def vectors(spark, n, dim=8, seed=3):
    m = np.random.default_rng(seed).normal(size=(n, dim))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m, spark.createDataFrame([(i, m[i].tolist(), "ab"[i % 2]) for i in range(n)], "chunk_id long, vector array<double>, label string")


@pytest.mark.parametrize("block", [4, 4096])
def test_nearest_blocks_and_filter(spark, block):
    m, chunks = vectors(spark, 300)
    asked = spark.createDataFrame([(i, m[i].tolist(), ["a"] if i % 3 == 0 else None) for i in range(20)], "query_id long, vector array<double>, allowed array<string>")
    plain = {(r.query_id, r["rank"]): r.chunk_id for r in dense.nearest(chunks.repartition(5), asked, 7, block).collect()}
    held = {(r.query_id, r["rank"]): r.chunk_id for r in dense.nearest(chunks.repartition(5), asked, 7, block, label="label").collect()}
    scores = np.round(m[:20] @ m.T, 6)
    for q in range(20):
        order = sorted(range(300), key=lambda i: (-scores[q, i], i))
        assert [plain[q, k] for k in range(1, 8)] == order[:7]
        kept = [i for i in order if q % 3 or i % 2 == 0]
        assert [held[q, k] for k in range(1, 8)] == kept[:7]


def test_nearest_ties_take_lower_id(spark):
    chunks = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(100)], "chunk_id long, vector array<double>").repartition(4)
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    assert sorted(r.chunk_id for r in dense.nearest(chunks, asked, 5).collect()) == [0, 1, 2, 3, 4]


def candidates(spark):
    m, _ = vectors(spark, 60, dim=3, seed=9)
    rows = [(q, i, i + 1, 1.0 - i / 40, m[(q * 20 + i)].tolist()) for q in range(3) for i in range(20)]
    return m, spark.createDataFrame(rows, "query_id long, chunk_id long, place int, relevance double, vector array<double>")


def test_near_duplicates(spark):
    m, df = candidates(spark)
    got = {(r.query_id, r.chunk_id) for r in fusion.drop_near_duplicates(df, 0.9).collect()}
    want = set()
    for q in range(3):
        kept = []
        for i in range(20):
            if not any(m[q * 20 + i] @ m[q * 20 + k] > 0.9 for k in kept):
                kept.append(i)
        want |= {(q, i) for i in kept}
    assert got == want


def test_diversify(spark):
    m, df = candidates(spark)
    got = {(r.query_id, r.pick): r.chunk_id for r in fusion.diversify(df, 6).collect()}
    for q in range(3):
        v, chosen = m[q * 20:q * 20 + 20], []
        while len(chosen) < 6:
            gain = lambda i: round(0.72 * (1.0 - i / 40) - 0.28 * max([0.0] + [v[i] @ v[k] for k in chosen]), 9)  # noqa: E731,B023
            chosen.append(max((i for i in range(20) if i not in chosen), key=lambda i: (gain(i), -i)))
        assert [got[q, k] for k in range(1, 7)] == chosen


def test_approximate_recall(spark):
    m, chunks = vectors(spark, 200)
    asked = spark.createDataFrame([(i, m[i].tolist()) for i in range(10)], "query_id long, vector array<double>")
    exact = dense.nearest(chunks, asked, 5)
    model = dense.train_cells(chunks, 8)
    placed = dense.assign_cells(chunks, model)
    near = dense.nearest_approximate(placed, asked, model, 5, probes=5)
    everything = dense.recall(exact, dense.nearest_approximate(placed, asked, model, 5, probes=8))
    assert everything.where("n_found < n_exact").count() == 0
    found = dense.recall(exact, near).agg(F.sum("n_found"), F.sum("n_exact")).first()
    assert found[0] / found[1] > 0.8


def test_fusion_bounds(spark):
    arms = spark.createDataFrame([(1, c, a, r, 1.0) for a in ("lexical", "dense") for r, c in enumerate("abc", 1)], "query_id int, chunk_id string, arm string, rank int, score double")
    rows = fusion.reciprocal_rank_fusion(arms).collect()
    assert all(r.rrf <= 2 / 61 + 1e-12 for r in rows) and len(rows) == 3


def test_boilerplate_keeps_opening_sentence(spark):
    shared = "Responders must keep the boundary closed until two samples are clear."
    rows = [(i, "fauna", f"FAU-{i}", [f"Record {i} opens here.", shared, "Own text."]) for i in range(3)] + [(3, "fauna", "FAU-3", [shared])]
    segments = spark.createDataFrame(rows, "segment_id long, record_type string, record_id string, sentences array<string>")
    marked = boilerplate.mark_shared(segments)
    cleaned = {r.segment_id: (r.sentences, r.removed) for r in boilerplate.clean_segments(marked).collect()}
    assert cleaned[0] == (["Record 0 opens here.", "Own text."], 1) and cleaned[3] == ([shared], 0)
    chunk = boilerplate.shared_chunks(marked).first()
    assert "across 3 records (FAU-0, FAU-1, FAU-2)" in chunk.content and shared in chunk.content


def test_widening_searches_only_the_starved(spark):
    hits = spark.createDataFrame([(1, "a", "R-1"), (1, "b", "R-2"), (2, "c", None)], "query_id int, chunk_id string, record_id string")
    wide = spark.createDataFrame([(1, "z", "R-9"), (2, "x", "R-3"), (2, "y", "R-4")], "query_id int, chunk_id string, record_id string")
    out = widen_starved(hits, lambda plenty: wide.join(plenty, "query_id", "left_anti"))
    assert {(r.query_id, r.chunk_id, r.widened) for r in out.collect()} == {(1, "a", False), (1, "b", False), (2, "x", True), (2, "y", True)}


def test_embedding_holds_a_bounded_part_of_a_batch():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from evidentia.functions import vectors

    embed, dim = vectors.word_vector().func, 384
    texts = [[f"word{(i * 7 + j) % 997}" for j in range(i % 60)] for i in range(8000)]
    texts[5:5] = [["long"] * 131_082, [], None]
    batch = pa.array(texts, pa.list_(pa.string()))
    tracemalloc.start()
    out = embed(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.7 * len(batch) * dim * 8 and len(out) == len(batch)
    for i in (0, 5, 6, 7, 8, 1023, 1024, 8002):
        assert np.array_equal(np.array(out[i].as_py()), np.array(embed(batch.slice(i, 1))[0].as_py()))
    assert len(embed(batch.slice(0, 0))) == 0


def test_words_and_terms_of_arrow_batches(spark):
    import pyarrow as pa

    from evidentia.functions import vectors, words
    from evidentia.operators import lexical

    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcings-S0129 \n.KİéΣss-İK中") for _ in range(rnd.randint(0, 80))) for _ in range(500)]
    texts += [None, "", "   ", "inc-12 FN-001 abc-1234 the-and running runs class -a- --", "a" * 900, "reports running " * 50, "ends", "ends"]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string").repartition(3)
    want = {}
    for r in df.select("chunk_id", X.tokens(F.col("text")).alias("k")).where("k IS NOT NULL").collect():
        for term in [*r.k, ""]:
            n, _ = want.get((r.chunk_id, term), (0, 0))
            want[r.chunk_id, term] = (n + 1, len(r.k))
    assert {(r.chunk_id, r.term): (r.tf, r.len) for r in lexical.postings(df).collect()} == want
    by_list = vectors.word_vector()(F.filter(X.cleaned_words(F.col("text")), lambda w: F.length(w) > 1))
    assert df.where(by_list != vectors.hashed_vector(F.col("text"))).count() == 0
    # A task holds a bounded part at a time, whatever the size of the batch.
    parts = [(high - low, len(data)) for low, high, data, *_ in words.spans(pa.array(["word " * 60_000] * 40 + ["a"] * 3000))]
    assert sum(n for n, _ in parts) == 3040 and all(n <= words.PART_ROWS and size <= words.PART_BYTES for n, size in parts)
    assert not list(words.spans(pa.array([], pa.string()))) and vectors.text_vector().func(pa.array([], pa.string())).type == pa.list_(pa.float64())
