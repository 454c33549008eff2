"""The pipeline against a brute-force version of its stages, and the entry without it."""

import os
import random
import re
import shutil
import subprocess
import sys

import corpus_pipeline
from helpers import CLASHING, documents, odd
from test_documents import WORDS, plain_components, plain_fingerprint, prose, split

from evidentia.llm import decontaminate

ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def test_stages_do_their_work_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(15)
    clean = [(i, " ".join(rng.choices(WORDS[:600], k=rng.randint(60, 200)))) for i in range(80)]
    junk = [(1000 + i, " ".join(f"{w.upper()}!!" for w in rng.choices(WORDS[:600], k=100))) for i in range(25)]
    copies = [(2000 + i, t) for i, t in clean[:10]]
    passage, item = prose(rng, 60), prose(rng, 30)
    repeats = [(3000 + i, f"{' '.join(rng.choices(WORDS[:600], k=80))} {passage} {' '.join(rng.choices(WORDS[:600], k=80))}") for i in range(4)]
    leaks = [(4000 + i, f"{' '.join(rng.choices(WORDS[:600], k=90))} {item}") for i in range(3)]
    rows = odd(clean + junk + copies + repeats + leaks)
    labels = [(i, 1, 0) for i, _ in [*clean, *repeats, *leaks]] + [(i, 0, 0) for i, _ in junk]
    docs = documents(spark, rows, CLASHING)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for number, (name, work) in enumerate(corpus_pipeline.STAGES):
        out = work(spark, now, str(tmp_path))
        assert number == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{number}")
        now = spark.read.parquet(f"{tmp_path}/{number}")
        kept[name] = now.collect()
    texts = dict(rows)
    ids = {name: {r.doc_id for r in found} for name, found in kept.items()}
    assert ids["quality_rules"] == {i for i, _ in clean + copies + repeats + leaks}
    pool = sorted(ids["quality_rules"])
    groups = plain_components([plain_fingerprint(texts[i]) for i in pool])
    assert ids["simhash_near_dedup"] == {pool[g] for g in groups} == {i for i, _ in clean + repeats + leaks}
    assert len(kept["simhash_near_dedup"]) == len(ids["simhash_near_dedup"])
    cut = {r.doc_id: r for r in kept["suffix_array_dedup"]}
    assert sum(passage in r.text for r in cut.values()) == 1 and passage in cut[3000].text
    assert all(r.n_chars == len(r.text) for r in cut.values()) and all(cut[i].text == t for i, t in clean)
    assert ids["benchmark_decontamination"] == ids["suffix_array_dedup"] - {i for i, _ in leaks}
    assert ids["sentencepiece"] == ids["benchmark_decontamination"]
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.ids_sha256) for r in run} == {(r.doc_id, r.ids_sha256) for r in kept["sentencepiece"]}


def test_near_duplicates_by_fingerprint_and_by_shingles(spark, tmp_path):
    rng = random.Random(8)
    base = " ".join(rng.choices(WORDS, k=41) * 12)
    longer = f"{base} {prose(rng, 24)}"
    bits = (plain_fingerprint(base) ^ plain_fingerprint(longer)).bit_count()
    grams = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (base.split(), longer.split())]
    assert bits <= 2 and len(grams[0] & grams[1]) < 0.8 * len(grams[0] | grams[1])
    words = prose(rng, 200).split()
    edited = " ".join([*words[:100], "unheard", *words[101:]])
    assert (plain_fingerprint(" ".join(words)) ^ plain_fingerprint(edited)).bit_count() > 2
    rows = [(1, base), (2, longer), (3, " ".join(words)), (4, edited), (5, prose(rng, 90)), (5, prose(rng, 90)), (None, base)]
    kept = corpus_pipeline.simhash_near_dedup(spark, documents(spark, rows, CLASHING), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted((i or 0, t) for i, t in rows if i not in (2, 4))


def test_pipeline_of_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_works_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(re.match(r'op\\d|pipeline', n) for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", f"import re; {code}"], cwd=copy, check=True, timeout=120)


def test_every_operator_is_registered():
    sys.path.insert(0, ROOT)
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(re.match(rf"op{n}_", x) for x in names) for n in range(1, 14)) and "pipeline" in names
    assert split(" a b") == ["a", "b"] and decontaminate.run_length(40) == 3
