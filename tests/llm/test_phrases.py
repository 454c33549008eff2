"""Phrase collocations against counting every phrase by itself."""

import random
import re
from collections import Counter, defaultdict

import pytest
from compare import connect, difference
from helpers import CLASHING, LONG, documents

from evidentia.llm import phrases

FOLD = str.maketrans(phrases.UPPER, phrases.LOWER)


def brute(rows, longest, least, best):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(words)
            f[lang].update(words[i:i + m] for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    out = set()
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inside = {q[i:j] for q, b in candidates.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) and candidates[q[i:j]] <= b}
        found = []
        for p, a in candidates.items():
            if p not in inside:
                score, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]], score))
        out |= {(lang, i, p.decode(), a, left, right, total[lang], score) for i, (_, _, p, a, left, right, score) in enumerate(sorted(found)[:best], 1)}
    return out


def corpus():
    rng = random.Random(3)
    words = ["a", "B", "c", "é", "a\x01", "\x00", "zu", "to be", "to be or", "x\ty", "[INST]", " "]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", ", ", ".\n", "\x0b"]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    return [*rows, ("en", None), (None, None), ("en", ""), ("en", " .,; "), *rows[:9], ("fr", LONG), ("en", "the line that is everywhere " * 300)]


def table_of(spark, rows, extra=()):
    df = documents(spark, [(i, t) for i, (_, t) in enumerate(rows)], extra)
    langs = spark.createDataFrame([(i, lang) for i, (lang, _) in enumerate(rows)], "doc_id long, lang string")
    return df.drop("lang").join(langs, "doc_id")


@pytest.mark.parametrize("longest, least, best, batch", [(5, 3, 2000, 10_000), (5, 2, 40, 7), (2, 3, 5, 1), (3, 5, 2000, 64)])
def test_phrases_equal_brute_force(spark, longest, least, best, batch):
    rows = corpus()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [tuple(r) for r in phrases.collocations(table_of(spark, rows, (*CLASHING, "n", "rank", "phrase", "window", "depth", "lang_")), longest, least, best).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute(rows, longest, least, best)
    assert set(got) == want and len(got) == len(want) > 0


def test_slices_do_not_change_the_result(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(phrases, "SLICE", 50)
    assert {tuple(r) for r in phrases.collocations(table_of(spark, rows), 5, 3).collect()} == brute(rows, 5, 3, 2000)


def test_counts_beyond_64_bits_stay_exact(spark):
    rows = [("x", 0, "", 3 * 10**12), ("x", 1, "a", 10**12 + 1), ("x", 1, "b", 10**12 + 7), ("x", 2, "a b", 10**12 - 1)]
    [row] = phrases.scored(spark.createDataFrame(rows, "lang string, depth int, phrase string, n long")).collect()
    assert row.score == 1000 * row.a * row.n // (row.l * row.r) and (row.l, row.r) == (10**12 + 1, 10**12 + 7)


def test_empty_table(spark):
    assert phrases.collocations(documents(spark, [(1, "a")]).where("doc_id = 2")).count() == 0


def test_query_equals_its_check(spark):
    assert difference(spark, connect("0.01"), "op12", phrases.op12_collocations, phrases.OP12_SQL, "0.01") is None
