"""Periodic runs against their definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import CLASHING, LONG, documents, odd
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import periods


def brute(words, least=6):
    """Every maximal stretch by its smallest period, from the definition."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(least, 4 * q):
                found.setdefault((i - q, j - i + q), q)  # the smallest period comes first
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def ids(words):
    numbers = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 9), st.integers(0, 6)), max_size=6))
def test_runs_equal_their_definition(parts):
    words = [w for part, times, more in parts for w in (part * (times + 1))[:len(part) * times + more % (len(part) + 1)]]
    assert [tuple(r) for r in periods.word_runs(ids(words)).tolist()] == brute(words)


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_few_words_equal_their_definition(seed):
    rng = random.Random(seed)
    words = [rng.randrange(1 + seed % 3) for _ in range(rng.randint(0, 400))]
    assert [tuple(r) for r in periods.word_runs(ids(words)).tolist()] == brute(words)


def test_a_word_repeated_very_often_is_one_run():
    assert periods.word_runs(np.zeros(1_000_000, np.int64)).tolist() == [[0, 1_000_000, 1]]
    period = np.arange(30_000)
    assert periods.word_runs(np.tile(period, 5)).tolist() == [[0, 150_000, 30_000]]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words) if n < 5000 else [tuple(r) for r in periods.word_runs(ids(words)).tolist()]
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["a", "b", "é", "c d", "x\ty"], k=rng.randint(0, 120)))) for i in range(150)]
    rows += [(200 + i, " ".join((["p", "q", "r"] * 20)[:i + 9])) for i in range(20)] + [(300, LONG), (301, "  " * 9)]
    rows = odd(rows)
    documents(spark, rows, CLASHING).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in periods.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((expected(i, t) for i, t in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if i is not None and t)


def test_empty_table_and_outputs(spark):
    none = documents(spark, [(1, "a")]).where("doc_id = 2")
    assert periods.periodic_runs(none).count() == 0
    [row] = periods.periodic_runs(documents(spark, [(1, "so la la la la la la la ti")])).collect()
    assert row.n_words == 9 and [tuple(r) for r in row.runs] == [(1, 7, 1)] and row.collapsed == "so la ti"
