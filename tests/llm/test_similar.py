"""Near-duplicates of the pipeline against all pairs, with edited copies."""

import random

import corpus_pipeline
import numpy as np
from helpers import CLASHING, documents, odd
from test_documents import WORDS, prose, split

from evidentia.llm import similar


def grams(text):
    words = split(text.lower())
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_edited_copies_leave_one_of_each_group(spark):
    rng = random.Random(21)
    rows = []
    for base in range(60):
        words = prose(rng, rng.choice([40, 100, 400])).split()
        rows.append((100 * base, " ".join(words)))
        for copy in range(1, 5):
            new = list(words)
            for at in rng.sample(range(len(new)), rng.randint(1, max(1, len(new) // 40))):
                new[at] = rng.choice(WORDS)
            rows.append((100 * base + copy, " ".join(new)))
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {rows[find(i)][0] for i in range(len(rows))}
    docs = documents(spark, odd(rows), CLASHING)
    out = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(want | {9001}) and len(want) < 150
    assert sum(r.doc_id is None for r in got) == 2


def test_a_large_group_of_near_copies_is_one(spark, monkeypatch):
    """Far more members than a tile holds."""
    monkeypatch.setattr(similar, "TILE_MEMBERS", 16)
    rng = random.Random(22)
    words, rows = prose(rng, 100).split(), []
    for i in range(400):
        new = list(words)
        new[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(new)))
    assert [r.doc_id for r in similar.one_of_similar(documents(spark, rows)).collect()] == [0]


def test_one_similar_pair_among_thousands_of_unlike_texts_of_a_template(spark):
    """The texts of the template are at 0.64 to each other, the pair at 0.83, and nothing else is connected."""
    rng = random.Random(24)
    template, rows = prose(rng, 156).split(), []
    for i in range(3000):
        rows.append((i, " ".join([*template, *(f"own{i}x{k}" for k in range(44))])))
    pair = [*template, *(f"pair{k}" for k in range(44))]
    rows += [(3000, " ".join(pair)), (3001, " ".join([*pair[:180], *(f"edit{k}" for k in range(18))]))]
    sets = [grams(t) for _, t in rows[-4:]]
    likeness = lambda a, b: len(a & b) / len(a | b)
    assert likeness(sets[0], sets[1]) < 0.66 and 0.8 <= likeness(sets[2], sets[3]) < 0.86
    got = sorted(r.doc_id for r in similar.one_of_similar(documents(spark, rows)).collect())
    assert got == list(range(3001))


def test_tiles_compare_every_pair(spark, monkeypatch):
    """Chains whose links lie between tiles: pairwise counts, light and heavy, equal plain set intersections."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60 if i % 2 else 5000, rng.integers(1, 200))) for i in range(70)]
    for few in (0, 8, 1 << 30):
        monkeypatch.setattr(similar, "FEW", few)
        got = similar.common_counts(sets[:40], sets[30:])
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[30:]] for a in sets[:40]]


def test_rows_that_share_an_id_are_not_lost(spark):
    rng = random.Random(23)
    one, two = prose(rng, 80), prose(rng, 80)
    got = similar.one_of_similar(documents(spark, [(1, one), (1, two), (2, two), (1, one)])).collect()
    assert sorted(r.text for r in got) == sorted([one, two])
    assert similar.one_of_similar(documents(spark, [])).count() == 0
