"""Operators on documents against brute force, on small tables with every odd case."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from helpers import CLASHING, LONG, documents, odd

from evidentia.llm import chunks, decontaminate, licences, pieces, quality, simhash, suffixes

WORDS = [f"w{i}" for i in range(4000)]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Suffix arrays -----------------------------------------------------------------------------------------------------

def repeat_corpus():
    rng = random.Random(1)
    passages = [prose(rng, n) for n in (50, 51, 64, 65, 90, 300)]
    rows = [(i, f"{prose(rng, rng.randint(0, 80))} {rng.choice(passages)}\n{prose(rng, rng.randint(0, 80))}") for i in range(60)]
    rows += [(100, prose(rng, 49)), (101, prose(rng, 200)), (102, f"{passages[2]} {prose(rng, 30)} {passages[2]}")]
    return rows


def repeated_words(rows):
    texts = {(i, t): split(t) for i, t in rows}
    seen = Counter(tuple(w[i:i + 50]) for w in texts.values() for i in range(len(w) - 49))
    marked = {}
    for key, w in texts.items():
        hit = np.zeros(len(w), bool)
        for i in range(len(w) - 49):
            if seen[tuple(w[i:i + 50])] > 1:
                hit[i:i + 50] = True
        marked[key] = hit
    return marked


def test_suffix_spans_equal_brute_force(spark):
    rows = odd(repeat_corpus())
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffixes.repeated_spans(documents(spark, rows, CLASHING)).collect()}
    want = set()
    for (i, _), hit in repeated_words(rows).items():
        edges = np.nonzero(np.diff(np.concatenate([[0], hit.astype(int), [0]])))[0]
        want |= {(i, int(a), int(b)) for a, b in edges.reshape(-1, 2)}
    assert got == want and want


def test_cut_leaves_one_copy_of_every_window(spark):
    rows = repeat_corpus()
    docs = documents(spark, odd(rows), CLASHING)
    out = suffixes.cut_repeats(docs)
    assert out.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in out.collect()]
    assert len(texts) == docs.count()
    unique = {(i, t) for i, t in texts}
    assert not any(hit.any() for hit in repeated_words(unique).values())
    def windows(pairs):
        return {tuple(w[i:i + 50]) for _, t in pairs for w in [split(t)] for i in range(len(w) - 49)}
    # Each passage that repeats still stands somewhere, in full: windows of the first copies are all there.
    firsts = {}
    for i, t in sorted(rows):
        w = split(t)
        for k in range(len(w) - 49):
            firsts.setdefault(tuple(w[k:k + 50]), i)
    left = windows(unique)
    whole = Counter(tuple(w[k:k + 50]) for _, t in rows for w in [split(t)] for k in range(len(w) - 49))
    assert all(k in left for k, n in whole.items() if n > 1)


@pytest.mark.parametrize("hot", [1 << 16, 5])
def test_repeats_around_a_hot_line_equal_brute_force(spark, monkeypatch, hot):
    """Two documents share words before a line of 35 to 49 words that stands alone in many others."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(41)
    rows = []
    for n, (extra, size) in enumerate([(6, 49), (10, 45), (15, 40), (6, 49), (10, 45), (8, 49)]):
        line, before = prose(rng, size), prose(rng, extra)
        rows += [(1000 * n + i, f"{prose(rng, 20)} {before} {line} {prose(rng, 20)}") for i in range(2)]
        rows += [(1000 * n + 10 + i, f"{prose(rng, 20)} {line} {prose(rng, 20)}") for i in range(60)]
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffixes.repeated_spans(documents(spark, rows)).collect()}
    want = set()
    for (i, _), hit in repeated_words(rows).items():
        edges = np.nonzero(np.diff(np.concatenate([[0], hit.astype(int), [0]])))[0]
        want |= {(i, int(a), int(b)) for a, b in edges.reshape(-1, 2)}
    assert got == want and len(want) >= 12


@pytest.mark.parametrize("hot", [1 << 16, 5])
def test_cut_text_equals_brute_force_word_by_word(spark, monkeypatch, hot):
    """Later copies lose all their words, also the edges that copies with three or more contexts share."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(42)
    passages = [prose(rng, n) for n in (50, 62, 70, 100)]
    rows = [(i, f"{prose(rng, 15)} {rng.choice(passages)} {prose(rng, 15)}") for i in range(80)]
    seen, want = set(), {}
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if tuple(w[k:k + 50]) in seen:
                gone[k:k + 50] = [True] * 50
            seen.add(tuple(w[k:k + 50]))
        want[i] = [x for x, g in zip(w, gone, strict=True) if not g]
    assert {r.doc_id: r.text.split() for r in suffixes.cut_repeats(documents(spark, rows)).collect()} == want


def test_suffixes_of_one_long_text_and_of_none(spark):
    assert suffixes.repeated_spans(documents(spark, [(1, LONG)])).collect()[0].n_words == 40_000
    assert suffixes.repeated_spans(documents(spark, [])).count() == 0
    assert suffixes.cut_repeats(documents(spark, [])).count() == 0


def test_texts_that_share_an_id_are_two_documents(spark):
    """The same window at the same place of two texts with one ID, or with none, is a repeat; a repeated row is not."""
    passage, other = prose(random.Random(6), 55), prose(random.Random(7), 60)
    rows = [(1, f"{passage} one"), (1, f"{passage} two"), (None, f"{other} one"), (None, f"{other} two"), (2, "x " + prose(random.Random(8), 70))]
    docs = documents(spark, [*rows, rows[4]])
    assert sorted(map(str, suffixes.repeated_spans(docs).collect())) == sorted(
        f"Row(doc_id={i}, start_word=0, end_word={n}, n_words={n})" for i, n in [(1, 55), (1, 55), (None, 60), (None, 60)])
    left = [r.text for r in suffixes.cut_repeats(docs).collect()]
    assert sum(passage in t for t in left) == sum(other in t for t in left) == 1 and left.count(rows[4][1]) == 2


def test_neighbours_across_tasks(spark):
    """Many copies over many tasks: the rows beside each cut of the sort are compared too."""
    passage = prose(random.Random(5), 60)
    rows = [(i, f"a{i} b{i} {passage} c{i} d{i}") for i in range(400)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = suffixes.repeated_spans(documents(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} == {(i, 2, 62) for i in range(400)}


# Chunks ------------------------------------------------------------------------------------------------------------

def test_gear_equals_rolling():
    data = np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = 2 * h + int(chunks._GEAR[b])
        want.append(h & 0xFFFF)
    assert ((chunks.gear(data) & 0xFFFF) == want).all()


def test_chunks_cover_and_move_with_the_text():
    rng = random.Random(2)
    text = prose(rng, 3000).encode()
    def cut(t):
        ends = chunks.chunk_ends(np.frombuffer(t, np.uint8))
        assert ends[-1] == len(t) and (np.diff(ends) > 0).all() and np.diff(ends, prepend=0).max() <= chunks.MOST
        return {t[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)}
    assert len(cut(text) & cut(b"inserted " + text)) > 0.97 * len(cut(text))
    small, chunks.PIECE = chunks.PIECE, 1000
    try:
        parts = cut(text)
    finally:
        chunks.PIECE = small
    assert parts == cut(text)


def test_chunk_runs_equal_brute_force(spark):
    rng = random.Random(3)
    passage = prose(rng, 70)
    rows = odd([(i, f"{prose(rng, 40)} {passage} {prose(rng, 40)}") for i in range(1, 9)] + [(20, prose(rng, 200)), (21, "a stock phrase of few words"), (22, "a stock phrase of few words")])
    got = {(r.doc_id, r.start_byte, r.end_byte, r.n_cut, r.first_id) for r in chunks.repeated_runs(documents(spark, rows, CLASHING)).collect()}
    places = defaultdict(list)
    for i, t in rows:
        raw = (t or "").encode()
        ends = chunks.chunk_ends(np.frombuffer(raw, np.uint8)).tolist()
        for a, b in zip([0, *ends[:-1]], ends, strict=False):
            places[raw[a:b]].append((i if i is not None else -1, a, b))
    spans = defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for i, a, b in found:
                spans[i].add((a, b, (i, a) == min(found)[:2], min(found)[0]))
    want = set()
    for i, found in spans.items():
        run = []
        for s in [*sorted(found), None]:
            if run and (s is None or s[0] > run[-1][1]):
                text = next(t for k, t in rows if (k if k is not None else -1) == i and t)
                raw = text.encode()[run[0][0]:run[-1][1]]
                begun = len(raw.split()) - (run[0][0] > 0 and not text.encode()[run[0][0] - 1:run[0][0]].isspace() and not raw[:1].isspace())
                if begun >= chunks.MIN_RUN or len(raw) >= chunks.MIN_BYTES or len(raw) == len(text.encode()):
                    want.add((i, run[0][0], run[-1][1], sum(b - a for a, b, first, _ in run if not first), min(x[3] for x in run)))
                run = []
            if s:
                run.append(s)
    # The same six words as whole documents are copies; as part of a longer text they would be a stock phrase.
    assert got == want and {g[0] for g in got} == {*range(1, 9), 21, 22}


def test_whole_copies_and_unspaced_passages_are_found(spark):
    unspaced = "".join(random.Random(4).choices("的一是在不了有和人这中大为上个国我以要他", k=120))
    rows = [(1, "kurz"), (2, "kurz"), (3, "a b"), (4, "a b c"), (5, f"{unspaced}甲"), (6, f"乙{unspaced}"), (7, "x")]
    got = {(r.doc_id, r.end_byte - r.start_byte) for r in chunks.repeated_runs(documents(spark, rows)).collect()}
    assert {(1, 4), (2, 4)} <= got and {i for i, n in got if n >= chunks.MIN_BYTES} == {5, 6} and not {i for i, _ in got} & {3, 4, 7}


def test_chunks_of_long_and_empty(spark):
    found = chunks.repeated_runs(documents(spark, [(1, LONG), (2, LONG)])).collect()
    assert {(r.doc_id, r.start_byte, r.end_byte) for r in found} == {(1, 0, len(LONG)), (2, 0, len(LONG))}
    assert chunks.repeated_runs(documents(spark, [])).count() == 0


# SimHash -----------------------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    words = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=2):
    root = list(range(len(fps)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark):
    rng = random.Random(4)
    base = [prose(rng, 300).split() for _ in range(6)]
    rows = []
    for n in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((n, " ".join(words)))
    rows = odd(rows + [(500, "One Two"), (501, "one two"), (502, "É x")])
    docs = documents(spark, rows, CLASHING)
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    groups = plain_components(fps)
    ids = defaultdict(list)
    for (i, _), g in zip(rows, groups, strict=True):
        ids[g].append(i)
    name = {g: min((i for i in found if i is not None), default=None) for g, found in ids.items()}
    assert got == Counter((i, f, name[g]) for (i, _), f, g in zip(rows, fps, groups, strict=True))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(name.values()) - {None})


@pytest.mark.parametrize("tile", [4, 10_000])
def test_tiles_find_every_link(spark, tile):
    """Chains of single bits, clusters and lone fingerprints, cut into tiles of different sizes."""
    rng = np.random.default_rng(6)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        f = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(12):
            fps.add(f)
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                f ^= 1 << int(bit)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    roots = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in simhash.connected(simhash.links(df, tile=tile)).collect()}
    groups = plain_components(fps)
    want = defaultdict(set)
    for f, g in zip(fps, groups, strict=True):
        want[g].add(f)
    got = defaultdict(set)
    for f in fps:
        got[roots.get(f, f)].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_of_long_and_empty(spark):
    assert simhash.fingerprint(LONG.encode(), block=1000) == plain_fingerprint("word word word")
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.one_of_each(documents(spark, [])).count() == 0


# Decontamination ---------------------------------------------------------------------------------------------------

def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.34:
            words[k] = rng.choice(WORDS)
        elif kind < 0.67:
            del words[k]
        else:
            words.insert(k, rng.choice(WORDS))
    return words


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, rng.randint(6, 60))) for i in range(40)] + [(90, None), (91, ""), (0, "one two three four")]
    planted, rows = set(), []
    for n in range(200):
        i, text = rng.choice(items[:40])
        words = edited(rng, text.split(), rng.randint(0, decontaminate.edits_allowed(len(text.split()))))
        rows.append((n, f"{prose(rng, 60)}. {' '.join(words).upper()}, {prose(rng, 60)}"))
        planted.add((n, i))
    clean = [(1000 + n, prose(rng, 150)) for n in range(100)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    docs = documents(spark, odd(rows + clean), CLASHING)
    got = decontaminate.contaminated(docs, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert len(pairs & planted) >= 0.99 * len(planted) and not {d for d, _ in pairs if d is not None and d >= 1000}
    assert all(r.similarity >= 0.8 and r.distance <= r.item_words * 0.2 + 1e-9 for r in got)
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(i for i, _ in odd(rows + clean) if i not in {d for d, _ in pairs})


def test_recall_against_exhaustive_search(spark):
    """Truth: the edit distance of every item to every place of every document, by dynamic programming."""
    rng = random.Random(71)
    items = [(i, prose(rng, rng.choice([3, 5, 8, 12, 20, 40, 80]))) for i in range(30)]
    rows = []
    for n in range(150):
        text = rng.choice(items)[1].split()
        most = decontaminate.edits_allowed(len(text))
        words = edited(rng, text, rng.randint(0, most + 1))
        rows.append((n, f"{prose(rng, rng.randint(0, 50))} {' '.join(words)} {prose(rng, rng.randint(0, 50))}"))
    hashes, truth = decontaminate.WordHashes(), {}
    for n, text in rows:
        words = hashes.of(decontaminate.words_of(text))
        for i, item in items:
            wanted = hashes.of(decontaminate.words_of(item))
            distance = int(decontaminate.distances(wanted, words[None, :])[0][0])
            if distance <= decontaminate.edits_allowed(len(wanted)):
                truth[n, i] = distance
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(documents(spark, rows), spark.createDataFrame(items, "item_id int, text string")).collect()}
    assert got.keys() <= truth.keys() and len(got) >= 0.98 * len(truth) > 100
    assert all(got[pair] >= truth[pair] for pair in got)


def test_distances_equal_plain_dynamic_programming():
    rng = np.random.default_rng(8)
    for _ in range(30):
        item, text = rng.integers(1, 6, rng.integers(1, 12)).astype(np.uint64), rng.integers(1, 6, (3, 20)).astype(np.uint64)
        got, end = decontaminate.distances(item, text)
        for row in range(3):
            table = [[0] * 21] + [[i] + [0] * 20 for i in range(1, len(item) + 1)]
            for i in range(1, len(item) + 1):
                for j in range(1, 21):
                    table[i][j] = min(table[i - 1][j - 1] + int(item[i - 1] != text[row, j - 1]), table[i - 1][j] + 1, table[i][j - 1] + 1)
            assert got[row] == min(table[-1]) and table[-1][end[row]] == got[row]


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, prose(rng, 20)) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    docs = documents(spark, [(i, f"x {t} y") for i, t in items] + [(50, LONG)])
    want = {(i, i) for i, _ in items}
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 200)
    monkeypatch.setattr(decontaminate, "SLICE_WORDS", 64)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want
    assert decontaminate.drop_contaminated(docs, bench).collect()[0].doc_id == 50
    assert decontaminate.contaminated(documents(spark, []), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 13


# SentencePiece -----------------------------------------------------------------------------------------------------

def test_pieces_equal_the_library(spark):
    import hashlib

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_path())
    rng = random.Random(10)
    texts = ["", " ", "  a", "▁", "a▁b", "\n\t x ", "😀�\x00z", "a" * 900, "的是不我" * 30, "<s></s><unk><0x0A>", "é ﬁ é", "aetinoshr" * 3000]
    texts += ["".join(rng.choice(["a", "b", "e", " ", "th", "▁", " \n", "ß", "é", "ñ", "的", "😀", "the", "ing", "er", " in", "on"]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    rows = odd(list(enumerate(texts)) + [(700, LONG)])
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in pieces.encode_documents(documents(spark, rows, CLASHING)).collect())
    want = Counter()
    for i, t in rows:
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        sums = [hashlib.sha256(b).hexdigest() for b in (np.array(ids, "<u4").tobytes(), model.decode(ids).encode())]
        want[i, len(ids), *sums, tuple(ids)] += 1
    assert got == want
    assert pieces.encode_documents(documents(spark, [])).count() == 0


def test_pieces_beyond_one_scan(monkeypatch):
    monkeypatch.setattr(pieces, "SCAN", 50)
    monkeypatch.setattr(pieces, "MEMORY", 10)
    coder = pieces.Encoder(pieces.vocabulary_path())
    text = "".join(random.Random(11).choice("aetinoshr") for _ in range(2000))
    assert coder.backtrack(text) == coder.merge(text)


# Quality -----------------------------------------------------------------------------------------------------------

def plain_counts(text):
    words = split(text)
    lines = [x for x in (text or "").split("\n") if split(x)]
    seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i:i + 8])] > 1:
            hit |= set(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed


def quality_corpus():
    rng = random.Random(12)
    good = [(i, " ".join(rng.choices(WORDS[:500], k=rng.randint(20, 200)))) for i in range(150)]
    junk = [(1000 + i, " ".join(f"{w.upper()}!!" for w in rng.choices(WORDS[:500], k=rng.randint(40, 200)))) for i in range(40)]
    line = "the same line again and again today"
    other = [(2000, f"{prose(rng, 60)}\n{line}\n \n{line}\n{line}\r\n{prose(rng, 20)}"), (2001, "é # * $ % & | < > \x0b\x0c " + prose(rng, 20)), (2003, "a b " * 12), (2004, prose(rng, 19))]
    return good, junk, other


def test_quality_counts_equal_brute_force(spark):
    good, junk, other = quality_corpus()
    rows = odd(good + junk + other)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows, CLASHING)
    judged, name = quality.judge_documents(docs, labels)
    assert judged.columns == [*docs.columns, name]
    got = judged.select("doc_id", f"{name}.*").collect()
    counts = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert counts == Counter((i, *plain_counts(t)) for i, t in rows)
    verdict = {r.doc_id: r.kept for r in got if r.doc_id is not None}
    assert all(verdict[i] for i, _ in good) and not any(verdict[i] for i, _ in junk) and not verdict[9001]
    assert {r.score for r in got if r.n_words == 0} == {0.0}


def test_quality_holds_where_pairs_outnumber_small_tables(spark):
    """Many distinct pairs: junk must not share the buckets of frequent good n-grams."""
    rng = random.Random(31)
    good = [(i, prose(rng, 150)) for i in range(2000)]
    junk = [(9100 + i, " ".join(f"{w}&&&" for w in rng.choices(WORDS[:3000], k=100))) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.keep_good(documents(spark, good + junk), labels).collect()}
    assert len(kept & {i for i, _ in good}) >= 1990 and not kept & {i for i, _ in junk}


def test_quality_without_labels_or_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    judged, name = quality.judge_documents(documents(spark, quality_corpus()[0][:9]), labels)
    assert {(r.score, r.kept) for r in judged.select(f"{name}.*").collect()} == {(0.0, True)}
    assert quality.judge_documents(documents(spark, []), labels)[0].count() == 0
    judged, name = quality.judge_documents(documents(spark, [(1, LONG)]), labels)
    assert judged.select(f"{name}.n_repeat_words").first()[0] == 40_000


def test_quality_runs_no_python(spark):
    good, junk, _ = quality_corpus()
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    judged, name = quality.judge_documents(documents(spark, good), labels)
    assert not re.search("Python|Pandas|Arrow", judged._jdf.queryExecution().executedPlan().toString())


# Licences ----------------------------------------------------------------------------------------------------------

def test_licences_equal_brute_force(spark):
    rng = random.Random(13)
    lines = ["Released under the MIT License.", "under the mit. License", "Apache License, Version 2.0", "CC BY-NC 4.0", "cc by nc cc by nc", "MIT license", "All rights reserved.", "under the KMIT license",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "the GNU General Public License, version 3"]
    rows = odd([(i, f"{prose(rng, rng.randint(0, 30))}\n{' '.join(rng.choices(lines, k=rng.randint(0, 3)))}\n{prose(rng, 5)}") for i in range(120)] + [(300, "Under The MIT License"), (301, LONG + " cc-by-nc")])
    scanned, name = licences.scan_licences(documents(spark, rows, CLASHING))
    got = Counter((r.doc_id, *[r[name][k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels")]) for r in scanned.collect())
    want = Counter()
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        found = [(k, x.label) for x in licences.BASE for k in range(len(words)) if words[k:k + len(x.words)] == x.words]
        starts = [k for k, _ in found]
        want[i, len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))] += 1
    assert got == want
    for r in scanned.collect():
        assert set(filter(None, r[name].base_labels.split(","))) <= set(filter(None, r[name].labels.split(","))) and 0 <= r[name].score <= 1


def test_licence_notices_and_plan(spark):
    notice = next(t for t in licences.NOTICES if t.label == "bsd")
    rows = [(1, f"x y {notice.text} z"), (2, notice.text.replace("source and binary", "source or binary")), (3, "all rights reserved")]
    scanned, name = licences.scan_licences(documents(spark, rows))
    assert {r.doc_id: r[name].labels for r in scanned.collect()} == {1: "bsd", 2: "", 3: "all-rights-reserved"}
    assert not re.search("Python|Pandas|Arrow", scanned._jdf.queryExecution().executedPlan().toString())
    assert licences.scan_licences(documents(spark, []))[0].count() == 0
