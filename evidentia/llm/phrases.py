"""Phrase collocations from sorted count streams.

Every word starts one window: itself and what follows it in its piece, ``LONGEST`` words at most. Windows are counted per
slice of text before they move, one row for each, not one for each shorter phrase: laid in prefix order (a range of the
words a task), all windows that begin with a phrase follow each other, so one pass over neighbours sums up the counts of
phrases of all lengths. What is cut by the edge of a batch is handed on as a part, and parts are added up; of what lies
inside, only phrases frequent enough leave the task.

The frequent phrases are then kept in two orders. In prefix order a phrase stands behind its own beginnings, so the last
count seen of each length is the left part's, and the next row tells whether a word behind always follows. In suffix order
(words read backwards) the same holds for endings and for a word before. The two streams are merged in step on the phrase;
nothing is looked up in a hash table. A phrase within a longer one of the same count lies within one that is longer by
one word and as frequent, so one word on either side is enough.

Skew: ranges are cut between windows, not between words, so a frequent word, pair or line is spread over tasks; a phrase
that is everywhere has one part for each batch it fills. The best phrases are ranked within salted parts first.

Defined results: a NULL text is empty, a NULL language is ``und``; rows that repeat count again; scores are exact integers;
ties go to the higher count, then to the phrase that is first in UTF-8 bytes; an empty table has no phrase.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions.ship import ship
from evidentia.llm.common import LOWER, UPPER, map_batches, stage, table

LONGEST, LEAST, BEST = 5, 100, 2000
NO_LANGUAGE = "und"
#: Words of one language that are counted together before they move.
SLICE = 1 << 20
SALTS = 64
#: Documents, about, whose windows show how to cut the ranges, and windows for each range.
SAMPLE, PER_PART, DRAWN_BY, SEED = 2_000, 50, 4, 12
#: Rows that a task hands on at a time.
HANDED_ON = 1 << 15

#: Signs that end a piece become a byte that UTF-8 never holds.
_END = b"\xff"
_SIGNS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(UPPER.encode() + _SIGNS, LOWER.encode() + _END * len(_SIGNS))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Slice:
    """The words of some texts of one language as numbers in the order they were first seen; 0 parts pieces."""

    def __init__(self):
        self.numbers, self.texts, self.size = _Numbers({_END: 0}), [], 0

    def add(self, text: bytes) -> None:
        tokens = text.translate(_FOLD).replace(_END, b" \xff ").split()
        tokens.append(_END)
        self.texts.append(np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens)))
        self.size += len(tokens)

    def windows(self, longest: int) -> tuple[pa.Array, np.ndarray]:
        """The distinct windows, in byte order, each word with a space behind it, and their counts."""
        words = pa.array([b"", *[w + b" " for w in list(self.numbers)[1:]]], pa.binary())
        by_bytes = pc.sort_indices(words).to_numpy()  # the empty word, number 0, comes first
        rank = np.empty(len(words), np.int32)
        rank[by_bytes] = np.arange(len(words), dtype=np.int32)
        ranked = np.concatenate([*[rank[t] for t in self.texts], np.zeros(longest, np.int32)])
        begins = np.nonzero(ranked > 0)[0]
        columns = [ranked[begins]]
        for i in range(1, longest):
            columns.append(np.where(columns[-1] > 0, ranked[begins + i], np.int32(0)))
        order, firsts = _sorted_rows(columns, len(words))
        laid = words.take(pa.array(by_bytes))
        phrase = pc.binary_join_element_wise(*[laid.take(pa.array(c[order[firsts]])) for c in columns], b"")
        return phrase, np.diff(np.concatenate([firsts, [len(order)]]))


def _sorted_rows(columns: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts rows by these columns of numbers up to ``most``, and the places where rows change in it."""
    bits = max(1, int(most).bit_length())
    per = max(1, 62 // bits)
    keys = [reduce(lambda key, column: (key << bits) | column, columns[i + 1:i + per], columns[i].astype(np.int64)) for i in range(0, len(columns), per)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        laid = key[order]
        new[1:] |= laid[1:] != laid[:-1]
    return order, np.nonzero(new)[0]


def window_stream(docs: DataFrame, longest: int = LONGEST, pivots: list[tuple[str, str]] | None = None) -> DataFrame:
    """``lang``, ``window`` (words, each with a space behind it) and ``n``, counted per slice, and the ``part`` between the
    ``pivots`` (in byte order) that a window lies in."""
    ship(docs.sparkSession)
    bounds = sorted((lang.encode(), window.encode()) for lang, window in pivots or [])

    def counted(lang: str, part: Slice) -> Iterator[pa.RecordBatch]:
        found, n = part.windows(longest)
        key = lang.encode()
        before = sum(b[0] < key for b in bounds)
        cuts = [bisect_left(found, b[1], key=lambda w: w.as_py()) for b in bounds if b[0] == key]
        parts = (before + np.searchsorted(cuts, np.arange(len(n)), "right")).astype(np.int32)
        for start in range(0, len(n), HANDED_ON):
            rows = slice(start, start + HANDED_ON)
            some = found[rows].cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(some)), some, pa.array(n[rows]), pa.array(parts[rows])], ["lang", "window", "n", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, Slice] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if text.is_valid:
                    part = slices.setdefault(lang, Slice())
                    part.add(text.as_py())
                    if part.size > SLICE:
                        yield from counted(lang, slices.pop(lang))
        for lang, part in slices.items():
            yield from counted(lang, part)

    return docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text").mapInArrow(run, "lang string, window string, n long, part int")


def pivots_of(docs: DataFrame, longest: int, parts: int) -> list[tuple[str, str]]:
    """Windows that cut all windows into about equal parts, from those of ``SAMPLE`` documents or so.

    They place rows and decide no result; ``PER_PART`` windows a part reach the driver from each of ``DRAWN_BY`` tasks.
    """
    share = min(1.0, SAMPLE / max(1, docs.count()))
    drawn_from = docs.select("lang", "text").sample(share, SEED).repartition(DRAWN_BY)
    seen = window_stream(drawn_from, longest).select("lang", "window")
    drawn = sorted((r.lang.encode(), r.window.encode()) for r in seen.orderBy(F.xxhash64("lang", "window")).limit(PER_PART * parts).collect())
    return [(lang.decode(), window.decode()) for lang, window in dict.fromkeys(drawn[len(drawn) * i // parts] for i in range(1, parts) if drawn)]


def _word_numbers(windows: pa.Array, longest: int) -> np.ndarray:
    """A number for each word of each window, from 1; 0 where a window is shorter."""
    parts = pc.split_pattern(windows, " ")
    ends = parts.offsets.to_numpy().astype(np.int64)
    codes = parts.values.dictionary_encode().indices.to_numpy()[ends[0]:ends[-1]] + 1
    sizes = np.diff(ends)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(codes)) - np.repeat(ends[:-1] - ends[0], sizes)
    real = place < np.repeat(sizes - 1, sizes)  # the last part is the empty one behind the last space
    out = np.zeros((len(sizes), longest), np.int64)
    out[row[real], place[real]] = codes[real]
    return out


def rolled_up(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """``lang``, ``depth``, ``phrase`` and ``n`` of phrases found at ``least`` times or more; depth 0 is the language itself.

    The windows of ``docs`` are laid in prefix order, a range of them a task. A group of neighbours that begin alike is whole unless it touches an edge of its
    batch, and only such parts go on below the least count.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = window_stream(docs, longest, pivots_of(docs, longest, parts))
    laid = stream.repartitionById(parts, F.col("part")).drop("part").sortWithinPartitions("lang", "window")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, windows, n = batch.column(0), batch.column(1), batch.column(2).to_numpy()
        numbers = _word_numbers(windows, longest)
        new = np.ones(len(n), bool)
        new[1:] = np.diff(langs.dictionary_encode().indices.to_numpy()) != 0
        rows, depths, sums = [], [], []
        for depth in range(longest + 1):
            if depth:
                new[1:] |= numbers[1:, depth - 1] != numbers[:-1, depth - 1]
            starts = np.nonzero(new)[0]
            total = np.add.reduceat(n, starts)
            kept = (total >= least) | (depth == 0)
            kept[[0, -1]] = True
            if depth:
                kept &= numbers[starts, depth - 1] > 0
            rows.append(starts[kept])
            depths.append(np.full(len(rows[-1]), depth, np.int32))
            sums.append(total[kept])
        at, depth = pa.array(np.concatenate(rows)), np.concatenate(depths)
        phrases = [" ".join(w.split(" ")[:d]) for w, d in zip(windows.take(at).to_pylist(), depth.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([langs.take(at), pa.array(depth), pa.array(phrases, pa.string()), pa.array(np.concatenate(sums))], ["lang", "depth", "phrase", "n"])

    sums = map_batches(laid, work, "lang string, depth int, phrase string, n long")
    return sums.groupBy("lang", "depth", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("depth") == 0))


def _trie_order(phrases: DataFrame, words: Column, longest: int, part: str, beyond: str) -> DataFrame:
    """Counts of the parts that begin each phrase when it is read as ``words``, and whether one more word always follows.

    Sorted by words, shorter before longer, a phrase follows its own beginnings, all of which are frequent and so in the
    stream; the words that follow it share its count among them, so one that has all of it stands right behind it.
    """
    keys = [f"__w{i}" for i in range(longest)]
    laid = phrases.select("lang", "depth", "phrase", "n", *[F.get(words, i).alias(k) for i, k in enumerate(keys)])
    order = Window.partitionBy("lang", *keys[:2]).orderBy(*keys[2:], "depth")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    next_one = (F.lead("n").over(order) == F.col("n")) & (F.lead("depth").over(order) == F.col("depth") + 1)
    return laid.select(
        "lang", "phrase", "depth", "n", *[F.last(F.when(F.col("depth") == d, F.col("n")), ignorenulls=True).over(before).alias(f"{part}{d}") for d in range(2, longest)],
        F.coalesce(next_one, F.lit(False)).alias(beyond))


_EXACT = "decimal(16,0)"  # counts up to 10 ** 16; products of two and a thousand fit 38 digits


def scored(frequent: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``lang``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of the phrases that no longer one stands for."""
    words = F.split("phrase", " ")
    phrases, single, totals = frequent.where("depth > 1"), frequent.where("depth = 1"), frequent.where("depth = 0")
    left = _trie_order(phrases, words, longest, "l", "followed").where(~F.col("followed"))
    right = _trie_order(phrases, F.reverse(words), longest, "r", "preceded").where(~F.col("preceded"))
    both = left.join(right.drop("depth", "n").hint("merge"), ["lang", "phrase"])
    ends = both.withColumns({"__first": F.substring_index("phrase", " ", 1), "__last": F.substring_index("phrase", " ", -1)})
    for side, name in (("l1", "__first"), ("r1", "__last")):
        ends = ends.join(single.select("lang", F.col("phrase").alias(name), F.col("n").alias(side)), ["lang", name])
    whole = ends.join(totals.select("lang", F.col("n").alias("total")), "lang")

    def cut(k: int, d: int) -> Column:
        score = f"(cast(1000 as decimal(4,0)) * cast(n as {_EXACT}) * cast(total as {_EXACT})) div (cast(l{k} as {_EXACT}) * cast(r{d - k} as {_EXACT}))"
        return F.struct(F.expr(score).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{d - k}").alias("r"))

    cuts = F.coalesce(*[F.when(F.col("depth") == d, F.array(*[cut(k, d) for k in range(1, d)])) for d in range(2, longest + 1)])
    weakest = whole.select("lang", "phrase", F.col("n").alias("a"), F.col("total").alias("n"), F.array_min(cuts).alias("cut"))
    return weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, best: int = BEST) -> DataFrame:
    """The ``best`` phrases of each language by the score of their weakest cut, with ``rank``."""
    phrases = scored(stage(rolled_up(docs, longest, least), "phrases"), longest)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = phrases.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).where(F.col("rank") <= best)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH pieces AS (
    SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
totals AS (SELECT lang, count(*) AS n FROM starts GROUP BY lang),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM starts, (SELECT unnest(range(1, {LONGEST} + 1)) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
kept AS (
    SELECT * FROM f p WHERE m > 1 AND NOT EXISTS (
        SELECT 1 FROM f q WHERE q.lang = p.lang AND q.m > p.m AND q.a >= p.a AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' '))),
cuts AS (
    SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
    FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM kept)),
valued AS (
    SELECT c.lang, c.phrase, c.a, k, h.a AS l, t.a AS r, n, (1000::HUGEINT * c.a * n) // (h.a::HUGEINT * t.a) AS score
    FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail JOIN totals n ON n.lang = c.lang),
weakest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM weakest QUALIFY rank <= {BEST}
"""
