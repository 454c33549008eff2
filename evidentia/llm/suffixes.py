"""Suffix dedup on sparse suffix arrays: all passages of ``MIN_WORDS`` words that occur at two places.

Suffixes are kept at minimiser positions only: a window of ``MIN_WORDS`` words is anchored at the place among its first
``RUNS`` whose short run of words has the smallest hash, which depends on the window's words alone, so copies of a window
have the same anchor, with ``CORE`` words behind it. Suffixes whose core occurs once cannot be part of a repeat and go
no further. The others are sorted by core, then by the words behind it, then by the words before it, nearest first;
neighbours are compared, and a match is extended to the right and to the left, up to ``SIDE`` words each, as far as the
words agree. Extended matches of ``MIN_WORDS`` words or more are repeats, and overlapping ones join to longer ones.

Where two different surroundings meet at a core, neighbours tell all. Where more do, as at a line that many documents
share, a suffix may agree best with one that is no neighbour, so each window around the core is looked up among the
surroundings that met. So every repeat of ``MIN_WORDS`` words or more is found in full. What is compared are words and
128-bit digests of cores; 64-bit hashes only choose which suffixes are looked at.

Skew: cores are counted per task before they move; suffixes of a core that occurs over ``HOT`` times are not gathered,
their windows are counted by 128-bit digest instead, per task first, and joined back in salted parts.

Defined results: texts that are NULL, empty or shorter than ``MIN_WORDS`` words have no repeat; rows that share a
``doc_id`` and a text are one document, rows that share only one of them are two; a passage that occurs twice in one text
is a repeat; a NULL ``doc_id`` is an ID, before all others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.functions.ship import ship
from evidentia.llm.common import WordHashes, fresh, map_batches, stage, table, windows_hashed

MIN_WORDS = 50
RUNS, RUN_WORDS = 16, 5
CORE, SIDE = MIN_WORDS - RUNS + 1, RUNS - 1
#: Suffixes of one core that a task holds at a time.
HOT = 1 << 16
SALTS = 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def anchors(hashes: np.ndarray) -> np.ndarray:
    """The minimiser position of each window of ``MIN_WORDS`` words."""
    if len(hashes) < MIN_WORDS:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(windows_hashed(hashes, RUN_WORDS), RUNS)[:len(hashes) - MIN_WORDS + 1]
    return view.argmin(axis=1) + np.arange(len(view))


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def suffix_cores(docs: DataFrame) -> DataFrame:
    """``core`` (a hash of the first words), ``doc_id`` and ``text_id`` of every suffix at an anchor."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        hashes, rows, cores = WordHashes(), [], []
        for row, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
            words = hashes.of((text or b"").split())
            kept = np.unique(anchors(words))
            if len(kept):
                rows.append(np.full(len(kept), row))
                cores.append(windows_hashed(words, CORE)[kept])
        if not rows:
            return None
        at = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(cores).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], ["core", "doc_id", "text_id"])

    return map_batches(docs.select("doc_id", F.xxhash64("text"), "text"), work, f"core long, doc_id {_kind(docs)}, text_id long")


def suffixes(docs: DataFrame) -> DataFrame:
    """The suffixes whose core repeats: ``core`` (a digest), ``after`` and ``before`` (the words on either side, nearest
    first), ``hot``, ``doc_id``, ``text_id`` and ``place`` (the word it begins with)."""
    cores = stage(suffix_cores(docs), "cores")
    counted = cores.groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
    # A table, so that the join below has shuffled rows on both sides and Spark may split a frequent core.
    repeated = stage(counted.select("core", (F.col("n") > HOT).alias("hot")), "repeated")
    held = cores.join(repeated, "core").groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("core", "hot")).alias("cores"))
    held = held.select(F.col("doc_id").alias("__id"), F.col("text_id").alias("__text"), "cores")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    joined = texts.join(held, (texts["text_id"] == held["__text"]) & texts["doc_id"].eqNullSafe(held["__id"])).select("doc_id", "text_id", "text", "cores")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        hashes, rows, places, hots, digests, after, before = WordHashes(), [], [], [], [], [], []
        known = batch.column(3)
        for row, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
            words = (text or b"").split()
            numbers = hashes.of(words)
            at = np.unique(anchors(numbers))
            if not len(at):
                continue
            core = windows_hashed(numbers, CORE).view(np.int64)[at]
            asked, hot = (known[row].values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            order = np.argsort(asked)
            slot = np.minimum(np.searchsorted(asked[order], core), len(asked) - 1)
            found = asked[order][slot] == core
            hots.append(hot[order][slot][found])
            places.append(at[found])
            rows.append(np.full(len(places[-1]), row))
            for p in places[-1].tolist():
                digests.append(xxhash.xxh3_128_digest(b" ".join(words[p:p + CORE])))
                after.append(b" ".join(words[p + CORE:p + CORE + SIDE]))
                before.append(b" ".join(words[max(0, p - SIDE):p][::-1]))
        if not digests:
            return None
        at = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(digests, pa.binary()), pa.array(after, pa.binary()), pa.array(before, pa.binary()), pa.array(np.concatenate(hots).astype(bool)),
             batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(places))],
            ["core", "after", "before", "hot", "doc_id", "text_id", "place"])

    return map_batches(joined, work, f"core binary, after binary, before binary, hot boolean, doc_id {_kind(docs)}, text_id long, place long")


def _agreeing(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def meeting(surroundings: list[tuple[list[bytes], list[bytes], int, object]]) -> list[tuple[list[int], list[int]]]:
    """For each of the distinct surroundings of a core (words behind, words before, number of places, first place), the
    windows that another place has too, and those that an earlier place than its own first one has.

    A window is named by the words of it that stand before the core.
    """
    own = [range(max(0, SIDE - len(after)), min(SIDE, len(before)) + 1) for after, before, _, _ in surroundings]
    if len(surroundings) == 1:
        return [(list(own[0]) if surroundings[0][2] > 1 else [], [])]
    if len(surroundings) == 2:
        (after_a, before_a, n_a, first_a), (after_b, before_b, n_b, first_b) = surroundings
        shared = range(SIDE - _agreeing(after_a, after_b), _agreeing(before_a, before_b) + 1)
        return [(list(own[0] if n_a > 1 else shared), list(shared) if first_b < first_a else []),
                (list(own[1] if n_b > 1 else shared), list(shared) if first_a < first_b else [])]
    windows: dict[tuple, list] = {}
    names = []
    for (after, before, n, first), ks in zip(surroundings, own, strict=True):
        named = [(k, *after[:SIDE - k], *before[:k]) for k in ks]
        names.append(named)
        for name in named:
            seen = windows.get(name)
            if seen is None:
                windows[name] = [n, first]
            else:
                seen[0] += n
                seen[1] = min(seen[1], first)
    return [([name[0] for name in named if windows[name][0] > 1], [name[0] for name in named if windows[name][1] < first])
            for named, (_, _, _, first) in zip(names, surroundings, strict=True)]


def _order(place: tuple) -> tuple:
    """Places in the order of documents; one without an ID comes first."""
    return (place[0] is not None, *(x for x in place if x is not None))


def _stretch(place: int, ks: list[int]) -> tuple[int, int]:
    """Words of the windows: those around one core overlap, so together they are one stretch."""
    return (place - max(ks), place - min(ks) + MIN_WORDS) if ks else (None, None)


def _judged(rows: list[tuple]) -> Iterator[tuple]:
    """Stretches of the suffixes of one core, given in sorted order: ``doc_id``, ``text_id``, the stretch that repeats and
    the part of it that an earlier place has."""
    surroundings, members = [], []
    for (after, before), group in groupby(rows, key=lambda r: (r[1], r[2])):
        places = sorted({(r[4], r[5], r[6]) for r in group}, key=_order)
        surroundings.append((after.split(), before.split(), len(places), _order(places[0])))
        members.append(places)
    for (after, before, n, _), places, (again, earlier) in zip(surroundings, members, meeting(surroundings), strict=True):
        if again:
            every = list(range(max(0, SIDE - len(after)), min(SIDE, len(before)) + 1))
            for i, (doc_id, text_id, place) in enumerate(places):
                yield doc_id, text_id, *_stretch(place, again), *_stretch(place, every if i else earlier), None


def _windows(row: tuple) -> Iterator[tuple]:
    """The windows around a hot core, by digest."""
    core, after, before, _, doc_id, text_id, place = row
    after, before = after.split(), before.split()
    for k in range(max(0, SIDE - len(after)), min(SIDE, len(before)) + 1):
        digest = xxhash.xxh3_128_digest(b"%s%d %s\n%s" % (core, k, b" ".join(after[:SIDE - k]), b" ".join(before[:k])))
        yield doc_id, text_id, place - k, place - k + MIN_WORDS, None, None, digest


def compared(docs: DataFrame) -> DataFrame:
    """Stretches around cores that repeat (``start``, ``end``), of each the part that has an ``earlier`` copy, and windows
    of hot cores, which have a ``window`` digest and wait for their counts."""
    every = suffixes(docs)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "text_id", "place"), F.lit(1 << 20))).otherwise(-1)
    laid = every.withColumn("salt", salt).repartition("core", "salt").drop("salt").sortWithinPartitions("core", "after", "before")
    kind, id_type = _kind(docs), to_arrow_type(docs.schema["doc_id"].dataType)
    schema = f"doc_id {kind}, text_id long, start long, end long, earlier_start long, earlier_end long, window binary"
    types = [id_type, *[pa.int64()] * 5, pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the suffixes of one core, which may go on in the next batch
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[3]:
                    out += _windows(row)
                    continue
                if held and held[0][0] != row[0]:
                    out += _judged(held)
                    held = []
                held.append(row)
            if out:
                yield _batch(out)
        if out := list(_judged(held)):
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return laid.mapInArrow(run, schema)


def stretches(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_id``, ``start`` and ``end`` of stretches of words that repeat, and ``earlier_start`` and
    ``earlier_end`` of those parts that an earlier place has; they overlap and are not merged."""
    found = stage(compared(docs), "compared")
    cold = found.where(F.col("window").isNull()).drop("window")
    hot = found.where(F.col("window").isNotNull()).select("window", "doc_id", "text_id", "start", "end")
    place = F.struct("doc_id", "text_id", "start")
    counted = hot.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    again = counted.where(~F.col("first").eqNullSafe(F.col("last"))).select("window", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = hot.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_id", "start"), F.lit(SALTS)).cast("int"))
    later = ~place.eqNullSafe(F.col("first"))
    joined = salted.join(again, ["window", "salt"]).select(
        "doc_id", "text_id", "start", "end", F.when(later, F.col("start")).alias("earlier_start"), F.when(later, F.col("end")).alias("earlier_end"))
    return cold.union(joined)


def merge_spans(spans: DataFrame) -> DataFrame:
    """Union of ``start_word`` to ``end_word`` per document; a window holds the spans of one document."""
    keys = ["doc_id", "text_id"]
    before = Window.partitionBy(*keys).orderBy("start_word", "end_word").rowsBetween(Window.unboundedPreceding, -1)
    opened = spans.withColumn("__new", F.coalesce(F.col("start_word") > F.max("end_word").over(before), F.lit(True)).cast("int"))
    island = F.sum("__new").over(Window.partitionBy(*keys).orderBy("start_word", "end_word").rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("__island", island).groupBy(*keys, "__island").agg(
        F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("__island")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Stretches of words that occur at another place too, one row each: ``doc_id``, first word, end and length."""
    found = stretches(docs).select("doc_id", "text_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"))
    return merge_spans(found).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeats cut out of ``text`` but at their first place, in the order of documents and places.

    The words of a window go wherever it is not the first of its kind. So each word that goes has an earlier copy, and
    following these copies ends at one that stays.
    """
    later = stretches(docs).where(F.col("earlier_start").isNotNull())
    cuts = merge_spans(later.select("doc_id", "text_id", F.col("earlier_start").alias("start_word"), F.col("earlier_end").alias("end_word")))
    [key, text_key, column] = fresh(docs, "__id", "__text", "__cuts")
    held = cuts.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias(column))
    held = held.select(F.col("doc_id").alias(key), F.col("text_id").alias(text_key), column)
    joined = docs.join(held, (F.xxhash64(docs["text"]) == held[text_key]) & docs["doc_id"].eqNullSafe(held[key]), "left").drop(key, text_key)
    names = docs.columns
    text_at, cuts_at = names.index("text"), len(names)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, parts in zip(batch.column(text_at).to_pylist(), batch.column(cuts_at).to_pylist(), strict=True):
            out.append(_cut(text, sorted((p["start_word"], p["end_word"]) for p in parts)) if text and parts else text)
        columns = [pa.array(out, pa.string()) if i == text_at else batch.column(i) for i in range(cuts_at)]
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(joined, work, docs.schema)


def _cut(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without these stretches of words, and without the white space before each."""
    raw = text.encode()
    words = [m.span() for m in _WORD.finditer(raw)]
    kept, at = [], 0
    for start, end in cuts:
        kept.append(raw[at:words[start][0]])
        at = words[end][0] if end < len(words) else words[-1][1]
    return b"".join([*kept, raw[at:]]).decode()


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


OP1_SQL = rf"""
WITH texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
split AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM texts),
windows AS (
    SELECT doc_id, text, s, md5(array_to_string(words[s + 1:s + {MIN_WORDS}], ' ')) AS h
    FROM (SELECT doc_id, text, words, unnest(range(len(words) - {MIN_WORDS} + 1)) AS s FROM split WHERE len(words) >= {MIN_WORDS})),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
found AS (SELECT doc_id, text, s FROM windows SEMI JOIN again USING (h)),
opened AS (SELECT *, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id, text ORDER BY s) + {MIN_WORDS} THEN 1 ELSE 0 END AS fresh FROM found),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, text ORDER BY s) AS island FROM opened)
SELECT doc_id, min(s) AS start_word, max(s) + {MIN_WORDS} AS end_word, max(s) + {MIN_WORDS} - min(s) AS n_words FROM islands GROUP BY doc_id, text, island
"""
