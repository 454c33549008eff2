"""Periodic runs: stretches of words that repeat with a period, found on sparse diagonals.

The cell (word, lag) of a text is live if the word equals the one ``lag`` places before. A run of period ``q`` is a stretch
of live cells on diagonal ``q``; each word's earlier occurrence adds one to the match length of the lag that it names,
and a diagonal whose stretch breaks is reported at once if it is long enough, else forgotten. Three facts keep the live
cells few, and lose no run of exponent ``EXPONENT`` = 4 or more:

- lags up to ``W`` and over ``W / 2`` are looked at with ``W`` words of context (``W`` = 1, 2, 4, ...), which every word of
  such a run has, so a word that recurs by chance makes no cell;
- with that context the nearest earlier occurrence is enough: were it nearer than the smallest period ``q``, the run would
  have a smaller period (Fine and Wilf), so inside a run each word adds to diagonal ``q`` and to no other;
- a context of ``2 * W`` words recurs only where both halves do, so each level visits only what the one before left.

So a text of ``n`` words costs O(n log n) whatever it holds, one word repeated a million times included. Contexts are named
by numbers that stand for them exactly (names of pairs of names), so nothing rests on a hash.

Defined results: a NULL or empty text has no words and no run; rows that repeat are worked on alike, each by itself; a NULL
``doc_id`` is an ID; the smallest period of a stretch is the one reported.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import let, map_batches, table, white_words

#: A run has this many periods at least, and this many words.
EXPONENT, MIN_WORDS = 4, 6


def _stretches(at: np.ndarray, lags: np.ndarray, width: int, least: int) -> np.ndarray:
    """Start, length and period of the stretches of live cells that are long enough; ``at`` ascends."""
    breaks = np.nonzero((np.diff(at) != 1) | (np.diff(lags) != 0))[0] + 1
    first, last = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(at)]]) - 1
    period = lags[first]
    start, length = at[first] - period, at[last] - at[first] + width + period
    kept = length >= np.maximum(least, EXPONENT * period)
    return np.stack([start[kept], length[kept], period[kept]], axis=1)


def _in_groups(names: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and places sorted by name and then by place."""
    top = int(names.max()) + 1
    if top * n < 1 << 62:
        packed = np.sort(names * n + at)
        return packed // n, packed % n
    order = np.argsort(names, kind="stable")
    return names[order], at[order]


def word_runs(ids: np.ndarray, least: int = MIN_WORDS) -> np.ndarray:
    """Start, length and period of every run of a sequence of word numbers (0 and up), by start and then period."""
    n, found = len(ids), []
    if n < least:
        return np.zeros((0, 3), np.int64)
    live = np.nonzero(ids[1:] == ids[:-1])[0] + 1
    if len(live):
        found.append(_stretches(live, np.ones(len(live), np.int64), 1, least))
    # Words that recur; ``named`` holds the number of the context that starts at a place, -1 where it does not recur.
    named = np.where(np.bincount(ids)[ids] > 1, ids, -1)
    width = 1
    while (width + 1) * EXPONENT <= n:
        at = np.nonzero(named[:-width] >= 0)[0]
        at = at[named[at + width] >= 0]
        if len(at) < 2:
            break
        names = named[at] * (int(named.max()) + 1) + named[at + width]
        width *= 2
        names, at = _in_groups(names, at, n)
        same = names[1:] == names[:-1]
        lags = np.where(same, np.diff(at), 0)
        cells = np.nonzero((lags > width // 2) & (lags <= width))[0]
        if len(cells):
            order = np.argsort(at[cells + 1])
            found.append(_stretches(at[cells + 1][order], lags[cells][order], width, least))
        recurs = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        number = np.cumsum(np.concatenate([[0], ~same]))
        named = np.full(n, -1, np.int64)
        named[at[recurs]] = number[recurs]
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when every run keeps its first period only."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth)[:n] == 0


def periodic_runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start and length in words, period) and ``collapsed``, the text with each run cut
    to its first period and one space between words, of every row of ``docs``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, found, texts = [], [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            words, numbers = (text or b"").split(), {}
            ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
            runs = word_runs(ids, least)
            counts.append(len(words))
            found.append(runs)
            texts.append(b" ".join(compress(words, kept_words(len(words), runs)) if len(runs) else words))
        flat = np.concatenate(found)
        rows = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), rows)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return map_batches(docs.select("doc_id", "text"), work, schema)


def planted(docs: DataFrame) -> DataFrame:
    """The texts of the query's contract: in one document of ten the words behind some place repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        moved = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p)))
        return F.when(n > 0, F.array_join(moved, " "))

    return docs.select("doc_id", F.when(h % 10 == 0, let(white_words(F.col("text")), repeated)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.col("runs")
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"], r.alias("run"))))
    marked = found.select("doc_id", runs, "collapsed", longest["run"].alias("best"))
    return marked.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
