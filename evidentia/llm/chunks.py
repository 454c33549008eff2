"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text; where its lowest bits are a small number a chunk ends. These depend on the last
``REACH`` bytes only, so ends move with the text and an insertion changes the chunks around it and no others. Chunks are
compared by a 128-bit digest: counts and first places are summed up per task before they move, and chunks are joined to
the digests that occur again. The first copy in the order of documents and places stays.

A stretch of repeated chunks is reported if it covers its whole document, however short, or from ``MIN_RUN`` words or
``MIN_BYTES`` bytes on (text without spaces has bytes, but no words), so that a stock phrase or a line that many
documents share does not mark a document, while a passage of over 50 words keeps that much in whole chunks.

Defined results: NULL and empty texts have no chunks; places are byte offsets in UTF-8; rows that repeat are copies of each
other, reported once; rows that share a ``doc_id`` are reported under it; a NULL ``doc_id`` is an ID, before all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm.common import map_batches, stage, table

#: Bytes a chunk has at least and at most; a place behind the least ends it with a chance of 1 in ``ODDS``.
LEAST, MOST, ODDS, REACH = 12, 512, 24, 16
SEED = 2024
MIN_RUN, MIN_BYTES = 20, 160
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 22

_GEAR = np.random.default_rng(SEED).integers(0, 1 << 32, 256, np.uint32)
_MASK, _BELOW = np.uint32((1 << REACH) - 1), (1 << REACH) // ODDS
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def gear(data: np.ndarray) -> np.ndarray:
    """The hash behind each byte, as rolling ``h = 2 * h + gear[byte]`` gives it in its lowest ``REACH`` bits."""
    h, width = _GEAR[data], 1
    while width < REACH:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Where chunks end, the end of the text included."""
    marks = []
    for start in range(0, len(data), PIECE):
        begin = max(0, start - REACH)
        h = gear(data[begin:start + PIECE])[start - begin:]
        marks.append(np.nonzero((h & _MASK) < _BELOW)[0] + start + 1)
    ends, last = [], 0
    for mark in np.concatenate([*marks, [len(data)]]).tolist() if len(data) else []:
        while mark - last > MOST:
            last += MOST
            ends.append(last)
        if mark - last >= LEAST or mark == len(data) and mark > last:
            last = mark
            ends.append(last)
    return np.array(ends, np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """``high`` and ``low`` (the digest), ``doc_id``, ``start`` and ``size`` in bytes, ``words`` begun, and the bytes in ``all`` of its
    text, of every chunk."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows, starts, sizes, words, totals, digests = [], [], [], [], [], []
        for row, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
            if not text:
                continue
            data = np.frombuffer(text, np.uint8)
            ends = chunk_ends(data)
            begins = np.concatenate([[0], ends[:-1]])
            white = _WHITE[data]
            begun = np.cumsum(~white & np.concatenate([[True], white[:-1]]))
            words.append(np.diff(begun[ends - 1], prepend=0))
            rows.append(np.full(len(ends), row))
            totals.append(np.full(len(ends), len(text)))
            starts.append(begins)
            sizes.append(ends - begins)
            digests.extend([xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
        if not rows:
            return None
        digest = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(digest[:, 0]), pa.array(digest[:, 1]), batch.column(0).take(pa.array(np.concatenate(rows))),
             pa.array(np.concatenate(starts)), *[pa.array(np.concatenate(x).astype(np.int32)) for x in (sizes, words)], pa.array(np.concatenate(totals))],
            ["high", "low", "doc_id", "start", "size", "words", "all"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), work, f"high long, low long, doc_id {kind}, start long, size int, words int, all long")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Places of chunks whose digest occurs at two places or more; ``first_id`` and ``is_first`` tell the copy that stays."""
    every = chunks(docs)
    place = F.struct("doc_id", "start")
    again = every.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = stage(again.select("high", "low", F.col("first.doc_id").alias("first_id"), F.col("first.start").alias("first_start")), "digests")
    joined = every.join(again, ["high", "low"])
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("start") == F.col("first_start"))
    found = joined.select("doc_id", "start", "size", "words", "all", "first_id", is_first.alias("is_first"))
    # Placed by document once; copies of a row and the runs of a document need no further shuffle.
    return found.repartition("doc_id").dropDuplicates(["doc_id", "start"])


def repeated_runs(docs: DataFrame, min_run: int = MIN_RUN, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Stretches of adjacent repeated chunks that cover their document or are long enough, one row each.

    ``first_id`` is the smallest document a chunk of the stretch is first found in; ``n_cut`` counts the bytes that are
    not a first copy, the ones that dedup takes out. A window holds the repeated chunks of one document.
    """
    found = repeated_chunks(docs)
    by_start = Window.partitionBy("doc_id").orderBy("start")
    opened = found.withColumn("__new", F.coalesce(
        F.col("start") > F.max(F.col("start") + F.col("size")).over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    runs = opened.withColumn("__run", F.sum("__new").over(by_start)).groupBy("doc_id", "__run").agg(
        F.min("start").alias("start_byte"), F.max(F.col("start") + F.col("size")).alias("end_byte"), F.sum("words").alias("n_words"),
        F.max("all").alias("all"), F.count("*").alias("n_chunks"), F.min("first_id").alias("first_id"),
        F.sum(F.when(F.col("is_first"), 0).otherwise(F.col("size"))).cast("long").alias("n_cut"))
    size = F.col("end_byte") - F.col("start_byte")
    return runs.where((F.col("n_words") >= min_run) | (size >= min_bytes) | (size == F.col("all"))).drop("__run", "all")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_runs(table(spark, sf_dir, "documents"))
