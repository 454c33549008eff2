"""Shapes that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.durable import work_folder
from evidentia.functions.ship import ship

#: The white space that separates words wherever a contract names `[^\x20\x09-\x0D]+`.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The given names, lengthened until none clashes with a column of ``df`` (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: later jobs neither recompute it nor depend on an executor."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def spaced(text: Column) -> Column:
    """The text with each white-space character turned into a space; empty for NULL. Chained replacements of single
    characters cost a third of a regular expression."""
    out = F.coalesce(text, F.lit(""))
    for mark in WHITE[1:]:
        out = F.replace(out, F.lit(mark), F.lit(" "))
    return out


def white_words(text: Column) -> Column:
    """Words between runs of white space; none for NULL."""
    return F.array_remove(F.split(spaced(text), " "), "")


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """Run ``work`` over Arrow batches; it returns the rows of one batch, or None."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if out is not None and out.num_rows:
                    yield from ([out] if isinstance(out, pa.RecordBatch) else out.to_batches())

    return df.mapInArrow(run, schema)


#: Bits of a bitmap, whatever it marks: 2 MB on the driver and in each task.
BITS = 1 << 24


def bitmap(hashes: DataFrame) -> Broadcast:
    """A bit for each value of the one column ``hash``, for scans that look ahead what a later exact join will keep.

    Its size does not grow with the table: the more values there are, the more others pass in vain, and none is lost.
    """
    bit = F.pmod("hash", F.lit(BITS))
    words = hashes.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    marks = np.zeros(BITS // 64, np.int64)
    marks[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(marks.view(np.uint8))


def marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of these 64-bit hashes may be in the bitmap."""
    bit = hashes.view(np.uint64) & np.uint64(BITS - 1)
    return (marks[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound. Made inside a task and gone with it."""

    BOUND = 500_000

    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows_hashed(hashes: np.ndarray, length: int, multiplier: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """One hash for each window of ``length`` elements: a polynomial modulo 2 ** 64 by doubling, mixed at the end."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, run, width = np.uint64(multiplier), hashes, 1
    out, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if length & width:
                # ``out`` covers ``done`` elements from each place; append ``width`` more.
                out, done = (run if out is None else out[:len(run) - done] * power + run[done:done + len(out)][:len(run) - done]), done + width
            if 2 * width > length:
                break
            run = run[:-width] * power + run[width:]
            power = power * power
            width *= 2
        out = out[:n]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))
