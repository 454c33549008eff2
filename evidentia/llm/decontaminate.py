"""Benchmark decontamination: edit-tolerant search for benchmark items in whole documents.

Texts are sequences of hashed words. A window as long as an item is embedded by random walks (CGK): step ``j`` emits the
word under the walker and moves it on or not, as a random function of the step and the word says, so that few edits
become few differing steps. Each of ``REPEATS`` independent walks samples ``BITS`` steps; a window whose samples equal the
item's in any walk is a candidate, and its exact edit distance, with free ends, decides.

Windows are placed where they can matter: an item within ``MAX_EDITS`` of its words of some stretch of text shares an
unedited run of words with it, by the pigeonhole principle (``run_length``), so windows are aligned on such runs. Every
place of every document is tested for them. The tests measure recall against exhaustive search: edit distances of all
items to all places of all documents.

Items are dealt to numbered blocks of about ``BLOCK_WORDS`` words. One block at a time goes to the tasks, which index it,
and each is one more pass over the documents whose result is written before the next one starts; so driver and tasks hold
one block, whatever the size of the benchmark. Documents are never shuffled.

Defined results: NULL and empty texts and items match nothing; items that repeat are reported each; documents that
repeat are reported each; a document without a match has no row; without items or documents there are no rows.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.llm.common import WordHashes, map_batches, stage, table, windows_hashed

#: Share of an item's words that may be edited: a similarity of 0.8 or more.
MAX_EDITS = 0.2
REPEATS, BITS = 32, 2
STEPS = 3
SEED = 7
BLOCK_WORDS = 1_000_000
#: Words handled at a time in a task.
SLICE_WORDS = 1 << 20
_NO_WORD = np.uint64(0)
#: Words are runs of letters, digits and characters outside ASCII, in lower case.
_WORD_BYTES = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_WORD_BYTES).split()


def edits_allowed(n: int) -> int:
    return int(MAX_EDITS * n + 1e-9)


def run_length(n: int) -> int:
    """Words in a row that stay unedited in every match of an item of ``n`` words; three are enough to look for."""
    e = edits_allowed(n)
    return max(1, min(3, math.ceil((n - e) / (e + 1))))


def embed(windows: np.ndarray, walks: int = REPEATS, seed: int = SEED) -> np.ndarray:
    """Samples of each walk over each row of ``windows`` (word hashes): an array of rows, walks and bits."""
    rows, n = windows.shape
    steps = STEPS * n
    random = np.random.default_rng([seed, n])
    sampled = np.sort(random.integers(0, steps, (walks, BITS)), axis=1)
    keys = random.integers(0, 1 << 63, (steps, walks), np.uint64)
    padded = np.concatenate([windows, np.zeros((rows, 1), np.uint64)], axis=1)
    walker = np.zeros((rows, walks), np.int64)
    out = np.zeros((rows, walks, BITS), np.uint64)
    at = np.arange(rows)[:, None]
    with np.errstate(over="ignore"):
        for j in range(int(sampled.max()) + 1):
            word = padded[at, walker]
            for bit in range(BITS):
                take = sampled[:, bit] == j
                if take.any():
                    out[:, take, bit] = word[:, take]
            move = ((word ^ keys[j]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
            walker = np.minimum(walker + move.astype(np.int64), n)
    return out


def distances(item: np.ndarray, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of ``item`` to any part of each row of ``stretches``, and where that part ends."""
    rows, width = stretches.shape
    place = np.arange(width + 1)
    row = np.zeros((rows, width + 1), np.int64)
    for i, word in enumerate(item, 1):
        change = row[:, :-1] + (stretches != word)
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(change, row[:, 1:] + 1)
        # Insertions run along the row: a running minimum of what is left after taking the place off.
        row = np.minimum.accumulate(new - place, axis=1) + place
    end = row.argmin(axis=1)
    return row[np.arange(rows), end], end


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal values."""
    cuts = [*np.nonzero(np.diff(values))[0] + 1]
    return zip([0, *cuts], [*cuts, len(values)], strict=True) if len(values) else iter(())


class ItemIndex:
    """Items of one block: their runs of words and their embeddings."""

    def __init__(self, items: list[tuple[object, str]]):
        hashes = WordHashes()
        self.ids, self.words = [], []
        for item_id, text in items:
            words = hashes.of(words_of(text))
            if len(words):
                self.ids.append(item_id)
                self.words.append(words)
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for number, words in enumerate(self.words):
            length = run_length(len(words))
            runs[length] += [(int(h), number, at) for at, h in enumerate(windows_hashed(words, length))]
        self.runs = {}
        for length, found in runs.items():
            found.sort()
            self.runs[length] = (np.array([f[0] for f in found], np.uint64), np.array([f[1:] for f in found], np.int64))
        # Items of one length are embedded together; ``place`` is an item's row among them.
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.place, self.samples = np.zeros(len(self.words), np.int64), {}
        for n in np.unique(self.sizes):
            same = np.nonzero(self.sizes == n)[0]
            self.place[same] = np.arange(len(same))
            self.samples[int(n)] = embed(np.stack([self.words[i] for i in same]))

    def windows(self, text: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Distinct rows of item and start in ``text`` (documents one after another, apart by a word of their own)."""
        out = []
        for length, (known, where) in self.runs.items():
            hashed = windows_hashed(text, length)
            if not len(hashed):
                continue
            filter_bits = np.zeros(1 << 20, bool)
            filter_bits[known & np.uint64((1 << 20) - 1)] = True
            hits = np.nonzero(filter_bits[hashed & np.uint64((1 << 20) - 1)])[0]
            low = np.searchsorted(known, hashed[hits], "left")
            count = np.searchsorted(known, hashed[hits], "right") - low
            hits, low, count = hits[count > 0], low[count > 0], count[count > 0]
            if len(hits):
                inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                item, at = where[np.repeat(low, count) + inside].T
                out.append(np.stack([item, np.repeat(hits, count) - at, owner[np.repeat(hits, count)]], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def matches(self, text: np.ndarray, owner: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Document number, item number, end of the match in words and distance, for the best match of each pair.

        ``first`` holds where each document starts in ``text``, and one more entry for the end.
        """
        found = self.windows(text, owner)
        size = self.sizes[found[:, 0]]
        for n in np.unique(size):
            for part in self._near(text, found[size == n], int(n), first):
                for low, high in _runs(part[:, 0]):
                    yield from self._verified(text, part[low:high], int(n), first)

    def _near(self, text: np.ndarray, found: np.ndarray, n: int, first: np.ndarray) -> Iterator[np.ndarray]:
        """Windows of ``n`` words that agree with their item in all samples of a walk."""
        rows = max(1, SLICE_WORDS // (n * REPEATS))
        for start in range(0, len(found), rows):
            part = found[start:start + rows]
            taken = embed(self._cut(text, part[:, 1], n, first[part[:, 2]], first[part[:, 2] + 1]))
            yield part[(taken == self.samples[n][self.place[part[:, 0]]]).all(axis=2).any(axis=1)]

    def _verified(self, text: np.ndarray, found: np.ndarray, n: int, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """The windows of one item that are within the allowed distance."""
        number, e = int(found[0, 0]), edits_allowed(n)
        rows = max(1, SLICE_WORDS // (n + 2 * e))
        for start in range(0, len(found), rows):
            part = found[start:start + rows]
            begin = first[part[:, 2]]
            distance, stop = distances(self.words[number], self._cut(text, part[:, 1] - e, n + 2 * e, begin, first[part[:, 2] + 1]))
            stop = stop + part[:, 1] - e - begin
            for row in np.nonzero(distance <= e)[0]:
                yield int(part[row, 2]), number, int(stop[row]), int(distance[row])

    @staticmethod
    def _cut(text: np.ndarray, start: np.ndarray, width: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``width`` words from each start; where that is outside the document stands no word."""
        place = start[:, None] + np.arange(width)
        inside = (place >= begin[:, None]) & (place < end[:, None])
        return np.where(inside, text[np.clip(place, 0, len(text) - 1)], _NO_WORD)


def _blocks(items: DataFrame) -> Iterator[Broadcast]:
    """The items in blocks of about ``BLOCK_WORDS`` characters' worth of words, one at a time."""
    given = items.where(F.col("text").isNotNull()).select("item_id", "text")
    size = given.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    count = math.ceil(size / BLOCK_WORDS)
    spark = items.sparkSession
    if count > 1:
        given = stage(given.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count))), "items")
    for number in range(count):
        block = (given.where(F.col("block") == number) if count > 1 else given).select("item_id", "text").toArrow()
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, block.column(0).to_pylist(), block.column(1).to_pylist()))


_indexed: dict[str, ItemIndex] = {}


def _index(block: Broadcast) -> ItemIndex:
    """The block's index, made once in each worker, which keeps one."""
    name, ids, texts = block.value
    if name not in _indexed:
        _indexed.clear()
        _indexed[name] = ItemIndex(list(zip(ids, texts, strict=True)))
    return _indexed[name]


def _found(known: ItemIndex, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
    """Row, item, end in words and distance of the best match of each row and item."""
    hashes, out = WordHashes(), []
    rows, parts, held = [], [], 0
    for row, text in enumerate([*texts, None]):
        words = hashes.of(words_of(text))
        if len(words):
            rows.append(row)
            parts.append(words)
            held += len(words)
        if rows and (held >= SLICE_WORDS or row == len(texts)):
            sizes = np.array([len(p) for p in parts])
            first = np.concatenate([[0], np.cumsum(sizes)])
            best: dict[tuple[int, int], tuple[int, int]] = {}
            # Runs over the edge of two documents give windows that ``_cut`` keeps inside the one they start in.
            for doc, item, stop, distance in known.matches(np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes), first):
                best[doc, item] = min(best.get((doc, item), (distance, stop)), (distance, stop))
            out += [(rows[doc], item, stop, distance) for (doc, item), (distance, stop) in best.items()]
            rows, parts, held = [], [], 0
    return out


def _search(docs: DataFrame, index, schema: str, id_type: pa.DataType) -> DataFrame:
    """Matches of the items of one broadcast index."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        known = _index(index)
        found = _found(known, batch.column(1).to_pylist())
        if not found:
            return None
        lines, items, stops, distance = (np.array(c, np.int64) for c in zip(*found, strict=True))
        lengths = known.sizes[items]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(lines)), pa.array([known.ids[i] for i in items], id_type), pa.array(stops), pa.array(lengths),
             pa.array(distance), pa.array(1 - distance / lengths)],
            ["doc_id", "item_id", "end_word", "item_words", "distance", "similarity"])

    return map_batches(docs.select("doc_id", "text"), work, schema)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item; decided row by row, so nothing is joined."""
    text = docs.columns.index("text")

    def without(index):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            clean = np.ones(batch.num_rows, bool)
            clean[[f[0] for f in _found(_index(index), batch.column(text).to_pylist())]] = False
            return batch.filter(pa.array(clean))

        return work

    out, before = docs, None
    for block in _blocks(items):
        if before is not None:
            out = stage(out, "clean")
            before.destroy()
        out, before = map_batches(out, without(block), docs.schema), block
    return out


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Each document row and item it holds: where the best match ends (in words), its distance and similarity."""
    spark = docs.sparkSession
    kind = [df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (items, "item_id"))]
    schema = f"doc_id {kind[0]}, item_id {kind[1]}, end_word long, item_words long, distance long, similarity double"
    id_type = to_arrow_type(items.schema["item_id"].dataType)
    done, now, before = [], None, None
    for block in _blocks(items):
        if now is not None:
            done.append(stage(now, "matches"))
            before.destroy()
        now, before = _search(docs, block, schema, id_type), block
    found = [*done, *([now] if now is not None else [])] or [spark.createDataFrame([], schema)]
    return reduce(DataFrame.union, found)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
