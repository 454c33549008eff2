"""SimHash near-duplicates: an exact comparison of all fingerprints in tiles.

A tile holds distinct fingerprints whose four 16-bit words have the same population counts. Two fingerprints within the
radius differ by at most the radius in the sum of these counts' differences, so only tiles whose counts are that near are
compared, by exclusive-or and bit counts in numpy; all other pairs of tiles are skipped without loss. Copies are folded
before tiles are cut, large tiles are cut further by hash, and a comparison hands on a spanning forest of its links, so
neither a group of copies nor a cluster of near copies makes pairs.

Defined results: a NULL or empty text has fingerprint zero and is linked like any other; rows that repeat are members of
one component; a NULL ``doc_id`` stands in the result with its component but never names one, so the component is NULL
if no member has an ID.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import fresh, map_batches, stage, table
from evidentia.llm.components import connected

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints in a tile; two tiles and one block of their comparison fit a task's memory many times.
TILE = 16_384
#: Pairs compared at a time (8 bytes each).
BLOCK = 1 << 20
WORDS, WORD_BITS = 4, 16

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = 256 * np.arange(8, dtype=np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE, block: int = 1 << 16) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's word shingles."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, block):
        part = words[start:min(n, start + block) + shingle - 1]
        grams = map(b" ".join, zip(*[part[i:] for i in range(shingle)], strict=False)) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        lanes = hashes.view(np.uint8).reshape(-1, 8) + _LANES
        ones += (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed integer) of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        fps = np.fromiter((fingerprint(t or b"") for t in texts), np.uint64, len(texts))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _cell(fp: Column) -> Column:
    """The population counts of the fingerprint's words, packed into one number."""
    counts = [F.bit_count(F.shiftrightunsigned(fp, WORD_BITS * w).bitwiseAND(F.lit((1 << WORD_BITS) - 1))) for w in range(WORDS)]
    packed = counts[0]
    for c in counts[1:]:
        packed = packed * (WORD_BITS + 1 + 2 * RADIUS) + c
    return packed.cast("int")


def _steps(radius: int) -> list[int]:
    """Differences of packed counts within the radius, one of each pair of opposite ones, and zero."""
    base = WORD_BITS + 1 + 2 * RADIUS
    near = [d for d in product(range(-radius, radius + 1), repeat=WORDS) if sum(map(abs, d)) <= radius]
    packed = {sum(x * base ** (WORDS - 1 - i) for i, x in enumerate(d)) for d in near}
    return sorted(x for x in packed if x >= 0)


def spanning_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest one it reaches by the given links."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[:len(u)], place[len(u):]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all pairs of the two tiles that differ in at most ``radius`` bits."""
    found_u, found_v, held = [], [], 0
    rows = max(1, BLOCK // max(1, len(b)))
    for start in range(0, len(a), rows):
        part = a[start:start + rows]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ b[None, :]) <= radius)
        unlike = part[i] != b[j]
        found_u.append(part[i[unlike]])
        found_v.append(b[j[unlike]])
        held += len(found_u[-1])
        if held > BLOCK:
            u, v = spanning_forest(np.concatenate(found_u), np.concatenate(found_v))
            found_u, found_v, held = [u], [v], 0
    return spanning_forest(np.concatenate(found_u), np.concatenate(found_v)) if found_u else (a[:0], a[:0])


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges that connect exactly those distinct ``fp`` that a chain of steps within the radius connects."""
    celled = fps.select("fp", _cell(F.col("fp")).alias("cell"))
    # At most 17 ** WORDS cells, whatever the input: small enough to broadcast.
    cells = celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    cut = celled.join(F.broadcast(cells), "cell").select("fp", "cell", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
    tiles = stage(cut.groupBy("cell", "part").agg(F.collect_list("fp").alias("fps")), "tiles")
    steps = F.array(*[F.lit(s) for s in _steps(radius)])
    reached = tiles.select(F.col("cell").alias("from_cell"), F.col("part").alias("from_part"), F.col("fps").alias("a"), F.explode(steps).alias("step"))
    reached = reached.withColumn("cell", F.col("from_cell") + F.col("step")).join(F.broadcast(cells), "cell")
    opened = reached.select("from_cell", "from_part", "a", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = opened.join(tiles.withColumnRenamed("fps", "b"), ["cell", "part"])
    pairs = pairs.where((F.col("cell") != F.col("from_cell")) | (F.col("part") >= F.col("from_part"))).select("a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                left, right = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (a, b))
                u, v = near_pairs(left, right, radius)
                us.append(u.view(np.int64))
                vs.append(v.view(np.int64))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return pairs.mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (the smallest ``doc_id`` reachable) of every row of ``docs``."""
    prints = stage(fingerprints(docs), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component, of the document that names it; rows without a ``doc_id`` stay, as nothing names them.

    Rows that share a ``doc_id`` are one document. Texts move once, by ``doc_id``.
    """
    found = near_duplicates(docs, radius)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).union(docs.where(F.col("doc_id").isNull()))


def one_row_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component, the one with the smallest ``doc_id`` (and, where rows share it, the smallest hash of the
    text). Rows that share a ``doc_id`` but not their text are judged by themselves; rows without one stay, as nothing names them.
    """
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("node")))
    found = near_duplicates(docs.select(key.alias("doc_id"), "text"), radius)
    [node] = fresh(docs, "__node")
    kept = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id.doc_id", F.col("doc_id.node").alias(node)).distinct()
    named = docs.where(F.col("doc_id").isNotNull()).withColumn(node, F.xxhash64("text")).join(kept, ["doc_id", node], "left_semi")
    return named.dropDuplicates(["doc_id", node]).select(*docs.columns).union(docs.where(F.col("doc_id").isNull()))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
