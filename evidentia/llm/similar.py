"""Near-duplicates by the share of common word shingles: a Jaccard similarity of ``SIMILARITY`` or more.

SimHash cannot carry this: texts at a similarity of 0.8 differ in about seven of 64 bits, and within a radius that finds
them nearly all pairs of tiles would have to be compared. So candidates share a band of MinHash values (a pair at 0.8
shares none of ``BANDS`` with a chance of 7e-5), and the exact similarity of their shingle sets decides.

Every pair of a bucket, however large, is compared or already connected. First each member is compared with the smallest
one of its bucket, which connects groups of near copies by as many pairs as they have members. What is left are buckets
whose members are not all connected: these are cut into tiles of a bounded size, each pair of tiles goes to one task,
numpy counts the common shingles of all its pairs, and the task hands on a spanning forest of the similar ones. Buckets
with the same members count once, small ones share a tile.

Skew: copies fold to one node before bands are grouped; no row is written for a pair of a bucket, and a row moves once for
each tile that its own is compared with. Texts do not move: a bitmap of bounded size tells the scan which ones are asked for.

Defined results: texts without words are copies of each other; a text shorter than a shingle is one shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import LOWER, UPPER, WHITE, WordHashes, bitmap, fresh, map_batches, marked, stage, windows_hashed
from evidentia.llm.components import connected
from evidentia.llm.simhash import spanning_forest

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
SEED = 11
#: Shingles hashed at a time.
BLOCK = 1 << 11
#: Members and shingles of a tile, on average; two tiles and their counts fit a task's memory many times.
TILE_MEMBERS, TILE_SHINGLES = 512, 1 << 18
#: Pairs that share a shingle are counted one by one up to so many a shingle, else by a product of matrices.
FEW = 256

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_KEYS, _FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
_FACTORS = 2 * _FACTORS + np.uint64(1)


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text, in lower case."""
    words = hashes.of(text.translate(_LOWER).split())
    return np.unique(windows_hashed(words, min(SHINGLE, len(words)))) if len(words) else words


def bands(grams: np.ndarray) -> np.ndarray:
    """One hash of ``ROWS`` MinHash values for each band."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(grams), BLOCK):
            least = np.minimum(least, ((grams[start:start + BLOCK, None] ^ _KEYS) * _FACTORS).min(axis=0))
        out = np.arange(BANDS, dtype=np.uint64)
        for row in least.reshape(BANDS, ROWS).T:
            out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return out


def _node(text: str = "text") -> Column:
    """A hash of the text that names all its copies."""
    return F.xxhash64(F.coalesce(F.btrim(text, F.lit(WHITE)), F.lit("")))


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``node``, ``n`` (distinct shingles) and ``bands`` of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, n, found = WordHashes(), [], []
        for text in batch.column(2).cast(pa.binary()).to_pylist():
            grams = shingles(text or b"", hashes)
            n.append(len(grams))
            found.append(bands(grams))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(found).view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), lists], ["doc_id", "node", "n", "bands"])

    return map_batches(docs.select("doc_id", _node().alias("node"), "text"), work, f"doc_id {_kind(docs)}, node long, n int, bands array<long>")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and ``grams`` of one row of each of the ``nodes``, the one with ``first_id``."""
    known = bitmap(nodes.select(F.xxhash64("node", "first_id").alias("hash")))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        asked = pa.array(np.nonzero(marked(known.value, batch.column(0).to_numpy()))[0])
        if not len(asked):
            return None
        hashes = WordHashes()
        grams = [shingles(t or b"", hashes) for t in batch.column(3).take(asked).cast(pa.binary()).to_pylist()]
        ends = np.cumsum([0, *map(len, grams)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(grams).view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(1).take(asked), batch.column(2).take(asked), lists], ["node", "doc_id", "grams"])

    given = docs.select(_node().alias("node"), "doc_id", "text")
    passed = map_batches(given.select(F.xxhash64("node", "doc_id"), "*"), work, f"node long, doc_id {_kind(docs)}, grams array<long>")
    one = nodes.select(F.col("node").alias("__node"), F.col("first_id").alias("__id"))
    exact = passed.join(one, (passed["node"] == one["__node"]) & passed["doc_id"].eqNullSafe(one["__id"]), "left_semi")
    return exact.select("node", "grams").dropDuplicates(["node"])


def _near(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def bucket_members(prints: DataFrame) -> DataFrame:
    """``bucket``, ``node``, ``n``, and of the bucket ``rep`` (its smallest node, with its size), ``size`` and ``total`` (shingles).

    Buckets of one node are left out, and of those with the same nodes all but one.
    """
    nodes = prints.where("n > 0").dropDuplicates(["node"])
    spread = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    whole = spread.groupBy("bucket").agg(
        F.min(F.struct("node", "n")).alias("rep"), F.count("*").alias("size"), F.sum("n").alias("total"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(SEED))).alias("y")).where("size > 1")
    kept = whole.groupBy("x", "y", "size").agg(F.min("bucket").alias("bucket"), F.first("rep").alias("rep"), F.first("total").alias("total"))
    return spread.join(kept.drop("x", "y"), "bucket")


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose exact similarity is high enough."""
    left = sets.select(F.col("node").alias("u"), F.col("grams").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("grams").alias("b"))
    shared = pairs.join(left, "u").join(right, "v").select("u", "v", F.size(F.array_intersect("a", "b")).alias("i"), (F.size("a") + F.size("b")).alias("both"))
    return shared.where(F.col("i") >= similarity * (F.col("both") - F.col("i")) - 1e-9).select("u", "v")


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``a`` shares with each of ``b``; the sets hold distinct sorted numbers."""
    (rows_a, flat_a), (rows_b, flat_b) = ((np.repeat(np.arange(len(s)), [len(x) for x in s]), np.concatenate(s)) for s in (a, b))
    both = np.intersect1d(flat_a, flat_b)
    counts = np.zeros((len(a), len(b)), np.int64)
    if not len(both):
        return counts

    def laid(rows: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        known = both[at] == flat
        order = np.argsort(at[known], kind="stable")
        return at[known][order], rows[known][order], np.bincount(at[known], minlength=len(both))

    at_a, rows_a, n_a = laid(rows_a, flat_a)
    at_b, rows_b, n_b = laid(rows_b, flat_b)
    few = n_a * n_b <= FEW
    first_b = np.concatenate([[0], np.cumsum(n_b)[:-1]])
    light = np.nonzero(few[at_a])[0]
    for part in np.array_split(light, max(1, n_b[at_a[light]].sum() >> 22)):
        times = n_b[at_a[part]]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        pairs = np.repeat(rows_a[part] * len(b), times) + rows_b[np.repeat(first_b[at_a[part]], times) + inside]
        counts += np.bincount(pairs, minlength=counts.size).reshape(counts.shape)
    many = np.nonzero(~few)[0]
    number = np.full(len(both), -1)
    for start in range(0, len(many), BLOCK):
        block = many[start:start + BLOCK]
        number[block] = np.arange(len(block))
        held = []
        for at, rows, size in ((at_a, rows_a, len(a)), (at_b, rows_b, len(b))):
            column = number[at]
            matrix = np.zeros((size, len(block)), np.float32)
            matrix[rows[column >= 0], column[column >= 0]] = 1
            held.append(matrix)
        counts += np.rint(held[0] @ held[1].T).astype(np.int64)
        number[block] = -1
    return counts


def _tile_links(part: pa.Table, similarity: float) -> pa.Table:
    """A spanning forest of the similar pairs between two tiles, or within one, whose members are not connected yet."""
    side, node, root = (part.column(c).to_numpy() for c in ("side", "node", "root"))
    grams = part.column("grams").combine_chunks()
    ends, flat = grams.offsets.to_numpy(), grams.values.to_numpy()
    sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
    right = right if len(right) else left
    apart = root[left][:, None] != root[right][None, :]
    if not apart.any():
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    sizes = np.diff(ends)
    shared = common_counts([sets[i] for i in left], [sets[j] for j in right])
    i, j = np.nonzero(apart & (shared >= similarity * (sizes[left][:, None] + sizes[right][None, :] - shared) - 1e-9))
    u, v = spanning_forest(root[left[i]], root[right[j]])
    return pa.table({"u": u, "v": v})


def tile_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between the roots of similar members of buckets whose ``members`` (with ``root``) are not all connected."""
    mixed = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    parts = F.ceil(F.greatest(F.col("size") / TILE_MEMBERS, F.col("total") / TILE_SHINGLES)).cast("int")
    left = stage(members.join(mixed, "bucket").select("bucket", "size", "total", "node", "root", parts.alias("parts")), "mixed")
    # Small buckets share tiles; how many tiles is one number.
    load = F.sum(F.lit(1 / TILE_MEMBERS) + F.col("total") / F.col("size") / TILE_SHINGLES)
    packs = int(left.where("parts = 1").agg(load).first()[0] or 0) + 1
    own = F.pmod(F.xxhash64("node", "bucket"), F.col("parts")).cast("int")
    one = left.where("parts = 1").select(
        F.pmod(F.xxhash64("bucket"), F.lit(packs)).alias("tile"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"), "node", "root").distinct()
    cut = left.where("parts > 1").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    many = cut.select(
        F.col("bucket").alias("tile"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "root")
    laid = one.union(many).join(sets, "node")
    return laid.groupBy("tile", "i", "j").applyInArrow(lambda part: _tile_links(part, similarity), "u long, v long")


def similar_roots(docs: DataFrame, prints: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``node`` and ``root`` of the nodes that links of similar texts connect, but for the roots."""
    members = stage(bucket_members(prints), "members")
    firsts = prints.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    sets = stage(_sets(docs, stage(firsts.join(members.select("node").distinct(), "node", "left_semi"), "asked")), "sets")
    near = members.where((F.col("node") != F.col("rep.node")) & _near(F.col("n"), F.col("rep.n"), similarity))
    stars = near.select(F.col("rep.node").alias("u"), F.col("node").alias("v")).distinct()
    roots = connected(similar_pairs(stars, sets, similarity))
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    further = connected(tile_links(rooted, sets, similarity)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(further, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.union(further.select(F.col("root").alias("node"), F.col("top").alias("root")))


def one_of_similar(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group that links of similar texts connect: the one with the smallest ``doc_id`` (and, where rows
    share it, the smallest hash of the text). Rows without a ``doc_id`` stay, as nothing names them."""
    prints = stage(signatures(docs), "signatures")
    roots = similar_roots(docs, prints, similarity)
    firsts = prints.where(F.col("doc_id").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    rooted = firsts.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min(F.struct("doc_id", "node")).alias("first"))
    [node] = fresh(docs, "__node")
    kept = rooted.select("first.doc_id", F.col("first.node").alias(node))
    named = docs.where(F.col("doc_id").isNotNull()).withColumn(node, _node()).join(kept, ["doc_id", node], "left_semi")
    return named.dropDuplicates(["doc_id", node]).select(*docs.columns).union(docs.where(F.col("doc_id").isNull()))
