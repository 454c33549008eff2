"""A live retrieval index: segments, committed versions and snapshots.

Every batch of documents becomes one segment: a folder with the postings, statistics and vectors of its own chunks, the
documents it holds, and what it takes back from older segments (``kills``, by document and segment, with their share of
the statistics as negative counts). A version of the index is a manifest that names the segments it consists of. Files
of a segment are written first and named by a manifest afterwards, in one atomic step that fails if the version is
there already: a reader never sees half a batch, a writer that dies leaves the version before, and of two writers that
start from one version the second gets ``VersionConflict``.

Searching a snapshot equals searching an index that was built anew from the documents alive in it: term statistics are
sums over the segments' signed counts, and chunks that were replaced or removed are left out. ``merge`` rewrites the live
chunks of small segments as one larger one, so the number of segments stays logarithmic in the number of chunks.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.bounds import is_small
from evidentia.operators import dense, lexical
from evidentia.sources.retrieval import RetrievalIndex

#: Segments of a size class that are merged into one of the next class, and the size that spans one class.
FANOUT = 8
#: Killed documents (two short strings each) that are broadcast; more of them meet the rows in a shuffle.
KILLS = 1_000_000


class VersionConflict(Exception):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Snapshot:
    """What one version consists of: segments (``id``, ``chunks``, ``kills``), and the last batch of each writer."""

    version: int
    segments: tuple[dict, ...] = ()
    applied: dict[str, int] = field(default_factory=dict)
    key_type: str = "string"

    @property
    def ids(self) -> list[str]:
        return [s["id"] for s in self.segments]


# ---- committed versions -----------------------------------------------------
def _files(spark: SparkSession, path: str):
    """Hadoop's file contexts reach whatever store Spark reads, and rename without overwriting."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    return hadoop, folder, hadoop.FileContext.getFileContext(folder.toUri(), spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first."""
    hadoop, folder, files = _files(spark, f"{path}/versions")
    if not files.util().exists(folder):
        return []
    names = [s.getPath().getName() for s in files.util().listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def commit(spark: SparkSession, path: str, snapshot: Snapshot) -> Snapshot:
    """Make a version visible, or raise ``VersionConflict`` if there is one of this number."""
    hadoop, folder, files = _files(spark, f"{path}/versions")
    gateway = spark.sparkContext._gateway
    target = hadoop.Path(folder, f"{snapshot.version:012d}.json")
    draft = hadoop.Path(folder, f".{uuid.uuid4().hex}.tmp")
    text = json.dumps({"version": snapshot.version, "segments": snapshot.segments, "applied": snapshot.applied, "key_type": snapshot.key_type})
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    stream = store.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        files.rename(draft, target, gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as error:
        store.delete(draft, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            raise VersionConflict(f"version {snapshot.version} of {path} is committed") from None
        raise
    return snapshot


def create(spark: SparkSession, path: str, key_type: str = "string") -> Snapshot:
    """An empty index whose chunk keys are of ``key_type``."""
    return commit(spark, path, Snapshot(0, key_type=key_type))


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """A committed version, the newest by default."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no version {'' if version is None else version} of {path}")
    n = known[-1] if version is None else version
    [text] = [r.value for r in spark.read.text(f"{path}/versions/{n:012d}.json", wholetext=True).collect()]
    read = json.loads(text)
    return Snapshot(read["version"], tuple(read["segments"]), read["applied"], read["key_type"])


# ---- tables of a snapshot ---------------------------------------------------
_SCHEMAS = {
    "postings": "chunk_id {key}, doc_id string, len int, terms array<string>, tfs array<bigint>, label string, segment string",
    "vectors": "chunk_id {key}, doc_id string, vector array<double>, label string, segment string",
    "counts": "term string, df bigint, total_len bigint, target string",
    "kills": "doc_id string, target string",
    "documents": "doc_id string, chunks bigint, segment string",
}


def _table(spark: SparkSession, path: str, seen: Snapshot, name: str, ids: list[str] | None = None) -> DataFrame:
    """One table over segments; those without rows of it are not read."""
    schema = _SCHEMAS[name].format(key=seen.key_type)
    of = [s["id"] for s in seen.segments if (ids is None or s["id"] in ids) and (name not in ("kills", "documents") or s[name])]
    if not of:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/segments/{i}/{name}" for i in of])


def _alive(spark: SparkSession, path: str, seen: Snapshot, rows: DataFrame) -> DataFrame:
    """Rows (with ``doc_id`` and ``segment``) whose document was not replaced or removed since."""
    killed = sum(s["kills"] for s in seen.segments)
    if not killed:
        return rows
    dead = _table(spark, path, seen, "kills").withColumnRenamed("target", "segment")
    return rows.join(F.broadcast(dead) if killed <= KILLS else dead, ["doc_id", "segment"], "left_anti")


def live_documents(spark: SparkSession, path: str, seen: Snapshot) -> DataFrame:
    """``doc_id``, ``chunks`` and ``segment`` of the documents of a snapshot."""
    return _alive(spark, path, seen, _table(spark, path, seen, "documents"))


def load(spark: SparkSession, path: str, seen: Snapshot | None = None) -> RetrievalIndex:
    """The snapshot as an index for any search; it stays what it is when later versions are committed."""
    seen = seen or snapshot(spark, path)
    current = spark.createDataFrame([(i,) for i in seen.ids], "target string")
    # What was taken from segments that have been merged since is gone with them.
    counts = _table(spark, path, seen, "counts").join(F.broadcast(current), "target", "left_semi").groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("total_len").alias("total_len")).where("df > 0")
    postings, vectors = (_alive(spark, path, seen, _table(spark, path, seen, name)) for name in ("postings", "vectors"))
    return RetrievalIndex(lexical.unfolded(postings.drop("doc_id", "segment")), counts, vectors.drop("doc_id", "segment"))


# ---- writers ----------------------------------------------------------------
def _check_keys(chunks: DataFrame) -> None:
    """Fail on a key that is blank or that two rows bear. Only keys are read."""
    key = F.coalesce(F.col("chunk_id").cast("string"), F.lit(""))
    blank = F.assert_true(F.trim(key) != "", F.lit("incoming chunk without a chunk_id"))
    once = F.assert_true(F.col("n") == 1, F.concat(F.lit("chunk_id occurs twice: "), key))
    chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).agg(F.count(F.when(blank.isNull() & once.isNull(), 1))).collect()


def _written(rows: DataFrame, path: str, name: str) -> DataFrame:
    """The rows as they lie in a table of a segment."""
    rows.write.parquet(f"{path}/{name}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{name}")


def _write_segment(path: str, segment: str, postings: DataFrame, vectors: DataFrame, documents: DataFrame, kills: DataFrame, taken: DataFrame | None) -> dict:
    """Write the tables of a segment but its kills, which the caller has written; returns its line of the manifest."""
    folder, own = f"{path}/segments/{segment}", F.lit(segment)
    stored = _written(postings.withColumn("segment", own), folder, "postings")
    counts = lexical.term_counts(lexical.unfolded(stored.select("len", "terms", "tfs"))).withColumn("target", own)
    counts = _written(counts if taken is None else counts.unionByName(taken), folder, "counts")
    _written(vectors.withColumn("segment", own), folder, "vectors")
    documents = _written(documents.withColumn("segment", own), folder, "documents")
    chunks = counts.where((F.col("term") == "") & (F.col("target") == segment)).agg(F.sum("df")).first()[0]
    return {"id": segment, "chunks": chunks or 0, "kills": kills.count(), "documents": documents.count()}


def publish(path: str, chunks: DataFrame, documents: DataFrame | None = None, label: str | None = None, writer: str = "", batch: int | None = None,
            base: Snapshot | None = None) -> Snapshot:
    """Commit the next version: the documents of ``chunks(chunk_id, doc_id, text[, label])`` replace what was there of them.

    ``documents`` names all documents of the batch; those without a chunk are removed. A ``batch`` that this ``writer``
    has committed before changes nothing, so a replay is harmless. ``base`` is the version the caller has read, the newest by
    default; if another one was committed meanwhile, ``VersionConflict`` is raised and the version stays as it is.
    """
    spark = chunks.sparkSession
    base = base or snapshot(spark, path)
    if batch is not None and base.applied.get(writer, -1) >= batch:
        return base
    segment = f"{base.version + 1:012d}-{uuid.uuid4().hex[:8]}"
    given = chunks.select(
        F.col("chunk_id").cast(base.key_type).alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "text",
        (F.col(label) if label else F.lit(None).cast("string")).alias("label"))
    named = given.select("doc_id") if documents is None else given.select("doc_id").unionByName(documents.select(F.col("doc_id").cast("string")))
    named = named.distinct()
    _check_keys(given)
    kills = live_documents(spark, path, base).join(named, "doc_id", "left_semi").select("doc_id", F.col("segment").alias("target"))
    kills = spark.createDataFrame([], _SCHEMAS["kills"]) if not base.segments else kills
    kills = _written(kills, f"{path}/segments/{segment}", "kills")
    taken = None
    if base.segments:
        # A row per chunk meets the kills; only the terms of chunks that go are unfolded.
        hit = F.broadcast(kills) if is_small(kills, KILLS) else kills
        gone = _table(spark, path, base, "postings").join(hit.withColumnRenamed("target", "segment"), ["doc_id", "segment"], "left_semi")
        gone = lexical.unfolded(gone.select("segment", "len", "terms", "tfs"))
        taken = gone.groupBy("term", F.col("segment").alias("target")).agg((-F.count("tf")).alias("df"), (-F.sum("len")).alias("total_len"))
        taken = taken.select("term", "df", "total_len", "target")
    owners = given.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    written = _write_segment(
        path, segment, lexical.counted(given, {"doc_id": "doc_id", "label": "label"}).select("chunk_id", "doc_id", "len", "terms", "tfs", "label"),
        dense.embed(given).select("chunk_id", "doc_id", "vector", "label"), owners, kills, taken)
    applied = base.applied if batch is None else {**base.applied, writer: batch}
    return commit(spark, path, Snapshot(base.version + 1, (*base.segments, written), applied, base.key_type))


def remove(path: str, doc_ids: DataFrame, **options) -> Snapshot:
    """Commit a version without these documents; unknown ones are harmless."""
    spark = doc_ids.sparkSession
    key = snapshot(spark, path).key_type
    none = spark.createDataFrame([], f"chunk_id {key}, doc_id string, text string")
    return publish(path, none, doc_ids.select("doc_id"), **options)


def _size_class(chunks: int) -> int:
    size = 0
    while chunks >= FANOUT:
        chunks //= FANOUT
        size += 1
    return size


def due(seen: Snapshot) -> list[str]:
    """Segments that the policy merges next: ``FANOUT`` or more of the smallest size class that has so many."""
    classes: dict[int, list[str]] = {}
    for s in seen.segments:
        classes.setdefault(_size_class(s["chunks"]), []).append(s["id"])
    return next((ids for _, ids in sorted(classes.items()) if len(ids) >= FANOUT), [])


def merge(spark: SparkSession, path: str, ids: list[str] | None = None, base: Snapshot | None = None) -> Snapshot:
    """Rewrite the live chunks of some segments (those that are ``due`` by default) as one and commit that."""
    base = base or snapshot(spark, path)
    ids = due(base) if ids is None else ids
    if not ids:
        return base
    segment = f"{base.version + 1:012d}-{uuid.uuid4().hex[:8]}"
    live = {n: _alive(spark, path, base, _table(spark, path, base, n, ids)).drop("segment") for n in ("postings", "vectors", "documents")}
    others = [i for i in base.ids if i not in ids]
    target = spark.createDataFrame([(i,) for i in others], "target string")
    kills = _table(spark, path, base, "kills", ids).join(F.broadcast(target), "target", "left_semi")
    taken = _table(spark, path, base, "counts", ids).join(F.broadcast(target), "target", "left_semi")
    kills = _written(kills, f"{path}/segments/{segment}", "kills")
    written = _write_segment(path, segment, live["postings"], live["vectors"], live["documents"], kills, taken)
    kept = [s for s in base.segments if s["id"] in others]
    return commit(spark, path, Snapshot(base.version + 1, (*kept, written), base.applied, base.key_type))
