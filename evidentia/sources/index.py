"""The chunk table as an index: projection, upsert, removal and publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.bounds import is_small, top_n
from evidentia.functions.vectors import pack_floats, unpack_floats

INDEX_SCHEMA = (
    "chunk_id STRING, doc_id STRING, doc_name STRING, ordinal BIGINT, content STRING, tokens INT, record_id STRING, record_type STRING, "
    "title STRING, chapter STRING, section STRING, page INT, region_id STRING, evidence_quality STRING, risk_level STRING, record_date STRING, "
    "access_class STRING, navigational BOOLEAN, is_shared BOOLEAN, applies_to ARRAY<STRING>, vector ARRAY<FLOAT>")
#: Rows as they are stored: each belongs to the version in which its document was last published or removed. A vector is
#: stored as bytes without its zeros, as Parquet writes and reads a list number by number.
STORED_SCHEMA = f"{INDEX_SCHEMA.replace('vector ARRAY<FLOAT>', 'vector BINARY')}, deleted BOOLEAN, version BIGINT"


def create_index(spark: SparkSession, path: str) -> None:
    """Create or recreate an empty index with the declared columns."""
    spark.createDataFrame([], STORED_SCHEMA).write.mode("overwrite").partitionBy("version").parquet(path)


def to_index_rows(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vectors, NULL kept as NULL."""
    cols = ["chunk_id", "doc_id", "content", "title", "record_id", "record_type", "chapter", "section", "page", "region_id",
            "evidence_quality", "risk_level", "record_date"]
    return chunks.select(*[c for c in cols if c in chunks.columns]).join(vectors, "chunk_id")


def latest_version(rows: DataFrame, key: str = "chunk_id", version: str = "version") -> DataFrame:
    return top_n(rows, [key], [F.desc(version)], 1, "__newest").drop("__newest")


def upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace current ones with the same ``chunk_id``."""
    both = current.withColumn("version", F.lit(0)).unionByName(incoming.withColumn("version", F.lit(1)), allowMissingColumns=True)
    return latest_version(both).drop("version")


def rejected_keys(rows: DataFrame) -> DataFrame:
    return rows.where("chunk_id IS NULL OR trim(chunk_id) = ''")


def remove_documents(current: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return current.join(doc_ids, "doc_id", "left_anti")


def removed_counts(current: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Chunks to go per requested document; zero for an unknown one, so a repeat is harmless."""
    gone = current.groupBy("doc_id").agg(F.count("*").alias("removed"))
    return doc_ids.join(gone, "doc_id", "left").select("doc_id", F.coalesce("removed", F.lit(0)).alias("removed"))


def _packed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vector", pack_floats()(F.col("vector"))) if "vector" in rows.columns else rows


def _append(rows: DataFrame, path: str, version: int) -> DataFrame:
    """Write one version of its own; the files of others are not touched, and a replay replaces just this one."""
    stamped = _packed(rows).withColumn("version", F.lit(version).cast("bigint"))
    stamped.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)
    return _stored(rows.sparkSession, path).where(F.col("version") == version)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; vectors are unpacked only where they are asked for."""
    return spark.read.schema(STORED_SCHEMA).parquet(path).withColumn("vector", unpack_floats()(F.col("vector")))


def publish(path: str, incoming: DataFrame, version: int, documents: DataFrame | None = None) -> DataFrame:
    """Append the incoming documents to the index at ``path`` as one version; returns the rows that arrived.

    From then on the documents read as published here, whatever older versions hold. ``documents`` names all documents
    of the batch; those without a chunk get a tombstone, so that older chunks of theirs are no longer read. Versions
    rise from batch to batch, as a stream's batch IDs do; writers of different versions do not disturb each other.
    """
    blank = F.trim(F.coalesce("chunk_id", F.lit(""))) == ""
    checked = F.when(F.assert_true(~blank, F.lit("incoming row without a chunk_id")).isNull(), F.col("chunk_id"))
    rows = incoming.withColumn("chunk_id", checked).withColumn("deleted", F.lit(False))
    if documents is not None:
        empty = documents.select("doc_id").distinct().join(incoming.select("doc_id").distinct(), "doc_id", "left_anti")
        rows = rows.unionByName(empty.withColumn("deleted", F.lit(True)), allowMissingColumns=True)
    return _append(rows, path, version).where(~F.col("deleted"))


def retract(path: str, doc_ids: DataFrame, version: int) -> None:
    """Append tombstones: the documents are no longer read."""
    _append(doc_ids.select("doc_id").distinct().withColumn("deleted", F.lit(True)), path, version)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The rows of each document's newest version.

    Only documents with several versions need a join. While these are few they are broadcast, so that texts and vectors
    are read where they lie and not shuffled.
    """
    rows = _stored(spark, path).where(F.col("doc_id").isNotNull())
    spans = rows.groupBy("doc_id").agg(F.max("version").alias("__newest"), F.min("version").alias("__oldest"))
    replaced = spans.where(F.col("__oldest") < F.col("__newest")).select("doc_id", "__newest")
    hinted = F.broadcast(replaced) if is_small(replaced) else replaced
    current = rows.join(hinted, "doc_id", "left").where(F.col("__newest").isNull() | (F.col("version") == F.col("__newest")))
    return current.where(~F.coalesce("deleted", F.lit(False))).drop("version", "deleted", "__newest")


def compact(spark: SparkSession, path: str, target: str, version: int) -> None:
    """Write what is read from ``path`` to a new index of one version; readers change over when it is complete."""
    _packed(read_index(spark, path)).withColumn("deleted", F.lit(False)).withColumn("version", F.lit(version).cast("bigint")).hint(
        "rebalance").write.option("compression", "zstd").partitionBy("version").parquet(target)


def append_history(rows: DataFrame, path: str) -> None:
    """Append answers or trace rows."""
    rows.write.mode("append").parquet(path)
