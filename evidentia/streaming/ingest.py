"""Incremental ingest: encoded documents arrive as files, chunks and statuses leave as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import labels as L
from evidentia.functions import text as X
from evidentia.functions.bounds import unroll
from evidentia.functions.durable import durable
from evidentia.operators.dense import embed
from evidentia.sources import segments
from evidentia.sources.documents import decoded
from evidentia.sources.index import append_history, publish

Chunker = Callable[[DataFrame], DataFrame]


def window_chunks(docs: DataFrame, paragraph: str = "\n") -> DataFrame:
    """Default chunker: labelled windows of each document, with a key that depends on content position only."""
    rows = unroll(docs, ["doc_id"], X.pack_paragraphs(F.col("text"), paragraph=paragraph), "content", "ordinal")
    return rows.select(
        F.concat_ws("#", "doc_id", "ordinal").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("ordinal").cast("bigint"),
        "content", F.lit("narrative").alias("record_type"), L.region_earliest(F.col("content")).alias("region_id"),
        L.evidence_quality(F.lit("narrative"), F.col("content")).alias("evidence_quality"))


def split_failed(docs: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Readable documents and failed ones with the reason; one bad document never stops the others."""
    rows = decoded(docs, payload)
    # One test of the text, as a filter decodes the payload each time it names it.
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    error = F.when(F.col("text").isNull(), F.lit("payload is not valid base64")).otherwise(F.lit("no text extracted"))
    return rows.where(~blank), rows.where(blank).select("doc_id", error.alias("error"))


def ingest_batch(docs: DataFrame, batch_id: int, index_path: str, status_path: str, chunker: Chunker = window_chunks) -> None:
    """Chunk, label, embed and publish one batch, then record each document's outcome.

    Chunk keys are deterministic and the batch is one version of the index, so a
    replayed batch changes nothing in it; statuses carry the batch id.
    """
    good, bad = split_failed(docs)
    rows = embed(chunker(good), "content", single=True)
    arrived = publish(index_path, rows, batch_id)
    counts = arrived.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    done = counts.select("doc_id", F.lit("indexed").alias("status"), "chunks", F.lit(None).cast("string").alias("error"))
    failed = bad.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("failed").alias("status"), F.lit(0).cast("bigint").alias("chunks"), "error")
    append_history(done.unionByName(failed).withColumn("batch_id", F.lit(batch_id)), status_path)


def latest_status(spark: SparkSession, status_path: str) -> DataFrame:
    """Outcome per document; a replayed batch counts once."""
    return spark.read.parquet(status_path).groupBy("doc_id").agg(
        F.max_by(F.struct("status", "chunks", "error"), "batch_id").alias("s")).select("doc_id", "s.*")


def run_available(stream: DataFrame, checkpoint: str, index_path: str, status_path: str, chunker: Chunker = window_chunks) -> None:
    """Ingest all that is there, then stop; a restart goes on from the checkpoint."""
    query = (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: ingest_batch(batch, batch_id, index_path, status_path, chunker)).start())
    query.awaitTermination()


def whole_documents(docs: DataFrame) -> DataFrame:
    """A chunker that keeps each document in one chunk, under the document's ID."""
    key = F.col("doc_id").cast("string")
    return docs.select(key.alias("chunk_id"), key.alias("doc_id"), F.col("text").alias("content"))


def ingest_live(docs: DataFrame, batch_id: int, index_path: str, status_path: str, chunker: Chunker = window_chunks, label: str | None = None,
                writer: str = "ingest") -> None:
    """One batch into the live index (``sources.segments``): what is committed here is what the next search reads.

    A replayed batch finds itself applied and commits nothing. Documents that cannot be read keep what was indexed of them
    before. Segments that are due are merged after the batch.
    """
    good, bad = split_failed(docs)
    rows = durable(chunker(good))
    segments.publish(index_path, rows.withColumnRenamed("content", "text"), good.select("doc_id"), label, writer, batch_id)
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    arrived = good.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().join(counts, "doc_id", "left").fillna(0, ["chunks"])
    done = arrived.select("doc_id", F.lit("indexed").alias("status"), "chunks", F.lit(None).cast("string").alias("error"))
    failed = bad.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("failed").alias("status"), F.lit(0).cast("bigint").alias("chunks"), "error")
    append_history(done.unionByName(failed).withColumn("batch_id", F.lit(batch_id)), status_path)
    segments.merge(docs.sparkSession, index_path)


def run_live(stream: DataFrame, checkpoint: str, index_path: str, status_path: str, chunker: Chunker = window_chunks, label: str | None = None) -> None:
    """Ingest all that is there into the live index, then stop; a restart goes on from the checkpoint."""
    query = (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: ingest_live(batch, batch_id, index_path, status_path, chunker, label)).start())
    query.awaitTermination()
