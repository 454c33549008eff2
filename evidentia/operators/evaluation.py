"""Corpus checks, calibration and scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia import params as P
from evidentia.functions import text as X


def count_by_type(chunks: DataFrame) -> DataFrame:
    """Chunks per record type, and ``_total``."""
    rows = chunks.rollup("record_type").agg(F.count("*").alias("n"), F.grouping("record_type").alias("g"))
    return rows.select(F.when(F.col("g") == 1, F.lit("_total")).otherwise(F.col("record_type")).alias("record_type"), "n")


def inventory(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected against actual distinct records per type; only the types that differ."""
    actual = chunks.where("record_id IS NOT NULL").groupBy("record_type").agg(F.count_distinct("record_id").alias("actual"))
    rows = expected.join(actual, "record_type", "full_outer")
    return rows.select("record_type", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual")).where(
        "expected <> actual")


def missing_records(chunks: DataFrame, required: DataFrame) -> DataFrame:
    return required.join(chunks, "record_id", "left_anti")


def contaminated(chunks: DataFrame) -> DataFrame:
    """Records whose text opens a line with the bracketed ID of another record."""
    foreign = F.array_except(F.array_distinct(X.find_all(F.col("content"), r"(?m)^\[([A-Z]{2,4}-[A-Z0-9]+)\]", 1)), F.array("record_id"))
    return chunks.where("record_id IS NOT NULL").select("chunk_id", "record_id", foreign.alias("foreign_ids")).where(F.size("foreign_ids") > 0)


def too_short(chunks: DataFrame, minimum: int = 50) -> DataFrame:
    return chunks.where(F.length("content") < minimum).select("chunk_id", F.length("content").alias("chars"))


def health(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.count("record_id").alias("records")).withColumn("indexed", F.col("chunks") > 0)


def document_rollup(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(
        F.max("page").alias("pages"), F.count("*").alias("chunks"), F.count_distinct("record_id").alias("records")).withColumn(
        "status", F.when(F.col("chunks") > 0, F.lit("indexed")).otherwise(F.lit("failed")))


def calibrate_floor(scores: DataFrame, inside: Column) -> DataFrame:
    """Two populations of top similarities: their extremes and the midpoint between them, as one row."""
    inner, outer = F.when(inside, F.col("score")), F.when(~inside, F.col("score"))
    row = scores.agg(
        F.min(inner).alias("in_min"), F.avg(inner).alias("in_mean"), F.max(inner).alias("in_max"),
        F.min(outer).alias("out_min"), F.avg(outer).alias("out_mean"), F.max(outer).alias("out_max"))
    row = row.withColumn("separation", F.col("in_min") - F.col("out_max"))
    return row.withColumn("floor", F.when(F.col("separation") > 0, F.round((F.col("in_min") + F.col("out_max")) / 2, 3)))


def run_variance(trials: DataFrame, key: str, score: str) -> DataFrame:
    rows = trials.groupBy(key).agg(F.min(score).alias("low"), F.max(score).alias("high"), F.avg(score).alias("mean"))
    spread = F.col("high") - F.col("low")
    return rows.withColumn("spread", spread).withColumn("unstable", spread >= P.UNSTABLE_SPREAD)


def gate_hits(answers: DataFrame) -> DataFrame:
    """``cited`` IDs against an expected prefix."""
    return answers.withColumn("hit", F.exists("cited", lambda c: F.startswith(c, F.col("expected_prefix"))))


def gate_summary(hits: DataFrame, key: str, seconds: str, minimum_share: float = 0.8) -> DataFrame:
    """Hits, the pass mark, the upper median and the maximum latency per group.

    The median of an even number of values is the upper one, hence the descending order.
    """
    rows = hits.groupBy(key).agg(
        F.count("*").alias("asked"), F.count_if("hit").alias("hits"), F.max(seconds).alias("slowest"),
        F.expr(f"percentile_disc(0.5) within group (order by {seconds} desc)").alias("median"))
    return rows.withColumn("passed", F.col("hits") >= F.col("asked") * minimum_share)


def scorecard(answer: Column) -> list[Column]:
    """Six criteria on an answer that presents a conflict, and how many are met."""
    low = F.lower(answer)
    criteria = {
        "first_note": low.contains("fn-a"), "second_note": low.contains("fn-b"), "laboratory": low.contains("lab-c"),
        "custody": X.contains_any(low, ["chain of custody", "chain-of-custody"]),
        "no_cause": X.contains_any(low, ["not confirmed", "no confirmed", "cannot be confirmed", "remain possible", "not established"]),
        "sampling": low.contains("sampl"),
    }
    met = sum((c.cast("int") for c in criteria.values()), F.lit(0))
    return [c.alias(n) for n, c in criteria.items()] + [met.alias("met")]
