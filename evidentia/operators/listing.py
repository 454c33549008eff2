"""Filters and paged listings over chunk, document and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metadata_filter(chunks: DataFrame, record_types=None, region_ids=None, record_ids=None, doc_ids=None) -> DataFrame:
    """AND over the given fields, OR inside each; plain ``isin`` so the scan can prune."""
    out = chunks
    for col, values in (("record_type", record_types), ("region_id", region_ids), ("record_id", record_ids), ("doc_id", doc_ids)):
        if values:
            out = out.where(F.col(col).isin(list(values)))
    return out


def page_of(rows: DataFrame, order: list[Column], skip: int, top: int) -> DataFrame:
    """A page in a total order. Offset and limit run as a bounded take per partition, not a full sort in one task."""
    return rows.orderBy(*order).offset(skip).limit(top)


def with_total(page: DataFrame, rows: DataFrame) -> DataFrame:
    """Add the unpaged row count, computed as a separate partial aggregate."""
    return page.withColumn("total", rows.agg(F.count("*").alias("total")).scalar())


def visible_to(documents: DataFrame, user: Column | str) -> DataFrame:
    return documents.where((F.col("user_id") == user) | F.col("is_preloaded"))


def deletable(documents: DataFrame) -> DataFrame:
    """Every document with the reason that keeps it from deletion, NULL where none does."""
    reason = F.when(F.col("is_preloaded"), F.lit("preloaded")).when(F.col("status").isin("pending", "indexing"), F.lit("in flight"))
    return documents.withColumn("blocked_by", reason)


def upload_problem(name: Column, size: Column, limit: int) -> Column:
    return (
        F.when(F.coalesce(F.trim(name), F.lit("")) == "", F.lit("blank name")).when(size <= 0, F.lit("empty body"))
        .when(size > limit, F.lit("too large")))


def widen_starved(filtered: DataFrame, unfiltered, minimum: int = 2, key: str = "query_id") -> DataFrame:
    """Per query: use the unfiltered hits when the filtered ones hold fewer than ``minimum`` records and the others hold more.

    ``unfiltered`` takes the starved query IDs, so the second search runs for those alone.
    """
    counts = filtered.groupBy(key).agg(F.count("record_id").alias("held"))
    plenty = counts.where(F.col("held") >= minimum).select(key)
    second = unfiltered(plenty)
    more = second.groupBy(key).agg(F.count("record_id").alias("other"))
    swap = more.join(counts, key, "left").where(F.col("other") > F.coalesce("held", F.lit(0))).select(key)
    kept = filtered.join(swap, key, "left_anti").withColumn("widened", F.lit(False))
    return kept.unionByName(second.join(swap, key, "left_semi").withColumn("widened", F.lit(True)))
