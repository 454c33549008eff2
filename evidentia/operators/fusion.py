"""Rank fusion, weighting, interleaving, diversification and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia import params as P
from evidentia.functions.bounds import first_per, top_n, unroll
from evidentia.functions.labels import retrieval_prior, triage_boost
from evidentia.functions.vectors import dot


def reciprocal_rank_fusion(arms: DataFrame, keys: list[str] | None = None, damping: int = P.RRF_K) -> DataFrame:
    """Fuse ranked rows ``(keys, chunk_id, arm, rank, score)``; several variants may rank a chunk in one arm."""
    keys = keys or ["query_id"]

    def of(arm: str, value: str) -> Column:
        return F.when(F.col("arm") == arm, F.col(value))

    return arms.groupBy(*keys, "chunk_id").agg(
        F.sum(1.0 / (damping + F.col("rank"))).alias("rrf"),
        F.min(of("lexical", "rank")).alias("lexical_rank"),
        F.min(of("dense", "rank")).alias("dense_rank"),
        F.max(of("lexical", "score")).alias("lexical_score"),
        F.max(of("dense", "score")).alias("dense_score"),
    )


def union_arms(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    cols = [c for c in lexical.columns if c in dense.columns]
    return lexical.select(*cols, F.lit("lexical").alias("arm")).unionByName(
        dense.select(*cols, F.lit("dense").alias("arm")))


def weigh(fused: DataFrame, triage: Column | None = None) -> DataFrame:
    """Multiply by the prior of the record family and, for triage questions, by severity.

    Expects ``record_type``, ``navigational`` and ``severity`` beside ``rrf``.
    """
    weight = retrieval_prior(F.col("record_type"), F.col("navigational"))
    weight = weight * triage_boost(F.col("severity"), triage if triage is not None else F.lit(False))
    return fused.withColumn("weighted", F.round(F.col("rrf") * weight, 9))


def interleave(ranked: DataFrame, n: int = P.CANDIDATES) -> DataFrame:
    """Round-robin over aspects: by (rank, aspect), the first place of a chunk wins."""
    best = first_per(ranked, ["query_id", "chunk_id"], [F.asc("rank"), F.asc("aspect")])
    return top_n(best, ["query_id"], [F.asc("rank"), F.asc("aspect")], n, "place")


def _pool(candidates: DataFrame, cols: list[str]) -> DataFrame:
    """Candidates of a query as one ordered array. The pool is bounded by the rank cut before it."""
    return candidates.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "chunk_id", *cols))).alias("pool"))


def closest_earlier(candidates: DataFrame) -> DataFrame:
    """For each candidate the highest cosine to any candidate placed before it in its query."""
    pool = _pool(candidates, ["vector"])
    rows = F.transform(
        "pool",
        lambda c, i: F.struct(
            c["chunk_id"].alias("chunk_id"), c["place"].alias("place"),
            F.array_max(F.transform(F.slice("pool", F.lit(1), i), lambda e: dot(e["vector"], c["vector"]))).alias("similarity")))
    return unroll(pool, ["query_id"], rows, "r").select("query_id", "r.*")


def drop_near_duplicates(candidates: DataFrame, threshold: float = P.NEAR_DUPLICATE) -> DataFrame:
    """Greedy by place: drop a candidate whose cosine to any kept one exceeds the threshold."""
    pool = _pool(candidates, ["vector"])
    row_type = "array<" + dict(pool.dtypes)["pool"][6:-1] + ">"
    kept = F.aggregate(
        "pool", F.array().cast(row_type),
        lambda acc, c: F.when(F.exists(acc, lambda k: dot(k["vector"], c["vector"]) > threshold), acc)
        .otherwise(F.concat(acc, F.array(c))))
    places = unroll(pool, ["query_id"], F.transform(kept, lambda k: k["chunk_id"]), "chunk_id")
    return candidates.join(places, ["query_id", "chunk_id"], "left_semi")


def diversify(candidates: DataFrame, k: int = P.FINAL_K, trade: float = P.MMR_LAMBDA) -> DataFrame:
    """Maximal marginal relevance. Groups hold one query's pool, bounded by the rank cut.

    Expects ``query_id, chunk_id, place, relevance, vector``; returns the picks in order.
    """
    id_type = candidates.schema["query_id"].dataType.simpleString()
    chunk_type = candidates.schema["chunk_id"].dataType.simpleString()

    def pick(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("place", kind="stable")
        vectors = np.array(pdf["vector"].tolist(), dtype=float)
        relevance = pdf["relevance"].to_numpy(dtype=float)
        worst = np.zeros(len(pdf))
        free = np.ones(len(pdf), dtype=bool)
        chosen = []
        for _ in range(min(k, len(pdf))):
            gain = np.where(free, np.round(trade * relevance - (1 - trade) * worst, 9), -np.inf)
            i = int(np.argmax(gain))
            chosen.append(i)
            free[i] = False
            worst = np.maximum(worst, vectors @ vectors[i])
        return pd.DataFrame({
            "query_id": pdf["query_id"].to_numpy()[chosen], "chunk_id": pdf["chunk_id"].to_numpy()[chosen],
            "pick": np.arange(1, len(chosen) + 1), "relevance": relevance[chosen]})

    return candidates.select("query_id", "chunk_id", "place", "relevance", "vector").groupBy("query_id").applyInPandas(
        pick, f"query_id {id_type}, chunk_id {chunk_type}, pick int, relevance double")


def complete_clusters(selected: DataFrame, chunks: DataFrame, cleared: DataFrame, kind: str = "field_note",
                      factor: float = P.CLUSTER_FACTOR) -> DataFrame:
    """Siblings (same section and type) of selected chunks that are not selected themselves and may be seen.

    ``selected`` has ``query_id, chunk_id, pick, relevance``; the trigger is the earliest pick. ``cleared`` has the
    ``access_class`` values that each ``query_id`` may see.
    """
    cards = chunks.where(F.col("record_type") == kind).select("chunk_id", "section", "access_class")
    triggers = selected.join(cards, "chunk_id")
    groups = triggers.groupBy("query_id", "section").agg(F.min_by("relevance", "pick").alias("trigger_relevance"))
    siblings = groups.join(cards, "section").join(cleared, ["query_id", "access_class"], "left_semi")
    return siblings.join(selected, ["query_id", "chunk_id"], "left_anti").select(
        "query_id", "chunk_id", (F.col("trigger_relevance") * factor).alias("relevance"))


def normalise(rows: DataFrame, score: str = "relevance") -> DataFrame:
    """Scale by the best score of the query, at most one; name the arms, and the filter (``in_region``), that found the row."""
    region = F.coalesce(F.col("in_region"), F.lit(False)) if "in_region" in rows.columns else F.lit(False)
    top = F.max(score).over(Window.partitionBy("query_id"))
    return rows.withColumn("relative", F.when(top > 0, F.least(F.lit(1.0), F.col(score) / top)).otherwise(F.lit(0.0))).withColumn(
        "matched_by", F.array_compact(F.array(
            F.when(F.col("lexical_rank").isNotNull(), F.lit("lexical")),
            F.when(F.col("dense_rank").isNotNull(), F.lit("dense")), F.when(region, F.lit("metadata")))))


def best_per_chunk(rows: DataFrame, score: str = "score") -> DataFrame:
    return first_per(rows, ["query_id", "chunk_id"], [F.desc(score)])


def rerank(candidates: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Order by an outside score table: scored rows first, ties by the fused score."""
    joined = candidates.join(scores, ["query_id", "chunk_id"], "left")
    return top_n(joined, ["query_id"],
                 [F.desc(F.coalesce("rerank_score", F.lit(-1.0))), F.desc("score"), F.asc("chunk_id")], k)
