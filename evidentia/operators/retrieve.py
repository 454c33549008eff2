"""Retrieval composed of the lexical, dense and fusion operators.

Units are ``chunk_id, text, record_type, record_id``; queries are ``query_id, question``
with an optional ``allowed`` array of record types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia import params as P
from evidentia.functions.bounds import is_small, top_n
from evidentia.functions.durable import durable
from evidentia.operators import fusion
from evidentia.operators.listing import widen_starved
from evidentia.sources.retrieval import RetrievalIndex, search_dense, search_lexical


def hybrid(index: RetrievalIndex, queries: DataFrame, k: int = P.CANDIDATES, filtered: bool = False) -> DataFrame:
    """Both arms over the stored index, cut to ``k`` per query, fused by reciprocal rank.

    If ``filtered``, a query's ``allowed`` array (NULL for no filter) restricts the labels of its chunks.
    """
    lex = search_lexical(index, queries, k, filtered).drop("n_matched")
    return fusion.reciprocal_rank_fusion(fusion.union_arms(lex, search_dense(index, queries, k, filtered)))


def cut(fused: DataFrame, k: int) -> DataFrame:
    ranked = fused.select("query_id", "chunk_id", F.round("rrf", 9).alias("score"))
    return top_n(ranked, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def phrasings(queries: DataFrame, variants: DataFrame) -> DataFrame:
    """Question and variants as rows keyed by phrasing; blank and repeated phrasings are skipped.

    Variants share the filters of their question but that by record: they widen a search for a named record.
    """
    filters = [c for c in P.FILTERS if c in queries.columns]
    own = queries.select("query_id", F.lit(0).alias("n"), "question", *filters)
    shared = [F.lit(None).cast("array<string>").alias(c) if c == "record_ids" else c for c in filters]
    more = variants.join(queries.select("query_id", *filters), "query_id").select("query_id", "n", F.col("variant").alias("question"), *shared)
    rows = own.unionByName(more).where(F.trim("question") != "")
    first = Window.partitionBy("query_id", F.lower(F.trim("question"))).orderBy("n")
    rows = rows.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    return rows.select(F.concat_ws("#", "query_id", "n").alias("phrasing_id"), "query_id", "question", *filters)


def citation_keys(ranked: DataFrame) -> DataFrame:
    """Record ID, else ``SEC-n`` counted in rank order inside a query."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    nth = F.count_if(F.coalesce("record_id", F.lit("")) == "").over(w).cast("string")
    return ranked.withColumn("citation_id", F.coalesce(F.nullif("record_id", F.lit("")), F.concat(F.lit("SEC-"), nth)))


def retrieve(index: RetrievalIndex, units: DataFrame, queries: DataFrame, variants: DataFrame, k: int = P.FINAL_K,
             depth: int = P.SEARCH_CANDIDATES, scores: DataFrame | None = None) -> DataFrame:
    """Every phrasing searched, best score per chunk, the best ``depth`` reranked if scores are given, cut to ``k``, citation keys."""
    asked = phrasings(queries, variants)
    by_phrasing = asked.drop("query_id").withColumnRenamed("phrasing_id", "query_id")
    hits = cut(hybrid(index, by_phrasing, depth, True), depth).withColumnRenamed("query_id", "phrasing_id")
    pooled = hits.join(asked.select("phrasing_id", "query_id"), "phrasing_id").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    if scores is None:
        ranked = top_n(pooled, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)
    else:
        deep = top_n(pooled, ["query_id"], [F.desc("score"), F.asc("chunk_id")], depth).drop("rank")
        ranked = fusion.rerank(deep, scores, k)
    # Content columns join back only after the cut.
    return citation_keys(ranked.join(units.select("chunk_id", "record_id", "record_type"), "chunk_id"))


def coverage(index: RetrievalIndex, queries: DataFrame, floor: float = P.RELEVANCE_FLOOR) -> DataFrame:
    """``query_id``, ``top_similarity`` and ``covered``: whether the corpus has anything near the question at all.

    A question without a word, or an empty corpus, has a similarity of 0.
    """
    best = search_dense(index, queries, P.FLOOR_TOP).groupBy("query_id").agg(F.max("score").alias("top"))
    top = F.coalesce("top", F.lit(0.0))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", top.alias("top_similarity"), (top >= floor).alias("covered"))


def retrieve_covered(index: RetrievalIndex, units: DataFrame, queries: DataFrame, variants: DataFrame, floor: float = P.RELEVANCE_FLOOR,
                     **options) -> tuple[DataFrame, DataFrame]:
    """Retrieval for questions that the corpus covers, and the refused ones with their best similarity.

    Refused questions are not searched. One row a question decides, which is kept.
    """
    judged = durable(coverage(index, queries, floor))
    asked = queries.join(judged.where("covered"), "query_id", "left_semi")
    told = variants.join(judged.where("covered"), "query_id", "left_semi")
    return retrieve(index, units, asked, told, **options), judged.where("NOT covered").drop("covered")


def aspect_pool(index: RetrievalIndex, units: DataFrame, queries: DataFrame, aspects: DataFrame, cleared: DataFrame, n: int = P.CANDIDATES) -> DataFrame:
    """Candidates of each question in ``place`` order: every aspect searched and fused, cleared, weighted, interleaved.

    ``aspects`` has ``query_id, aspect, n, question``: several aspects for a comparison, of which each keeps its share, or
    several phrasings ``n`` of the one aspect, which are fused. ``queries`` has ``triage`` and the question's filters;
    ``cleared`` the access classes that each question may see. ``in_region`` marks chunks of a region that was asked for.
    """
    key = F.concat_ws("#", "query_id", "aspect", "n")
    asked = aspects.join(queries.select("query_id", *[c for c in P.FILTERS if c in queries.columns]), "query_id").withColumn("key", key)
    by_key = asked.drop("query_id", "aspect", "n").withColumnRenamed("key", "query_id")
    arms = fusion.union_arms(search_lexical(index, by_key, n, True).drop("n_matched"), search_dense(index, by_key, n, True))
    ranked = arms.withColumnRenamed("query_id", "key").join(asked.select("key", "query_id", "aspect"), "key").drop("key")
    fused = fusion.reciprocal_rank_fusion(ranked, ["query_id", "aspect"])
    facts = units.select("chunk_id", "record_type", "navigational", "severity", "access_class", "region_id")
    seen = fused.join(facts, "chunk_id").join(cleared, ["query_id", "access_class"], "left_semi").join(queries.select("query_id", "triage"), "query_id")
    weighted = fusion.weigh(seen, F.col("triage"))
    lists = top_n(weighted, ["query_id", "aspect"], [F.desc("weighted"), F.asc("chunk_id")], n)
    pool = fusion.interleave(lists, n)
    if "region_ids" not in queries.columns:
        return pool
    here = F.array_contains("region_ids", F.col("region_id"))
    return pool.join(queries.select("query_id", "region_ids"), "query_id").withColumn("in_region", F.coalesce(here, F.lit(False))).drop("region_ids")


def profile_queries(queries: DataFrame) -> DataFrame:
    """One row per question and section profile: focus words appended, the profile's types allowed."""
    slots = F.array(*[
        F.struct(F.lit(owner).alias("owner"), F.lit(section).alias("section"), F.array(*[F.lit(x) for x in kinds]).alias("allowed"), F.lit(focus).alias("focus"))
        for owner, section, _, kinds, focus, _ in P.PROFILES])
    rows = queries.select(F.col("query_id").alias("base_id"), "question", F.explode(slots).alias("p"))
    return rows.select(
        F.concat_ws("/", "base_id", "p.section").alias("query_id"), "base_id", "p.section", "p.owner", "p.allowed",
        F.concat_ws(" ", "question", "p.focus").alias("question"))


def retrieve_sections(index: RetrievalIndex, units: DataFrame, queries: DataFrame, k: int = P.FINAL_K, depth: int = P.SEARCH_CANDIDATES) -> DataFrame:
    """Retrieval per question and section; starved sections search again without the type filter."""
    asked = profile_queries(queries)
    facts = units.select("chunk_id", "record_id", "record_type")

    def search(rows: DataFrame, filtered: bool) -> DataFrame:
        return cut(hybrid(index, rows, depth, filtered), k).join(facts, "chunk_id")

    # Bounded by queries x sections x k rows; both branches and the counts read it.
    filtered = durable(search(asked.select("query_id", "question", "allowed"), True))
    out = widen_starved(filtered, lambda plenty: search(asked.select("query_id", "question").join(plenty, "query_id", "left_anti"), False))
    return out.join(asked.select("query_id", "base_id", "section", "owner"), "query_id")


def scale_lookup(index: RetrievalIndex, text: str = P.SCALE_QUERY, k: int = 2) -> DataFrame:
    """The records that state the severity scale: one fixed question over the whole corpus."""
    asked = index.vectors.sparkSession.createDataFrame([("scale", text)], "query_id string, question string")
    return cut(hybrid(index, asked), k)


def with_vectors(pool: DataFrame, vectors: DataFrame) -> DataFrame:
    """Candidates with their vectors. While they are few they go to the vectors, which are read where they lie and not shuffled."""
    places = durable(pool)
    return (F.broadcast(places) if is_small(places) else places).join(vectors, "chunk_id")


def diversified(pool: DataFrame, vectors: DataFrame, units: DataFrame, cleared: DataFrame, k: int = P.FINAL_K) -> DataFrame:
    """From a ranked pool (``place``, ``weighted``) to the final list: near-duplicates out, MMR, sibling notes in, normalised.

    The pool is bounded by the candidate cut; it is checkpointed once because four steps read it.
    """
    top = F.max("weighted").over(Window.partitionBy("query_id"))
    rows = durable(with_vectors(pool.withColumn("relevance", F.col("weighted") / top), vectors))
    kept = fusion.drop_near_duplicates(rows)
    picks = durable(fusion.diversify(kept, k))
    siblings = fusion.complete_clusters(picks, units, cleared)
    # Siblings line up behind the picks, best relevance first.
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), F.asc("chunk_id"))
    added = siblings.withColumn("pick", F.row_number().over(w) + k).withColumn("added", F.lit(True))
    final = picks.withColumn("added", F.lit(False)).unionByName(added.select("query_id", "chunk_id", "pick", "relevance", F.lit(True).alias("added")))
    arms = rows.select("query_id", "chunk_id", "lexical_rank", "dense_rank", *[c for c in ("in_region",) if c in rows.columns])
    return fusion.normalise(final.join(arms, ["query_id", "chunk_id"], "left"))


def retrieval_counts(pool: DataFrame, allowed: DataFrame, kept: DataFrame) -> DataFrame:
    """Per query: withheld chunks, pool size and near-duplicates dropped."""
    held = pool.groupBy("query_id").agg(F.count_if(~F.col("allowed")).alias("withheld"))
    size = allowed.groupBy("query_id").agg(F.count("*").alias("pool"))
    left = kept.groupBy("query_id").agg(F.count("*").alias("kept"))
    return held.join(size, "query_id", "left").join(left, "query_id", "left").fillna(0).withColumn("dropped", F.col("pool") - F.col("kept"))
