"""Registered queries: filtered retrieval, the gate before it, and the composed second arm."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia import params as P
from evidentia.operators import retrieve as RT
from evidentia.plans.q_retrieval import _ALLOW_SPARK, _ALLOW_SQL, _ALLOWED, _FIRST, _WEIGHT, _asked, _retrieval_ctes, clearance, final_sql, greedy_ctes, mmr_ctes, stored, units
from evidentia.plans.registry import query, shared

_FILTERS = ("(allowed IS NULL OR list_contains(allowed, record_type)) AND (regions IS NULL OR list_contains(regions, region_id)) "
            "AND (records IS NULL OR list_contains(records, record_id))")
_REGIONS = "CASE WHEN item_id % 4 = 1 THEN {} WHEN item_id % 4 = 2 THEN {} END"
_REGIONS_SQL = _REGIONS.format("['REG-01', 'REG-02', 'REG-03']", "['REG-04', 'REG-06', 'REG-09', 'REG-10']")
_REGIONS_SPARK = _REGIONS.format("array('REG-01', 'REG-02', 'REG-03')", "array('REG-04', 'REG-06', 'REG-09', 'REG-10')")
_RECORDS = "CASE WHEN item_id % 8 = 0 THEN {} END"
_RECORDS_SQL, _RECORDS_SPARK = _RECORDS.format("['INC-8', 'FAU-9', 'POL-11', 'KC-12', 'INC-999999']"), _RECORDS.format("array('INC-8', 'FAU-9', 'POL-11', 'KC-12', 'INC-999999')")
_NO_RECORDS = "CAST(NULL AS VARCHAR[])"


def filtered_questions(t):
    return t("benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.expr(_ALLOW_SPARK).alias("record_types"), F.expr(_REGIONS_SPARK).alias("region_ids"),
        F.expr(_RECORDS_SPARK).alias("record_ids"))


_retrieval_ctes("w", f"""
    SELECT item_id || '#0' AS query_id, text AS question, {_ALLOW_SQL} AS allowed, {_REGIONS_SQL} AS regions, {_RECORDS_SQL} AS records FROM benchmark
    UNION ALL SELECT item_id || '#1', {_FIRST}, {_ALLOW_SQL}, {_REGIONS_SQL}, {_NO_RECORDS} FROM benchmark WHERE trim({_FIRST}) <> '' AND lower(trim({_FIRST})) <> lower(trim(text))""", 30, _FILTERS)
_TOP = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT CAST(split_part(query_id, '#', 1) AS BIGINT) AS query_id, chunk_id, max(score) AS score FROM {}_cut WHERE rank <= 30 GROUP BY ALL)"


@query("r6_filtered_retrieve", f"SELECT query_id, chunk_id, score, rank, record_type, region_id FROM ({_TOP.format('w')}) JOIN d_meta USING (chunk_id) WHERE rank <= 6")
def r6_filtered(t):
    """Questions filtered by record type, region and record inside both arms."""
    out = RT.retrieve(stored(t), units(t), filtered_questions(t), _asked(t)[1])
    return out.join(t("doc_chunks").select("chunk_id", "region_id"), "chunk_id").select("query_id", "chunk_id", "score", "rank", "record_type", "region_id")


# The floor that parts these questions; its default belongs to other vectors.
_FLOOR = 0.4


@query("p9_gated_retrieve", f"""
    WITH g AS (SELECT item_id AS query_id, coalesce(top, 0) >= {_FLOOR} AS covered FROM benchmark LEFT JOIN (SELECT query_id, max(score) AS top FROM d_dense GROUP BY query_id) d ON d.query_id = item_id)
    SELECT query_id, chunk_id, score, rank, false AS refused FROM ({_TOP.format('v')}) SEMI JOIN (SELECT query_id FROM g WHERE covered) USING (query_id) WHERE rank <= 6
    UNION ALL SELECT query_id, NULL, NULL, NULL, true FROM g WHERE NOT covered""")
def p9_gated(t):
    """Refused questions are not searched; each leaves one row."""
    queries, variants = _asked(t)
    found, refused = RT.retrieve_covered(stored(t), units(t), queries, variants, floor=_FLOOR)
    rows = found.select("query_id", "chunk_id", "score", "rank", F.lit(False).alias("refused"))
    return rows.unionByName(refused.select("query_id", F.lit(True).alias("refused")), allowMissingColumns=True)


# ---- the second arm, from the question to the final list ------------------------
_LAST = "split_part(text, '.', 2)"
_SIDES = "item_id % 2 = 0 AND trim({}) <> ''".format(_LAST)
# A question of two sides is a comparison; any other is asked in two phrasings.
_retrieval_ctes("a", f"""
    SELECT item_id || '#' || aspect || '#' || n AS query_id, question, CAST(NULL AS VARCHAR[]) AS allowed, {_REGIONS_SQL} AS regions, {_NO_RECORDS} AS records FROM (
      SELECT item_id, 1 AS aspect, 0 AS n, {_FIRST} AS question FROM benchmark WHERE {_SIDES} UNION ALL SELECT item_id, 2, 0, {_LAST} FROM benchmark WHERE {_SIDES}
      UNION ALL SELECT item_id, 1, 0, text FROM benchmark WHERE NOT ({_SIDES}) UNION ALL SELECT item_id, 1, 1, {_FIRST} FROM benchmark WHERE NOT ({_SIDES}))""", 40, _FILTERS)
shared("a_fused", """
    SELECT CAST(split_part(query_id, '#', 1) AS BIGINT) AS query_id, CAST(split_part(query_id, '#', 2) AS INTEGER) AS aspect, chunk_id, sum(1.0 / (60 + rank)) AS rrf,
      min(rank) FILTER (arm = 'l') AS lexical_rank, min(rank) FILTER (arm = 'd') AS dense_rank
    FROM (SELECT query_id, chunk_id, rank, 'l' AS arm FROM a_lex UNION ALL SELECT query_id, chunk_id, rank, 'd' FROM a_den) GROUP BY ALL""")
shared("a_ranked", f"""
    WITH w AS (
      SELECT f.*, round(rrf * CAST({_WEIGHT} AS DOUBLE), 9) AS weighted FROM a_fused f JOIN d_meta USING (chunk_id) JOIN doc_queries USING (query_id) WHERE {_ALLOWED}),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, aspect ORDER BY weighted DESC, chunk_id) AS rank FROM w) WHERE rank <= 40),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, aspect) AS one FROM l) WHERE one = 1)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, aspect) AS place FROM b) WHERE place <= 40""")
shared("a_sims", """
    WITH v AS (SELECT query_id, place, bucket, wt FROM a_ranked JOIN d_vec ON id = chunk_id)
    SELECT query_id, a.place, b.place AS other, sum(a.wt * b.wt) AS sim FROM v a JOIN v b USING (query_id, bucket) WHERE a.place <> b.place GROUP BY ALL""")
greedy_ctes("a", "a_ranked", "a_sims")
shared("a_all", "SELECT query_id, place, weighted / max(weighted) OVER (PARTITION BY query_id) AS rel FROM a_ranked")
shared("a_rel", "SELECT * FROM a_all SEMI JOIN a_kept USING (query_id, place)")
mmr_ctes("a", "a_rel", "a_sims")


def composed(t):
    both = F.expr(_SIDES)
    slot = lambda aspect, n, text: F.struct(F.lit(aspect).alias("aspect"), F.lit(n).alias("n"), F.expr(text).alias("question"))
    aspects = t("benchmark").select(F.col("item_id").alias("query_id"), F.explode(
        F.when(both, F.array(slot(1, 0, _FIRST), slot(2, 0, _LAST))).otherwise(F.array(slot(1, 0, "text"), slot(1, 1, _FIRST)))).alias("s")).select("query_id", "s.*")
    regions = filtered_questions(t).select("query_id", "region_ids")
    queries = t("doc_queries").select("query_id", "triage").join(regions, "query_id")
    pool = RT.aspect_pool(stored(t), units(t), queries, aspects, clearance(t))
    return RT.diversified(pool, stored(t).vectors.select("chunk_id", "vector"), units(t), clearance(t))


@query("r7_composed_retrieve", f"""
    SELECT f.* EXCLUDE (matched_by), concat_ws('+', nullif(matched_by, ''), CASE WHEN matched_by <> '' AND {_REGIONS_SQL} IS NOT NULL THEN 'metadata' END) AS matched_by
    FROM ({final_sql("a", "a_ranked", "a_all")}) f JOIN benchmark ON item_id = query_id""")
def r7_composed(t):
    """Aspects or phrasings searched under filters, fused, cleared, weighted, interleaved, thinned, diversified, completed."""
    out = composed(t)
    return out.select("query_id", "chunk_id", "pick", F.round("relative", 6).alias("relative"), "added", F.array_join("matched_by", "+").alias("matched_by"))
