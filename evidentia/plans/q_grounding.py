"""Registered queries: claims, grounding rules, citations, conflicts and confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions.bounds import spread_by, unroll
from evidentia import params as P
from evidentia.functions import text as X
from evidentia.operators import grounding as V
from evidentia.plans import sqltext as S
from evidentia.plans.registry import query, shared

CIT = S.q(P.CITATION)
KEYS = ["report_id", "pos"]

_AT = "coalesce(" + ", ".join(f"nullif(instr(lower(answer), {S.q(m)}), 0)" for m in P.INFERENCE_MARKERS) + ")"
_CITES = f"regexp_matches(s, {CIT})"
_W = "PARTITION BY report_id, pos, kind ORDER BY i"
shared("o_claims", rf"""
    WITH h AS (SELECT report_id, pos, 'claim' AS kind, CASE WHEN {_AT} IS NULL THEN answer ELSE left(answer, {_AT} - 1) END AS x FROM answers
               UNION ALL SELECT report_id, pos, 'inference', CASE WHEN {_AT} IS NULL THEN '' ELSE substr(answer, {_AT}) END FROM answers),
    l AS (SELECT report_id, pos, kind, i, trim(ls[i]) AS s FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, string_split(x, chr(10)) AS ls FROM h))),
    c AS (SELECT *, s = '' AS blank, regexp_matches(s, '^(#|\||---|\*\*\*|===)') AS struc, regexp_matches(s, {S.q(P.PLACEHOLDER)}) AS slot, {_CITES} AS cites,
            s LIKE '%"' AS qe, regexp_matches(s, '^["'']') AND NOT {_CITES} AS qs FROM l),
    e AS (SELECT *, CASE WHEN blank THEN 0 WHEN struc THEN NULL WHEN slot THEN 1 WHEN cites THEN 0 WHEN qs AND NOT qe THEN 1 WHEN qs THEN NULL WHEN qe THEN 0 END AS const,
            CASE WHEN NOT (blank OR struc OR slot OR cites) AND qs AND qe THEN 1 ELSE 0 END AS flip FROM c),
    f AS (SELECT *, sum(flip) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS flips FROM e),
    g AS (SELECT *, coalesce(last_value(const IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
            coalesce(last_value(CASE WHEN const IS NOT NULL THEN flips END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f0 FROM f),
    k AS (SELECT *, (c0 + (flips - flip) - f0) % 2 = 1 AS inside FROM g),
    p AS (SELECT report_id, pos, kind, i, trim(regexp_replace(regexp_replace(s, '^[-*+]\s+', ''), '^\d+[.)]\s+', '')) AS s FROM k
          WHERE NOT blank AND NOT struc AND NOT slot AND CASE WHEN inside THEN cites ELSE NOT qs END),
    q AS (SELECT * FROM p WHERE length(s) >= 25 AND NOT (s LIKE '%:' AND NOT {_CITES}) AND NOT (length(s) < 90 AND NOT regexp_matches(s, '[.!?]$') AND NOT contains(s, '['))
            AND NOT regexp_full_match(s, '\*\*[^*]{{0,80}}\*\*:?')),
    t AS (SELECT report_id, pos, kind, i, j, trim(ps[j]) AS text FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS j FROM (
            SELECT *, string_split(regexp_replace(s, '([.!?])\s+([A-Z*\-#\[])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM q)))
    SELECT report_id, pos, kind, row_number() OVER (PARTITION BY report_id, pos, kind ORDER BY i, j) - 1 AS claim_no, text FROM t WHERE length(text) >= 25""")
shared("o_support", f"""
    SELECT c.*, EXISTS (SELECT 1 FROM evidence e WHERE e.report_id = c.report_id AND list_contains(regexp_extract_all(c.text, {CIT}, 1), e.citation_id)) AS supported
    FROM o_claims c WHERE kind = 'claim'""")
shared("o_ground", """
    SELECT a.report_id, a.pos, count(s.text) AS total, CAST(count(*) FILTER (supported) AS BIGINT) AS supported,
      CASE WHEN count(s.text) = 0 THEN 100 ELSE CAST(round_even(100.0 * count(*) FILTER (supported) / count(s.text), 0) AS BIGINT) END AS groundedness
    FROM answers a LEFT JOIN o_support s USING (report_id, pos) GROUP BY ALL""")
shared("o_rule1", "SELECT report_id, pos, 1 AS number, total = supported AS passed, supported || '/' || total || ' factual sentences carry a resolving marker' AS detail FROM o_ground")
_HEDGED = S.any_contains("lower(answer)", P.HEDGE_TERMS)
shared("o_rule2", f"""
    SELECT report_id, pos, 2 AS number, coalesce(m, 0) = 0 OR {_HEDGED} AS passed,
      CASE WHEN coalesce(m, 0) = 0 THEN 'no multi-cause record retrieved; rule not engaged' ELSE m || ' multi-cause record(s) retrieved; answer ' ||
        CASE WHEN {_HEDGED} THEN 'presents them as hypotheses' ELSE 'ASSERTS a cause without hedging' END END AS detail
    FROM answers LEFT JOIN (SELECT report_id, count(*) AS m FROM evidence WHERE {S.any_contains("lower(content)", P.MULTI_CAUSE_PHRASES)} GROUP BY report_id) USING (report_id)""")
shared("o_rule3", f"""
    WITH m AS (SELECT report_id, pos, claim_no, unnest(ms) AS id, unnest(range(1, len(ms) + 1)) AS at_no FROM (SELECT *, regexp_extract_all(text, {CIT}, 1) AS ms FROM o_claims WHERE kind = 'claim')),
    g AS (SELECT m.report_id, pos, claim_no, record_type, min(at_no) AS at_no, list(id ORDER BY id) AS ids FROM m JOIN evidence e ON e.report_id = m.report_id AND e.citation_id = m.id
          WHERE record_type IN {S.in_list(P.MERGE_SENSITIVE)} GROUP BY ALL HAVING count(*) > 1),
    n AS (SELECT report_id, pos, count(*) AS n, arg_min(ids, claim_no * 1000 + at_no) AS ids FROM g GROUP BY ALL)
    SELECT report_id, pos, 3 AS number, true AS passed, CASE WHEN n IS NULL THEN 'no sentence blends same-type records' ELSE 'review: ' || n ||
      ' sentence(s) cite multiple same-type records ([''' || array_to_string(ids, ''', ''') || '''] in one sentence)' END AS detail FROM answers LEFT JOIN n USING (report_id, pos)""")
_D = "CAST(record_date AS DATE)"
_NEAR = rf"'(?i)\b' || day({_D}) || '\s+(?:' || strftime({_D}, '%B') || '|' || strftime({_D}, '%b') || ')\b|\b(?:' || strftime({_D}, '%B') || '|' || strftime({_D}, '%b') || ')\s+' || day({_D}) || '\b'"
_PRESENT = rf"(contains(answer, record_date) OR (contains(answer, left(record_date, 4)) AND regexp_matches(answer, {_NEAR})) OR regexp_matches(answer, '\b' || replace(record_date, '-', '[-/]') || '\b'))"
shared("o_rule4", f"""
    WITH e AS (SELECT a.report_id, a.pos, list_contains(regexp_extract_all(answer, {CIT}, 1), citation_id) AS cited, {_PRESENT} AS present
               FROM answers a JOIN evidence USING (report_id) WHERE record_date IS NOT NULL),
    s AS (SELECT report_id, pos, count(*) AS dated, count(*) FILTER (cited) AS cited, count(*) FILTER (cited AND present) AS good FROM e GROUP BY ALL)
    SELECT report_id, pos, 4 AS number, coalesce(good = cited, true) AS passed, CASE WHEN dated IS NULL THEN 'no dated record retrieved; rule not engaged'
      WHEN cited = 0 THEN 'no dated record was cited' ELSE good || '/' || cited || ' cited dated record(s) carry their date in the answer' END AS detail
    FROM answers LEFT JOIN s USING (report_id, pos)""")
_FLAGS, _DISC = S.any_contains("lower(answer)", P.RED_FLAG_TERMS), S.any_contains("lower(answer)", P.DISCLAIMER_TERMS)
shared("o_rule5", f"""
    WITH h AS (SELECT DISTINCT a.report_id, a.pos, true AS engaged FROM answers a JOIN evidence USING (report_id)
               WHERE record_type = 'health' AND list_contains(regexp_extract_all(answer, {CIT}, 1), citation_id))
    SELECT report_id, pos, 5 AS number, engaged IS NULL OR ({_FLAGS} AND {_DISC}) AS passed, CASE WHEN engaged IS NULL THEN 'no MED-* record cited; rule not engaged'
      WHEN {_FLAGS} AND {_DISC} THEN 'both present' ELSE 'MISSING: ' || concat_ws(', ', CASE WHEN NOT {_FLAGS} THEN 'red flags' END, CASE WHEN NOT {_DISC} THEN 'fiction disclaimer' END) END AS detail
    FROM answers LEFT JOIN h USING (report_id, pos)""")
_SAYS = f"contains(lower(answer), {S.q(P.ABSENCE_PHRASE)})"
shared("o_rule6", f"""
    SELECT report_id, pos, 6 AS number, sufficient OR {_SAYS} AS passed, CASE WHEN sufficient THEN 'evidence was sufficient; rule not engaged' WHEN {_SAYS} THEN 'insufficiency stated explicitly'
      ELSE 'evidence was insufficient but the answer did not say so' END AS detail FROM answers""")
_OK7 = f"({S.any_contains('lower(answer)', P.CONFLICT_TERMS)} AND len(list_filter(ids, lambda x: NOT contains(lower(answer), lower(x)))) = 0)"
shared("o_disputed", "SELECT report_id, list(citation_id ORDER BY rnk) AS ids, string_agg(content, ' ' ORDER BY rnk) AS joined FROM evidence WHERE evidence_quality = 'disputed report' GROUP BY report_id HAVING count(*) >= 2")
shared("o_rule7", f"""
    SELECT report_id, pos, 7 AS number, ids IS NULL OR {_OK7} AS passed, CASE WHEN ids IS NULL THEN 'no conflicting records retrieved; rule not engaged'
      ELSE 'conflict across [''' || array_to_string(ids, ''', ''') || ''']' || CASE WHEN {_OK7} THEN ' surfaced with its limitation' ELSE ' was NOT fully presented' END END AS detail
    FROM answers LEFT JOIN o_disputed USING (report_id)""")
shared("o_rule8", f"""
    SELECT a.report_id, a.pos, 8 AS number, true AS passed, CASE WHEN {S.any_contains('lower(any_value(answer))', P.INFERENCE_MARKERS)} THEN 'inference block present (' || count(c.text) || ' sentence(s))'
      ELSE 'no inference offered; every statement is attributed to a record' END AS detail
    FROM answers a LEFT JOIN (SELECT * FROM o_claims WHERE kind = 'inference') c USING (report_id, pos) GROUP BY ALL""")
shared("o_rules", " UNION ALL ".join(f"SELECT * FROM o_rule{i}" for i in range(1, 9)))


def answers(t):
    return spread_by(t("answers"), "report_id")


def gates(t):
    return V.gate(answers(t), t("evidence"), KEYS)


def one_rule(n: int):
    def plan(t):
        return V.rule_rows(gates(t), KEYS).where(F.col("number") == n).select(*KEYS, "number", "passed", "detail")

    return plan


@query("v1_claim_split", "SELECT * FROM o_claims")
def v1(t):
    return V.claims(answers(t), KEYS)


for _n, _name in enumerate(
        ["v2_rule_citations", "v3_rule_hypotheses", "v4_rule_no_merging", "v5_rule_time_and_place", "v6_rule_health",
         "v7_rule_absence", "v8_rule_conflicts", "v9_rule_documented"], 1):
    query(_name, f"SELECT * FROM o_rule{_n}")(one_rule(_n))


@query("v10_gate", "SELECT report_id, pos, total AS claim_count, supported AS supported_claim_count, groundedness, n AS rules_passed FROM o_ground JOIN (SELECT report_id, pos, CAST(count(*) FILTER (passed) AS BIGINT) AS n FROM o_rules GROUP BY ALL) USING (report_id, pos)")
def v10(t):
    return gates(t).withColumn("rules_passed", F.size(F.filter("rules", lambda r: r["passed"]))).drop("rules", "unsupported")


@query("g6_claim_counts", """
    SELECT report_id, CAST(sum(total) AS BIGINT) AS claims, CAST(sum(supported) AS BIGINT) AS supported, CAST(sum(total - supported) AS BIGINT) AS unsupported, min(groundedness) AS lowest FROM o_ground GROUP BY report_id""")
def g6(t):
    return gates(t).groupBy("report_id").agg(
        F.sum("claim_count").alias("claims"), F.sum("supported_claim_count").alias("supported"),
        F.sum(F.size("unsupported")).alias("unsupported"), F.min("groundedness").alias("lowest"))


shared("o_merged", "SELECT report_id, number, bool_and(passed) AS passed, arg_min(detail, (CASE WHEN passed THEN 100 ELSE 0 END) + (CASE WHEN passed AND contains(detail, 'not engaged') THEN 10 ELSE 0 END) + pos) AS detail FROM o_rules GROUP BY ALL")


@query("g5_merge_rules", "SELECT * FROM o_merged")
def g5(t):
    return V.merge_rules(V.rule_rows(gates(t), KEYS)).drop("name")


shared("o_gmean", "SELECT report_id, CAST(round_even(avg(groundedness), 0) AS BIGINT) AS groundedness FROM o_ground GROUP BY report_id")


@query("g5_merge_groundedness", "SELECT g.report_id, g.groundedness, coalesce(u, '') AS unsupported FROM o_gmean g LEFT JOIN (SELECT report_id, string_agg(text, ' | ' ORDER BY pos, claim_no) AS u FROM o_support WHERE NOT supported GROUP BY report_id) USING (report_id)")
def g5_mean(t):
    return V.merge_groundedness(gates(t)).select("report_id", "groundedness", F.array_join("unsupported", " | ").alias("unsupported"))


shared("o_mentions", f"SELECT report_id, pos, unnest(ms) AS citation_id, unnest(range(0, len(ms))) AS marker_no FROM (SELECT report_id, pos, regexp_extract_all(answer, {CIT}, 1) AS ms FROM answers)")
shared("o_cited", """
    SELECT e.*, row_number() OVER (PARTITION BY e.report_id ORDER BY f) AS marker FROM evidence e
    JOIN (SELECT report_id, citation_id, min(pos * 1000 + marker_no) AS f FROM o_mentions GROUP BY ALL) USING (report_id, citation_id)""")


@query("j1_resolve_markers", "SELECT report_id, citation_id, chunk_id, rnk FROM o_cited")
def j1(t):
    return V.resolve_citations(t("answers"), t("evidence")).select("report_id", "citation_id", "chunk_id", "rnk")


@query("w11_citation_order", "SELECT report_id, marker, citation_id FROM o_cited")
def w11(t):
    return V.resolve_citations(t("answers"), t("evidence")).select("report_id", "marker", "citation_id")


@query("j6_invented_citations", "SELECT report_id, pos, citation_id, marker_no FROM o_mentions m WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.report_id = m.report_id AND e.citation_id = m.citation_id)")
def j6(t):
    return V.invented_citations(t("answers"), t("evidence"), KEYS)


@query("j6_supported_answers", "SELECT DISTINCT report_id, pos FROM o_mentions m WHERE EXISTS (SELECT 1 FROM evidence e WHERE e.report_id = m.report_id AND e.citation_id = m.citation_id)")
def j6_semi(t):
    marks = V.cited_markers(t("answers"), KEYS)
    return marks.join(t("evidence").select("report_id", "citation_id"), ["report_id", "citation_id"], "left_semi").select(*KEYS).distinct()


def _limit(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({x}), {S.q(n)}) THEN {S.q(v)}" for n, v in P.LIMITATIONS) + f" ELSE {S.q(P.DEFAULT_LIMITATION)} END"


shared("o_conflicts", f"SELECT report_id, array_to_string(ids, ',') AS record_ids, {_limit('joined')} AS reliability_limitation FROM o_disputed")


@query("g7_conflicts", "SELECT * FROM o_conflicts")
def g7(t):
    return V.conflicts(t("evidence")).select("report_id", F.array_join("record_ids", ",").alias("record_ids"), "reliability_limitation")


@query("g7_conflict_positions", f"""
    SELECT report_id, citation_id AS record_id, {S.excerpt('content', 200)} AS claim, {_limit('content')} AS reliability_limitation
    FROM evidence JOIN o_disputed USING (report_id) WHERE evidence_quality = 'disputed report'""")
def g7_positions(t):
    return unroll(V.conflicts(t("evidence")), ["report_id"], "positions", "p").select("report_id", "p.*")


@query("g8_unique_conflicts", "SELECT report_id, array_to_string(list_sort(ids), ',') AS id_set FROM o_disputed")
def g8(t):
    found = V.conflicts(t("evidence"))
    per_section = found.join(t("answers").select(*KEYS), "report_id")
    return V.unique_conflicts(per_section).select("report_id", "id_set")


shared("o_scores", "SELECT *, greatest(0, least(1, coalesce(rerank_score, score * 30))) AS shown FROM evidence")


@query("f14_display_score", "SELECT report_id, rnk, round(shown, 9) AS shown FROM o_scores")
def f14(t):
    return t("evidence").select("report_id", "rnk", F.round(display_score(F.col("score"), F.col("rerank_score")), 9).alias("shown"))


def display_score(score, reranked):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(reranked, score * 30)))


shared("o_facts", """
    SELECT g.report_id, groundedness, top10, coalesce(n, 0) AS sources, d.report_id IS NOT NULL AS conflicted
    FROM o_gmean g JOIN (SELECT report_id, round(max(shown) * 10, 9) AS top10 FROM o_scores GROUP BY report_id) USING (report_id)
    LEFT JOIN (SELECT report_id, count(*) AS n FROM o_cited GROUP BY report_id) USING (report_id) LEFT JOIN o_disputed d USING (report_id)""")
shared("o_conf", """
    SELECT report_id, CASE WHEN sources = 0 THEN 'insufficient' WHEN groundedness >= 90 AND top10 >= 7.5 AND sources >= 3 AND NOT conflicted THEN 'high'
        WHEN conflicted OR groundedness >= 70 THEN 'moderate' WHEN groundedness >= 40 THEN 'low' ELSE 'insufficient' END AS level,
      CASE WHEN sources = 0 THEN 'no record scored above the relevance threshold' WHEN groundedness >= 90 AND top10 >= 7.5 AND sources >= 3 AND NOT conflicted THEN 'High — ' || sources || ' sources, groundedness ' || groundedness || '%, no conflicts'
        WHEN conflicted THEN 'Moderate — ' || sources || ' sources, 1 unresolved conflict, chain of custody incomplete' WHEN groundedness >= 70 THEN 'Moderate — ' || sources || ' sources, groundedness ' || groundedness || '%'
        WHEN groundedness >= 40 THEN 'Low — ' || sources || ' sources, groundedness ' || groundedness || '%' ELSE 'no record scored above the relevance threshold' END AS reason FROM o_facts""")


def report_facts(t, checked=None):
    """Groundedness, best display score of ten, cited sources and conflict per report."""
    evidence = t("evidence")
    ground = V.merge_groundedness(gates(t) if checked is None else checked).select("report_id", "groundedness")
    top = evidence.groupBy("report_id").agg(F.round(F.max(display_score(F.col("score"), F.col("rerank_score"))) * 10, 9).alias("top10"))
    sources = V.resolve_citations(t("answers"), evidence).groupBy("report_id").agg(F.count("*").alias("sources"))
    marks = V.conflicts(evidence).select("report_id", F.lit(True).alias("conflicted"))
    return ground.join(top, "report_id").join(sources, "report_id", "left").join(marks, "report_id", "left").fillna(
        {"sources": 0, "conflicted": False})


@query("g9_confidence", "SELECT * FROM o_conf")
def g9(t):
    level, reason = V.confidence(F.col("groundedness"), F.col("top10"), F.col("sources"), F.col("conflicted"))
    return report_facts(t).select("report_id", level.alias("level"), reason.alias("reason"))


@query("g10_simple_confidence", """
    WITH f AS (SELECT e.report_id, max(shown) AS top, count(c.citation_id) AS n, CAST(count(*) FILTER (c.citation_id IS NOT NULL AND e.evidence_quality = 'disputed report') AS BIGINT) AS bad
               FROM o_scores e LEFT JOIN o_cited c USING (report_id, citation_id) GROUP BY e.report_id)
    SELECT report_id, n AS cited, bad AS disputed, CASE WHEN n = 0 THEN 'insufficient' WHEN bad > 0 THEN 'moderate' WHEN n >= 3 AND top >= 0.55 THEN 'high' WHEN n >= 2 THEN 'moderate' ELSE 'low' END AS level FROM f""")
def g10(t):
    cited = V.resolve_citations(t("answers"), t("evidence")).select("report_id", "citation_id", F.lit(True).alias("cited"))
    rows = t("evidence").join(cited, ["report_id", "citation_id"], "left")
    hit = F.col("cited").isNotNull()
    facts = rows.groupBy("report_id").agg(
        F.max(display_score(F.col("score"), F.col("rerank_score"))).alias("top"), F.count_if(hit).alias("cited"),
        F.count_if(hit & (F.col("evidence_quality") == "disputed report")).alias("disputed"))
    return facts.select("report_id", "cited", "disputed", V.simple_confidence(F.col("cited"), F.col("top"), F.col("disputed")).alias("level"))


@query("w15_better_attempt", "SELECT report_id, arg_max(pos, groundedness * 10 - pos) AS attempt, max(groundedness) AS groundedness FROM o_ground GROUP BY report_id")
def w15(t):
    tries = gates(t).withColumnRenamed("pos", "attempt")
    best = F.max_by(F.struct("attempt", "groundedness"), F.struct("groundedness", -F.col("attempt")))
    return tries.groupBy("report_id").agg(best.alias("b")).select("report_id", "b.*")


@query("f19_date_present", f"SELECT a.report_id, pos, rnk, {_PRESENT} AS present FROM answers a JOIN evidence USING (report_id) WHERE record_date IS NOT NULL")
def f19(t):
    pairs = t("answers").join(t("evidence").where("record_date IS NOT NULL"), "report_id")
    return pairs.select("report_id", "pos", "rnk", X.date_present(F.col("record_date"), F.col("answer")).alias("present"))


@query("f13_excerpt", f"SELECT report_id, rnk, {S.excerpt('content', 320)} AS e320, {S.excerpt('content', 240)} AS e240, {S.excerpt('content', 60)} AS e60 FROM evidence")
def f13(t):
    return t("evidence").select("report_id", "rnk", *[X.excerpt(F.col("content"), n).alias(f"e{n}") for n in (320, 240, 60)])


@query("f15_citation_key", "SELECT report_id, rnk, citation_id FROM evidence")
def f15(t):
    from pyspark.sql import Window

    w = Window.partitionBy("report_id").orderBy("rnk").rowsBetween(Window.unboundedPreceding, 0)
    key = F.coalesce("record_id", F.concat(F.lit("SEC-"), F.count_if(F.col("record_id").isNull()).over(w).cast("string")))
    return t("evidence").select("report_id", "rnk", key.alias("citation_id"))


@query("f35_context_block", f"""
    SELECT report_id, string_agg('───── BEGIN RECORD ' || citation_id || ' ─────' || chr(10) || concat_ws(' | ', 'cite as: [' || citation_id || ']', 'type: ' || record_type, 'title: ' || nullif(title, ''),
      'chapter: ' || chapter, 'region: ' || region_id, 'date: ' || record_date, 'evidence quality: ' || evidence_quality, 'risk level: ' || risk_level) || chr(10) || chr(10) ||
      regexp_replace(content, '^\\s+|\\s+$', '', 'g') || chr(10) || '───── END RECORD ' || citation_id || ' ─────', chr(10) || chr(10) ORDER BY rnk) AS context FROM evidence GROUP BY report_id""")
def f35(t):
    def tagged(name, col):
        return F.when(F.col(col) != "", F.concat(F.lit(f"{name}: "), col))

    meta = F.concat_ws(
        " | ", F.concat(F.lit("cite as: ["), "citation_id", F.lit("]")), tagged("type", "record_type"), tagged("title", "title"),
        tagged("chapter", "chapter"), tagged("region", "region_id"), tagged("date", "record_date"),
        tagged("evidence quality", "evidence_quality"), tagged("risk level", "risk_level"))
    rule = F.lit("─────")
    block = F.concat(rule, F.lit(" BEGIN RECORD "), "citation_id", F.lit(" "), rule, F.lit("\n"), meta, F.lit("\n\n"),
                     F.regexp_replace("content", r"^\s+|\s+$", ""), F.lit("\n"), rule, F.lit(" END RECORD "), "citation_id", F.lit(" "), rule)
    return t("evidence").select("report_id", "rnk", block.alias("block")).groupBy("report_id").agg(
        F.expr("listagg(block, '\n\n') within group (order by rnk)").alias("context"))


@query("u3_pooled_evidence", "SELECT report_id, chunk_id, min(pos) AS first_section FROM answers JOIN evidence USING (report_id) GROUP BY ALL")
def u3(t):
    pooled = t("answers").select(*KEYS).join(t("evidence"), "report_id")
    return V.first_per(pooled, ["report_id", "chunk_id"], [F.asc("pos"), F.asc("rnk")]).select("report_id", "chunk_id", F.col("pos").alias("first_section"))


@query("w13_closest_matches", "SELECT report_id, string_agg(citation_id || ' (' || printf('%.3f', round(shown, 3)) || ')', '; ' ORDER BY r) AS closest FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY shown DESC, rnk) AS r FROM o_scores) WHERE r <= 3 GROUP BY report_id")
def w13(t):
    return closest_matches(t("evidence"))


def closest_matches(evidence):
    """The three best matches by display score, as one text per report."""
    rows = evidence.withColumn("shown", display_score(F.col("score"), F.col("rerank_score")))
    best = V.first_three(rows)
    item = F.concat("citation_id", F.lit(" ("), F.format_string("%.3f", F.round("shown", 3)), F.lit(")"))
    return best.select("report_id", "r", item.alias("item")).groupBy("report_id").agg(
        F.expr("listagg(item, '; ') within group (order by r)").alias("closest"))
