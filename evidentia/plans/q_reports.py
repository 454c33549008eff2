"""Registered queries: report assembly, evaluation, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia import params as P
from evidentia.functions import text as X
from evidentia.functions.bounds import spread, unroll
from evidentia.functions.durable import durable
from evidentia.functions import labels as L
from evidentia.operators import evaluation as E
from evidentia.operators import grounding as V
from evidentia.operators import reports as RP
from evidentia.plans import q_grounding as QG
from evidentia.plans import sqltext as S
from evidentia.plans.registry import query, shared
from evidentia.sources import documents as D
from evidentia.sources import index as IX

_LP = "lower(trim({}))"
_CLASS = "CASE lower(trim(priority_class)) WHEN 'w1' THEN 'W1' WHEN 'w2' THEN 'W2' WHEN 'w3' THEN 'W3' WHEN 'w4' THEN 'W4' ELSE 'informational' END"
_CONF = "CASE lower(trim(confidence)) WHEN 'high' THEN 'high' WHEN 'moderate' THEN 'moderate' WHEN 'medium' THEN 'moderate' WHEN 'low' THEN 'low' ELSE 'insufficient' END"
shared("o_priority", f"""
    SELECT report_id, CASE WHEN down THEN 'informational' ELSE cls END AS class, CASE WHEN down THEN 'OBSERVATION' ELSE coalesce(nullif(priority_label, ''), 'OBSERVATION') END AS label,
      coalesce(nullif(priority_reason, ''), CASE WHEN down THEN 'Severity could not be attributed to a corpus record.' ELSE '' END) AS reason, CASE WHEN NOT down THEN cit END AS citation
    FROM (SELECT *, {_CLASS} AS cls, nullif(trim(priority_citation), '') AS cit, {_CLASS} <> 'informational' AND nullif(trim(priority_citation), '') IS NULL AS down FROM reports)""")
_ST = "CASE WHEN lower(trim(status)) IN ('filled', 'empty', 'timed_out', 'not_applicable') THEN lower(trim(status)) ELSE 'empty' END"
def _sections_sql(table: str) -> str:
    return f"""
    SELECT report_id, lower(trim(section_type)) AS section_type, {_ST} AS status,
      CASE WHEN {_ST} = 'filled' THEN NULL ELSE coalesce(nullif(empty_reason, ''), 'No content was produced for this section.') END AS empty_reason, content,
      CASE WHEN lower(trim(owning_agent)) IN {S.in_list(P.OWNING_AGENTS)} THEN lower(trim(owning_agent)) ELSE 'orchestrator' END AS owning_agent, display_order
    FROM {table} WHERE lower(trim(section_type)) IN {S.in_list(P.SECTION_TYPES)}"""


shared("o_sections", _sections_sql("raw_sections"))
shared("o_filed", _sections_sql("filed_sections"))


@query("f21_normalise_labels", f"SELECT report_id, {_CONF} AS confidence, {_CLASS} AS priority_class FROM reports")
def f21(t):
    return t("reports").select("report_id", L.confidence_level(F.col("confidence")).alias("confidence"), L.priority_class(F.col("priority_class")).alias("priority_class"))


@query("f21_section_mapping", "SELECT * FROM o_sections")
def f21_sections(t):
    return RP.map_sections(t("raw_sections")).drop("pos")


@query("f22_priority_downgrade", "SELECT * FROM o_priority")
def f22(t):
    return RP.map_priority(t("reports")).select("report_id", "class", "label", "reason", "citation")


_RAW_ID = "CASE WHEN c_custkey % 4 = 0 THEN 'register' WHEN c_custkey % 4 = 1 THEN '0000000A-0000-4000-8000-' || lpad(CAST(c_custkey AS STRING), 12, '0') ELSE 'D' || c_custkey END"
_FIXED = "00000000-0000-4000-8000-000000000001"
shared("o_ids", f"SELECT c_custkey, CASE WHEN raw = 'register' THEN '{_FIXED}' WHEN regexp_matches(raw, {S.q(P.UUID)}) THEN lower(raw) END AS document_id FROM (SELECT c_custkey, {_RAW_ID} AS raw FROM customer)")


@query("f23_document_id", "SELECT * FROM o_ids")
def f23(t):
    return t("customer").select("c_custkey", RP.resolve_document_id(F.expr(_RAW_ID), "register", _FIXED).alias("document_id"))


@query("f20_iso_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def f20(t):
    return t("events").select("event_id", RP.iso_utc(F.col("ts").cast("timestamp")).alias("at"))


@query("f32_actions", rf"""
    WITH l AS (SELECT report_id, pos, i, trim(ls[i]) AS s FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT report_id, pos, string_split(answer, chr(10)) AS ls FROM answers)))
    SELECT report_id, pos, row_number() OVER (PARTITION BY report_id, pos ORDER BY i) AS step, trim(regexp_replace(regexp_replace(s, '^\d+\.\s*', ''), '\s*\[[^\]]+\]', '', 'g')) AS action,
      nullif(regexp_extract(s, '\[([^\]]+)\]', 1), '') AS citation FROM l WHERE regexp_matches(s, '^\d+\.')""")
def f32(t):
    lines = F.filter(F.transform(F.split("answer", "\n"), lambda s: F.trim(s)), lambda s: s.rlike(r"^\d+\."))
    rows = unroll(t("answers"), ["report_id", "pos"], lines, "s", "i")
    action = F.trim(F.regexp_replace(F.regexp_replace("s", r"^\d+\.\s*", ""), r"\s*\[[^\]]+\]", ""))
    return rows.select("report_id", "pos", (F.col("i") + 1).alias("step"), action.alias("action"), X.group(F.col("s"), r"\[([^\]]+)\]", 1).alias("citation"))


_CARD = r"\*\*([A-Z]{2,4}-[A-Z0-9]+)\s*([^*]*)\*\*\s*[—-]?\s*([^*]*)"


@query("f32_species_cards", rf"""
    WITH c AS (SELECT report_id, pos, unnest(regexp_extract_all(answer, {S.q(_CARD)}, 0)) AS card FROM answers)
    SELECT report_id, pos, regexp_extract(card, {S.q(_CARD)}, 1) AS id, coalesce(nullif(trim(regexp_extract(card, {S.q(_CARD)}, 2)), ''), regexp_extract(card, {S.q(_CARD)}, 1)) AS name,
      left(trim(regexp_replace(regexp_extract(card, {S.q(_CARD)}, 3), '^\s+|\s+$', '', 'g')), 220) AS pressure FROM c""")
def f32_species(t):
    cards = unroll(t("answers"), ["report_id", "pos"], X.find_all(F.col("answer"), _CARD, 0), "card")
    g = lambda i: F.regexp_extract("card", _CARD, i)
    return cards.select(
        "report_id", "pos", g(1).alias("id"), F.coalesce(X.non_empty(F.trim(g(2))), g(1)).alias("name"),
        F.substring(F.regexp_replace(g(3), r"^\s+|\s+$", ""), 1, 220).alias("pressure"))


@query("f32_causes", r"""
    WITH b AS (SELECT report_id, pos, list_filter(list_transform(string_split_regex(answer, '\n{2,}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1:6] AS bs FROM answers),
    r AS (SELECT report_id, pos, i - 1 AS block_no, bs[i] AS block FROM (SELECT *, unnest(range(1, len(bs) + 1)) AS i FROM b))
    SELECT report_id, pos, block_no, regexp_replace(coalesce(nullif(regexp_extract(block, '\*\*([^*]+)\*\*', 1), ''), 'Finding'), '[.:]$', '') AS term,
      nullif(regexp_extract(block, '\[([A-Z]{2,4}-[A-Z0-9]+)', 1), '') AS record_id, length(regexp_replace(regexp_replace(block, '\*\*', '', 'g'), '\s*\[[^\]]+\]', '', 'g')) AS chars FROM r""")
def f32_causes(t):
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    blocks = F.slice(F.filter(F.transform(F.split("answer", r"\n{2,}"), strip), lambda b: b != ""), 1, 6)
    rows = unroll(t("answers"), ["report_id", "pos"], blocks, "block", "block_no")
    term = F.regexp_replace(F.coalesce(X.group(F.col("block"), r"\*\*([^*]+)\*\*", 1), F.lit("Finding")), "[.:]$", "")
    detail = F.regexp_replace(F.regexp_replace("block", r"\*\*", ""), r"\s*\[[^\]]+\]", "")
    return rows.select("report_id", "pos", "block_no", term.alias("term"), X.group(F.col("block"), r"\[([A-Z]{2,4}-[A-Z0-9]+)", 1).alias("record_id"), F.length(detail).alias("chars"))


@query("f33_source_cards", """
    SELECT report_id, rnk, citation_id AS id, concat_ws(' · ', nullif(chapter, ''), 'p.' || page) AS ref, CAST(floor(shown * 100 + 0.5) AS BIGINT) AS relevance FROM o_scores""")
def f33(t):
    shown = QG.display_score(F.col("score"), F.col("rerank_score"))
    return t("evidence").select(
        "report_id", "rnk", F.col("citation_id").alias("id"), F.concat_ws(" · ", X.non_empty(F.col("chapter")), F.concat(F.lit("p."), "page")).alias("ref"),
        F.floor(shown * 100 + 0.5).alias("relevance"))


shared("o_complete", """
    SELECT r.report_id, s.section_type, s.display_order, coalesce(o.status, 'not_applicable') AS status, CASE WHEN o.status IS NULL THEN 'Not applicable to this query' ELSE o.empty_reason END AS empty_reason,
      coalesce(o.content, '') AS content, coalesce(o.owning_agent, 'orchestrator') AS owning_agent
    FROM reports r CROSS JOIN (VALUES ('affected_species', 2), ('likely_causes', 3), ('recommended_actions', 4)) s(section_type, display_order)
    LEFT JOIN o_filed o ON o.report_id = r.report_id AND o.section_type = s.section_type""")


def completed(t):
    return RP.complete_sections(t("reports"), RP.map_sections(t("filed_sections")).drop("pos"))


@query("v13_section_completion", "SELECT report_id, section_type, display_order, status, empty_reason, length(content) AS chars, owning_agent FROM o_complete")
def v13(t):
    return completed(t).withColumn("chars", F.length("content")).drop("content")


@query("w14_display_order", "SELECT report_id, string_agg(section_type || '=' || status, ' > ' ORDER BY display_order) AS sections FROM o_complete GROUP BY report_id")
def w14(t):
    rows = completed(t).withColumn("s", F.concat_ws("=", "section_type", "status"))
    return rows.groupBy("report_id").agg(F.expr("listagg(s, ' > ') within group (order by display_order)").alias("sections"))


shared("o_history", """
    SELECT p.report_id, coalesce(nullif(concat_ws(chr(10) || chr(10), CASE WHEN reason <> '' THEN '[' || label || '] ' || reason END, parts), ''), 'No report content was produced.') AS history FROM o_priority p LEFT JOIN (
      SELECT report_id, string_agg(section_type || ': ' || CASE WHEN status = 'filled' AND content <> '' THEN content ELSE empty_reason END, chr(10) || chr(10) ORDER BY display_order) AS parts FROM o_sections GROUP BY report_id) USING (report_id)""")


@query("f34_flatten_history", "SELECT * FROM o_history")
def f34_history(t):
    return RP.flatten_history(RP.map_priority(t("reports")), RP.map_sections(t("raw_sections")))


@query("v15_degraded_comparison", "SELECT report_id, string_agg('### ' || section_type || chr(10) || chr(10) || answer, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS text FROM answers GROUP BY report_id")
def v15(t):
    return RP.degraded_comparison(t("answers"), "section_type", "answer")


shared("o_filled", "SELECT report_id, CAST(count(*) FILTER (status = 'filled') AS BIGINT) AS filled, bool_or(status = 'timed_out') AS partial FROM o_complete GROUP BY report_id")
shared("o_verdict", """
    SELECT report_id, NOT (top10 < 4.5 OR groundedness = 0 OR sources = 0 OR filled = 0) AS sufficient, groundedness, top10, sources, conflicted, filled, partial FROM o_facts JOIN o_filled USING (report_id)""")


def verdict(t, checked=None):
    """Report facts, filled sections and the sufficiency decision."""
    filled = completed(t).groupBy("report_id").agg(F.count_if(F.col("status") == "filled").alias("filled"), F.bool_or(F.col("status") == "timed_out").alias("partial"))
    facts = QG.report_facts(t, checked).join(filled, "report_id")
    ok = RP.sufficiency(F.col("top10"), F.col("groundedness"), F.lit(3), F.col("sources"), F.col("filled"), 0.45)
    return facts.withColumn("sufficient", ok)


@query("v11_sufficiency", "SELECT report_id, sufficient, filled FROM o_verdict")
def v11(t):
    return verdict(t).select("report_id", "sufficient", "filled")


shared("o_closest", "SELECT report_id, string_agg(citation_id || ' (' || printf('%.3f', round(shown, 3)) || ')', '; ' ORDER BY r) AS closest FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY shown DESC, rnk) AS r FROM o_scores) WHERE r <= 3 GROUP BY report_id")
_SCOPE = "record types: " + ", ".join(sorted({k for p in P.PROFILES for k in p[3]}))


@query("v12_insufficiency_row", f"""
    SELECT report_id, {S.q(P.INSUFFICIENT_MESSAGE)} || chr(10) || chr(10) || 'Searched: {_SCOPE}.' || chr(10) || 'Closest partial matches, below the confidence threshold: ' || closest || '.' || chr(10) || {S.q(P.WHAT_WOULD_RESOLVE)} AS text
    FROM o_verdict JOIN o_closest USING (report_id) WHERE NOT sufficient""")
def v12(t):
    rows = verdict(t).where("NOT sufficient").join(QG.closest_matches(t("evidence")), "report_id")
    text = F.concat(F.lit(f"{P.INSUFFICIENT_MESSAGE}\n\nSearched: {_SCOPE}.\nClosest partial matches, below the confidence threshold: "), "closest", F.lit(f".\n{P.WHAT_WOULD_RESOLVE}"))
    return rows.select("report_id", text.alias("text"))


@query("v14_report_assembly", """
    SELECT v.report_id, p.class AS priority, CASE WHEN sufficient THEN c.level ELSE 'insufficient' END AS confidence, v.groundedness, v.sources, v.conflicted, v.partial, v.sufficient,
      coalesce(regions, '') AS regions, sections, coalesce(rules, 0) AS rules_failed
    FROM o_verdict v JOIN o_priority p USING (report_id) JOIN o_conf c USING (report_id)
    LEFT JOIN (SELECT report_id, string_agg(DISTINCT region_id, ',' ORDER BY region_id) AS regions FROM evidence WHERE region_id IS NOT NULL GROUP BY report_id) USING (report_id)
    JOIN (SELECT report_id, string_agg(status, ',' ORDER BY display_order) AS sections FROM o_complete GROUP BY report_id) USING (report_id)
    LEFT JOIN (SELECT report_id, CAST(count(*) FILTER (NOT passed) AS BIGINT) AS rules FROM o_merged GROUP BY report_id) USING (report_id)""")
def v14(t):
    # One row per answer, read by the verdict and by the rule summary.
    checked = durable(QG.gates(t))
    rows = verdict(t, checked)
    level, _ = V.confidence(F.col("groundedness"), F.col("top10"), F.col("sources"), F.col("conflicted"))
    sections = completed(t).groupBy("report_id").agg(F.expr("listagg(status, ',') within group (order by display_order)").alias("sections"))
    failed = V.merge_rules(V.rule_rows(checked, QG.KEYS)).groupBy("report_id").agg(F.count_if(~F.col("passed")).alias("rules_failed"))
    regions = RP.affected_regions(t("reports").withColumn("given", F.array().cast("array<string>")), t("evidence"), "given")
    out = rows.join(RP.map_priority(t("reports")).select("report_id", F.col("class").alias("priority")), "report_id").join(sections, "report_id").join(
        failed, "report_id", "left").join(regions, "report_id")
    return out.select(
        "report_id", "priority", F.when(F.col("sufficient"), level).otherwise(F.lit("insufficient")).alias("confidence"), "groundedness", "sources", "conflicted",
        "partial", "sufficient", F.array_join("regions", ",").alias("regions"), "sections", F.coalesce("rules_failed", F.lit(0)).alias("rules_failed"))


@query("v14_nested_report", """
    SELECT v.report_id, p.class AS priority, sufficient,
      (SELECT string_agg(display_order || ':' || section_type || ':' || status || ':' || length(content), ';' ORDER BY display_order) FROM o_complete c WHERE c.report_id = v.report_id) AS sections,
      coalesce((SELECT string_agg(marker || ':' || citation_id, ';' ORDER BY marker) FROM o_cited c WHERE c.report_id = v.report_id), '') AS citations,
      coalesce((SELECT string_agg(number || ':' || passed || ':' || detail, ';' ORDER BY number) FROM o_merged m WHERE m.report_id = v.report_id), '') AS rules,
      coalesce((SELECT record_ids || ' ' || len(string_split(record_ids, ',')) FROM o_conflicts k WHERE k.report_id = v.report_id), '') AS conflicts
    FROM o_verdict v JOIN o_priority p USING (report_id)""")
def v14_nested(t):
    """The whole report in one nested row; its arrays are spelt out here to be compared."""
    checked = durable(QG.gates(t))
    head = verdict(t, checked).select("report_id", "sufficient").join(RP.map_priority(t("reports")).select("report_id", F.col("class").alias("priority")), "report_id")
    rules = V.merge_rules(V.rule_rows(checked, QG.KEYS))
    nested = RP.nest(head, completed(t), V.resolve_citations(t("answers"), t("evidence")), rules, V.conflicts(t("evidence")))
    told = lambda name, *fields: F.array_join(F.transform(name, lambda x: F.concat_ws(":", *[f(x).cast("string") for f in fields])), ";")
    field = lambda name: lambda x: x[name]
    return nested.select(
        "report_id", "priority", "sufficient",
        told("sections", field("display_order"), field("section_type"), field("status"), lambda x: F.length(x["content"])).alias("sections"),
        told("citations", field("marker"), field("citation_id")).alias("citations"), told("rules", field("number"), field("passed"), field("detail")).alias("rules"),
        F.array_join(F.transform("conflicts", lambda c: F.concat(F.array_join(c["record_ids"], ","), F.lit(" "), F.size(c["positions"]).cast("string"))), ";").alias("conflicts"))


@query("v16_plain_sufficiency", "SELECT report_id, sources > 0 AND filled > 0 AS sufficient FROM o_verdict")
def v16(t):
    cited = V.resolve_citations(t("answers"), t("evidence")).groupBy("report_id").agg(F.count("*").alias("n"))
    filled = completed(t).groupBy("report_id").agg(F.bool_or(F.col("status") == "filled").alias("any_filled"))
    return filled.join(cited, "report_id", "left").select("report_id", ((F.coalesce("n", F.lit(0)) > 0) & F.col("any_filled")).alias("sufficient"))


@query("g18_affected_regions", """
    SELECT r.report_id, CASE WHEN r.report_id % 4 = 0 THEN 'REG-02,REG-01' ELSE coalesce(x, '') END AS regions FROM reports r
    LEFT JOIN (SELECT report_id, string_agg(DISTINCT region_id, ',' ORDER BY region_id) AS x FROM evidence WHERE region_id IS NOT NULL GROUP BY report_id) USING (report_id)""")
def g18(t):
    given = F.when(F.col("report_id") % 4 == 0, F.array(F.lit("REG-02"), F.lit("REG-01")))
    return RP.affected_regions(t("reports").withColumn("given", given), t("evidence"), "given").withColumn("regions", F.array_join("regions", ","))


# ---- joins ------------------------------------------------------------------
@query("j2_document_names", "SELECT e.report_id, e.rnk, coalesce(d.file_name, 'Unknown document') AS doc_name FROM evidence e LEFT JOIN documents_meta d ON d.id = 'D' || e.report_id AND (d.user_id = 'U' || (e.report_id % 3) OR d.is_preloaded)")
def j2(t):
    docs = t("documents_meta").select("id", "user_id", "is_preloaded", "file_name")
    ev = t("evidence").withColumn("want", F.concat(F.lit("D"), "report_id")).withColumn("viewer", F.concat(F.lit("U"), F.col("report_id") % 3))
    seen = (F.col("want") == F.col("id")) & ((F.col("user_id") == F.col("viewer")) | F.col("is_preloaded"))
    return ev.join(docs, seen, "left").select("report_id", "rnk", F.coalesce("file_name", F.lit("Unknown document")).alias("doc_name"))


@query("j3_region_names", f"""
    SELECT c.record_id, c.region_id, r.title AS region_name, {S.excerpt('c.content', 240)} AS summary FROM chunks c LEFT JOIN (SELECT region_id, title FROM chunks WHERE record_type = 'region') r USING (region_id) WHERE c.record_type = 'incident'""")
def j3(t):
    chunks = t("chunks")
    # Region records form a closed list of a few names; the planner broadcasts them by their size.
    names = chunks.where("record_type = 'region'").select("region_id", F.col("title").alias("region_name"))
    return chunks.where("record_type = 'incident'").join(names, "region_id", "left").select("record_id", "region_id", "region_name", X.excerpt(F.col("content"), 240).alias("summary"))


@query("j4_severity_citation", """
    WITH l AS (SELECT *, coalesce(nullif(section, ''), nullif(title, ''), nullif(chapter, ''), citation_id) AS label FROM evidence WHERE rnk <= 2 AND risk_level = 'critical'),
    s AS (SELECT report_id, arg_min(label, rnk) AS first_section FROM l GROUP BY report_id)
    SELECT q.query_id, CASE WHEN s.report_id IS NULL THEN 'informational' ELSE cls END AS class, CASE WHEN s.report_id IS NULL THEN '' ELSE coalesce(e.label, first_section) END AS citation
    FROM (SELECT query_id, conversation_id, supplied_id, CASE WHEN upper(trim(severity_class)) IN ('W3', 'W4') THEN upper(trim(severity_class)) ELSE 'informational' END AS cls FROM questions) q
    LEFT JOIN s ON s.report_id = q.conversation_id LEFT JOIN l e ON e.report_id = s.report_id AND e.citation_id = 'INC-' || q.query_id""")
def j4(t):
    # Only critical evidence states the scale; reports without any are informational.
    scale = t("evidence").where("rnk <= 2 AND risk_level = 'critical'")
    label = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("section", "title", "chapter")], "citation_id")
    first = scale.groupBy(F.col("report_id").alias("conversation_id")).agg(F.min_by(label, "rnk").alias("first_section"))
    exact = scale.select(F.col("report_id").alias("conversation_id"), F.col("citation_id").alias("severity_citation"), label.alias("exact_section"))
    asked = t("questions").withColumn("severity_citation", F.concat(F.lit("INC-"), "query_id")).withColumn("class", L.priority_class(F.col("severity_class")))
    rows = asked.join(first, "conversation_id", "left").join(exact, ["conversation_id", "severity_citation"], "left")
    none = F.col("first_section").isNull()
    return rows.select("query_id", F.when(none, F.lit("informational")).otherwise(F.col("class")).alias("class"),
                       F.when(none, F.lit("")).otherwise(F.coalesce("exact_section", "first_section")).alias("citation"))


@query("j5_report_steps", """
    SELECT r.report_id, s.sequence_number, s.step_type FROM reports r LEFT JOIN agent_steps s ON s.run_id = r.report_id""")
def j5(t):
    steps = t("agent_steps").select(F.col("run_id").alias("report_id"), "sequence_number", "step_type")
    return RP.with_steps(t("reports").select("report_id"), steps, "report_id")


# ---- evaluation -------------------------------------------------------------
@query("g1_count_by_type", "SELECT coalesce(record_type, '_total') AS record_type, count(*) AS n FROM chunks GROUP BY ROLLUP (record_type)")
def g1(t):
    return E.count_by_type(t("chunks"))


_EXPECT = "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'incident' WHEN '2-HIGH' THEN 'fauna' ELSE 'policy' END AS record_type, count(*) AS expected FROM orders GROUP BY ALL"


@query("g15_inventory", f"SELECT record_type, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual FROM ({_EXPECT}) e FULL JOIN (SELECT record_type, count(DISTINCT record_id) AS actual FROM chunks WHERE record_id IS NOT NULL GROUP BY record_type) a USING (record_type) WHERE coalesce(expected, 0) <> coalesce(actual, 0)")
def g15(t):
    kind = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'incident' WHEN '2-HIGH' THEN 'fauna' ELSE 'policy' END")
    return E.inventory(t("chunks"), t("orders").groupBy(kind.alias("record_type")).agg(F.count("*").alias("expected")))


@query("g15_missing_records", "SELECT 'FLR-' || l_partkey AS record_id, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM chunks WHERE record_id = 'INC-' || l_orderkey) GROUP BY 1")
def g15_missing(t):
    need = t("lineitem").select(F.concat(F.lit("INC-"), "l_orderkey").alias("record_id"), F.concat(F.lit("FLR-"), "l_partkey").alias("part"))
    return E.missing_records(t("chunks"), need).groupBy(F.col("part").alias("record_id")).agg(F.count("*").alias("n"))


@query("g15_contamination", r"""
    SELECT chunk_id, record_id, f AS foreign_ids FROM (SELECT chunk_id, record_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(content, '(?m)^\[([A-Z]{2,4}-[A-Z0-9]+)\]', 1)), lambda x: x <> record_id)), ',') AS f FROM o_records) WHERE f <> ''""")
def g15_contamination(t):
    from evidentia.operators.structure import record_chunks

    return E.contaminated(record_chunks(t("record_lines"))).withColumn("foreign_ids", F.array_join(F.array_sort("foreign_ids"), ","))


@query("g15_short_chunks", "SELECT chunk_id, length(content) AS chars FROM chunks WHERE length(content) < 50")
def g15_short(t):
    return E.too_short(t("chunks"))


@query("u5_id_sets", r"""
    SELECT report_id, pos, array_to_string(list_sort(list_filter(list_distinct(m), lambda x: list_contains(v, x))), ',') AS known, array_to_string(list_sort(list_filter(list_distinct(m), lambda x: NOT list_contains(v, x))), ',') AS unknown FROM (
      SELECT report_id, pos, regexp_extract_all(answer, '\[([A-Z]{2,4}-[A-Z0-9]+)\]', 1) AS m, v FROM answers JOIN (SELECT report_id, list(citation_id) AS v FROM evidence GROUP BY report_id) USING (report_id))""")
def u5(t):
    known = t("evidence").groupBy("report_id").agg(F.collect_set("citation_id").alias("v"))
    rows = t("answers").join(known, "report_id").withColumn("m", X.citation_markers(F.col("answer")))
    return rows.select("report_id", "pos", F.array_join(F.array_sort(F.array_intersect("m", "v")), ",").alias("known"), F.array_join(F.array_sort(F.array_except("m", "v")), ",").alias("unknown"))


@query("g12_floor_calibration", """
    WITH b AS (SELECT query_id, max(score) AS score FROM d_dense WHERE rank <= 5 GROUP BY query_id)
    SELECT in_min, round(in_mean, 6) AS in_mean, in_max, out_min, round(out_mean, 6) AS out_mean, out_max, round(in_min - out_max, 6) AS separation, CASE WHEN in_min - out_max > 0 THEN round((in_min + out_max) / 2, 3) END AS floor FROM (
      SELECT min(score) FILTER (i) AS in_min, avg(score) FILTER (i) AS in_mean, max(score) FILTER (i) AS in_max, min(score) FILTER (NOT i) AS out_min, avg(score) FILTER (NOT i) AS out_mean, max(score) FILTER (NOT i) AS out_max FROM (SELECT score, query_id % 2 = 0 AS i FROM b))""")
def g12(t):
    from evidentia.operators import dense
    from evidentia.plans.q_retrieval import benchmark, documents

    best = dense.search_dense(documents(t), benchmark(t), P.FLOOR_TOP).groupBy("query_id").agg(F.max("score").alias("score"))
    row = E.calibrate_floor(best, F.col("query_id") % 2 == 0)
    return row.select("in_min", F.round("in_mean", 6).alias("in_mean"), "in_max", "out_min", F.round("out_mean", 6).alias("out_mean"), "out_max", F.round("separation", 6).alias("separation"), "floor")


@query("g13_run_variance", "SELECT report_id, min(groundedness) AS low, max(groundedness) AS high, round(avg(groundedness), 6) AS mean, max(groundedness) - min(groundedness) AS spread, max(groundedness) - min(groundedness) >= 25 AS unstable FROM o_ground GROUP BY report_id")
def g13(t):
    return E.run_variance(QG.gates(t), "report_id", "groundedness").withColumn("mean", F.round("mean", 6))


@query("g14_retrieval_gate", """
    WITH h AS (SELECT report_id % 10 AS question_no, report_id, bool_or(starts_with(citation_id, CASE WHEN report_id % 2 = 0 THEN 'INC-' ELSE 'FAU-' END)) AS hit FROM evidence GROUP BY report_id)
    SELECT question_no, count(*) AS asked, CAST(count(*) FILTER (hit) AS BIGINT) AS hits, max(report_id) AS slowest, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY report_id DESC) AS DOUBLE) AS median, count(*) FILTER (hit) >= count(*) * 0.8 AS passed FROM h GROUP BY question_no""")
def g14(t):
    cited = t("evidence").groupBy("report_id").agg(F.collect_list("citation_id").alias("cited"))
    rows = cited.withColumn("expected_prefix", F.when(F.col("report_id") % 2 == 0, F.lit("INC-")).otherwise(F.lit("FAU-"))).withColumn("question_no", F.col("report_id") % 10)
    return E.gate_summary(E.gate_hits(rows), "question_no", "report_id")


@query("g16_health_counts", "SELECT count(*) AS chunks, count(record_id) AS records, count(*) > 0 AS indexed FROM chunks")
def g16(t):
    return E.health(t("chunks"))


@query("g17_document_rollup", "SELECT doc_id, max(page) AS pages, count(*) AS chunks, count(DISTINCT record_id) AS records, 'indexed' AS status FROM chunks GROUP BY doc_id")
def g17(t):
    return E.document_rollup(t("chunks"))


_CARDS = ("contains(x, 'fn-a') AS first_note, contains(x, 'fn-b') AS second_note, contains(x, 'lab-c') AS laboratory, "
          "contains(x, 'chain of custody') OR contains(x, 'chain-of-custody') AS custody, "
          + S.any_contains("x", ["not confirmed", "no confirmed", "cannot be confirmed", "remain possible", "not established"]) + " AS no_cause, contains(x, 'sampl') AS sampling")


@query("g19_scorecard", f"""
    SELECT *, CAST(first_note AS BIGINT) + CAST(second_note AS BIGINT) + CAST(laboratory AS BIGINT) + CAST(custody AS BIGINT) + CAST(no_cause AS BIGINT) + CAST(sampling AS BIGINT) AS met FROM (
      SELECT report_id, pos, {_CARDS} FROM (SELECT report_id, pos, lower(answer || CASE WHEN report_id % 3 = 0 THEN ' FN-A and FN-B remain possible' ELSE ' LAB-C' END) AS x FROM answers))""")
def g19(t):
    x = F.expr("answer || CASE WHEN report_id % 3 = 0 THEN ' FN-A and FN-B remain possible' ELSE ' LAB-C' END")
    return t("answers").select("report_id", "pos", *E.scorecard(x))


# ---- sources and sinks ------------------------------------------------------
_PART = "CAST(p_partkey AS STRING) AS part, CASE WHEN p_size % 5 = 0 THEN '  ' ELSE p_name || ' ' END AS name, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS brand"


@query("s2_csv_rows", f"SELECT p_partkey, concat_ws(' · ', 'part: ' || trim(part), CASE WHEN trim(name) <> '' THEN 'name: ' || trim(name) END, CASE WHEN trim(brand) <> '' THEN 'brand: ' || trim(brand) END) AS text FROM (SELECT p_partkey, {_PART} FROM part)")
def s2(t):
    rows = t("part").selectExpr("p_partkey", *_split_cols(_PART))
    return D.csv_texts(rows, ["part", "name", "brand"], ["p_partkey"])


def _split_cols(text: str) -> list[str]:
    import re

    return re.split(r", (?=CASE|CAST)", text)


@query("s3_csv_pages", f"""
    SELECT p_type, row_no, CAST(ceil(row_no / 25.0) AS BIGINT) AS page, 'Row ' || row_no || ' — part: ' || trim(part) || '; name: ' || trim(name) || '; brand: ' || coalesce(trim(brand), '') AS text FROM (
      SELECT p_type, {_PART}, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS row_no FROM part)""")
def s3(t):
    rows = t("part").selectExpr("p_type", "p_partkey", *_split_cols(_PART))
    return D.csv_pages(rows, "p_type", "p_partkey", ["part", "name", "brand"])


@query("s4_text_pages")
def s4(t):
    pages = D.text_pages(spread(t("documents")), ["doc_id"], paragraph="\n", joiner="\n")
    return pages.select("doc_id", "page", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query("s5_decode_payload", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS text, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'decoded' END AS status FROM documents")
def s5(t):
    sent = F.when(F.col("doc_id") % 7 == 0, F.lit("%%not base64%%")).otherwise(F.base64(F.encode("text", "UTF-8")))
    return D.decoded(t("documents").select("doc_id", sent.alias("payload")), "payload").select("doc_id", "text", "status")


_EXT = "lower(string_split(file_name, '.')[-1])"


@query("s6_content_kind", f"SELECT id, coalesce({S.case_map('content_type', P.CONTENT_KINDS)}, CASE WHEN contains(file_name, '.') THEN {S.case_map(_EXT, P.EXTENSION_KINDS)} END) AS kind FROM documents_meta")
def s6(t):
    return t("documents_meta").select("id", D.content_kind(F.col("file_name"), F.col("content_type")).alias("kind"))


@query("s7_upload_checks", "SELECT id, CASE WHEN size_bytes <= 0 THEN 'empty body' WHEN size_bytes > 10485760 THEN 'too large' END AS problem FROM documents_meta")
def s7(t):
    from evidentia.operators.listing import upload_problem

    return t("documents_meta").select("id", upload_problem(F.col("file_name"), F.col("size_bytes"), P.UPLOAD_BYTES).alias("problem"))


@query("s9_index_rows", "SELECT chunk_id, doc_id, record_id, record_type, region_id, risk_level, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM chunks JOIN embeddings ON vec_id = ordinal AND record_type = 'incident'")
def s9(t):
    vectors = t("embeddings").join(t("chunks").where("record_type = 'incident'").select("chunk_id", "ordinal"), F.col("vec_id") == F.col("ordinal"))
    rows = IX.to_index_rows(t("chunks"), vectors.select("chunk_id", F.col("embedding").alias("vector")))
    return rows.select("chunk_id", "doc_id", "record_id", "record_type", "region_id", "risk_level",
                       F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("s10_upsert", """
    SELECT chunk_id, title FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE 'rec-inc-' || o_orderkey = c.chunk_id)
    UNION ALL SELECT 'rec-inc-' || o_orderkey, 'Renewed ' || o_orderkey FROM orders""")
def s10(t):
    fresh = t("orders").select(F.concat(F.lit("rec-inc-"), "o_orderkey").alias("chunk_id"), F.concat(F.lit("Renewed "), "o_orderkey").alias("title"))
    return IX.upsert(t("chunks").select("chunk_id", "title"), fresh)


@query("s11_delete_documents", "SELECT doc_id, count(*) AS chunks FROM chunks WHERE doc_id NOT IN (SELECT 'C' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY doc_id")
def s11(t):
    gone = t("customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("C"), "c_custkey").alias("doc_id"))
    return IX.remove_documents(t("chunks"), gone).groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query("s11_removed_counts", "SELECT d.doc_id, count(c.chunk_id) AS removed FROM (SELECT 'C' || c_custkey AS doc_id FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'X' || s_suppkey FROM supplier) d LEFT JOIN chunks c USING (doc_id) GROUP BY d.doc_id")
def s11_counts(t):
    gone = t("customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("C"), "c_custkey").alias("doc_id"))
    gone = gone.unionByName(t("supplier").select(F.concat(F.lit("X"), "s_suppkey").alias("doc_id")))
    return IX.removed_counts(t("chunks"), gone)


@query("s14_schema_evolution", f"SELECT report_id, {_CONF} AS confidence, 'sitrep' AS assembly_mode, had_conflict, was_partial, priority_class, 0 AS llm_call_count FROM (SELECT * REPLACE (coalesce(priority_class, 'informational') AS priority_class) FROM reports)")
def s14(t):
    old = t("reports").select("report_id", "confidence", "had_conflict", "was_partial", "priority_class")
    return RP.evolve_answers(old)


_PRELOADED = {"id": "PRELOADED", "user_id": "U0", "file_name": "register.pdf", "content_type": "application/pdf", "size_bytes": 501366, "status": "indexed", "is_preloaded": True, "seq": 0}


@query("s14_preloaded_row", "SELECT id, user_id, file_name, status, is_preloaded FROM documents_meta UNION ALL SELECT 'PRELOADED', 'U0', 'register.pdf', 'indexed', true")
def s14_preloaded(t):
    return RP.seed_preloaded(RP.seed_preloaded(t("documents_meta"), _PRELOADED), _PRELOADED).select("id", "user_id", "file_name", "status", "is_preloaded")


@query("s14_domain_checks", """
    SELECT report_id, 'confidence' AS column, confidence AS value FROM reports WHERE confidence NOT IN ('high', 'moderate', 'low', 'insufficient')
    UNION ALL SELECT report_id, 'priority_class', priority_class FROM reports WHERE priority_class NOT IN ('W1', 'W2', 'W3', 'W4', 'informational')""")
def s14_domains(t):
    return RP.domain_violations(t("reports"), "report_id", {
        "confidence": ["high", "moderate", "low", "insufficient"], "priority_class": ["W1", "W2", "W3", "W4", "informational"]})
