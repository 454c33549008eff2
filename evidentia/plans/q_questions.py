"""Registered queries: question analysis, routing, filters and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia import params as P
from evidentia.functions import routing as R
from evidentia.functions.bounds import spread, top_n, unroll
from evidentia.functions.scan import previous_value
from evidentia.operators import listing as LS
from evidentia.plans import sqltext as S
from evidentia.plans.registry import query, shared

LQ = "lower(question)"


def _has(terms: list[str]) -> str:
    return S.any_contains(LQ, terms)


@query("f11_question_ids", rf"""
    SELECT query_id, array_to_string(list_filter(CASE WHEN supplied_id IS NULL OR list_contains(ids, supplied_id) THEN ids2 ELSE list_concat([supplied_id], ids2) END, lambda x: regexp_full_match(x, '[A-Z]{{2,4}}-[A-Z0-9]{{1,4}}')), ',') AS record_ids,
      array_to_string(regs, ',') AS region_ids
    FROM (SELECT *, CASE WHEN supplied_id IS NOT NULL AND list_contains(ids, supplied_id) THEN list_concat([supplied_id], list_filter(ids, lambda x: x <> supplied_id)) ELSE ids END AS ids2 FROM (
      SELECT query_id, supplied_id, list_sort(list_distinct(regexp_extract_all(question, {S.q(P.QUESTION_RECORD_ID)}, 1))) AS ids, list_sort(list_distinct(regexp_extract_all(question, {S.q(P.QUESTION_REGION_ID)}, 1))) AS regs FROM questions))""")
def f11(t):
    supplied = F.when(F.col("supplied_id").isNotNull(), F.array("supplied_id"))
    ids = R.question_ids(F.col("question"), supplied, P.QUESTION_RECORD_ID)
    first = F.filter(ids, lambda x: x == F.col("supplied_id"))
    rest = F.array_sort(F.filter(ids, lambda x: ~F.coalesce(x == F.col("supplied_id"), F.lit(False))))
    regions = F.array_sort(R.question_ids(F.col("question"), F.lit(None).cast("array<string>"), P.QUESTION_REGION_ID))
    return t("questions").select(
        "query_id", F.array_join(F.concat(F.coalesce(first, F.array().cast("array<string>")), rest), ",").alias("record_ids"), F.array_join(regions, ",").alias("region_ids"))


def _ordered(x: str, rest: str) -> str:
    """Columns of ``rest`` and the distinct elements of ``x``, in order of first place, as ``h``."""
    return f"SELECT {rest}, list_filter(h, lambda v, i: list_position(h, v) = i) AS h FROM (SELECT {rest}, {x} AS h FROM questions)"


_HINTS = "flatten(list_filter([" + ", ".join(
    f"CASE WHEN {_has(w)} THEN [{', '.join(S.q(k) for k in kinds)}] END" for w, kinds in P.TYPE_HINTS) + "], lambda g: g IS NOT NULL))"


@query("f12_type_hints", f"SELECT query_id, CASE WHEN len(h) > 0 THEN array_to_string(h, ',') END AS hints FROM ({_ordered(_HINTS, 'query_id')})")
def f12(t):
    return t("questions").select("query_id", F.array_join(R.type_hints(F.col("question")), ",").alias("hints"))


_SHAPE = f"CASE WHEN {_has(P.COMPARE_TERMS)} THEN 'compare' WHEN {_has(P.SUMMARISE_TERMS)} THEN 'summarize' ELSE 'simple' END"


@query("f25_query_shape", f"""
    SELECT query_id, {_SHAPE} AS shape, regexp_matches(question, {S.q(P.TRIAGE_INTENT)}) AS triage, regexp_matches(question, {S.q(P.COMPARISON_INTENT)}) AS comparison, {_has(P.INCIDENT_TERMS)} AS incident FROM questions""")
def f25(t):
    q = F.col("question")
    return t("questions").select(
        "query_id", R.query_shape(q, F.lit("simple")).alias("shape"), R.is_triage(q).alias("triage"),
        q.rlike(P.COMPARISON_INTENT).alias("comparison"), R.has_incident_shape(q).alias("incident"))


@query("f26_comparison_aspects", rf"""
    WITH s AS (SELECT query_id, list_filter(list_transform(string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(question, {S.q(P.COMPARISON_INTENT)}, ''), '^[\s,:-]+', ''), '\?+$', '')),
                 {S.q(P.ASPECT_SPLIT)}), lambda p: trim(p)), lambda p: len(string_split_regex(p, '\s+')) >= 2) AS sides FROM questions WHERE regexp_matches(question, {S.q(P.COMPARISON_INTENT)})),
    w AS (SELECT *, string_split_regex(sides[1], '\s+') AS ws FROM s WHERE len(sides) >= 2),
    i AS (SELECT query_id, sides, CASE WHEN len(ws) > 4 THEN array_to_string(ws[1:len(ws) - 2], ' ') END AS carrier, unnest(range(1, len(sides) + 1)) AS n FROM w)
    SELECT query_id, n - 1 AS aspect_no, CASE WHEN n = 1 OR carrier IS NULL THEN sides[n] ELSE carrier || ' ' || sides[n] END AS aspect FROM i""")
def f26(t):
    return unroll(t("questions"), ["query_id"], R.aspects(F.col("question")), "aspect", "aspect_no")


def _cut(x: str, sep: str) -> str:
    head, tail = f"trim(left({x}, instr({x}, {S.q(sep)}) - 1))", f"trim(substr({x}, instr({x}, {S.q(sep)}) + {len(sep)}))"
    return f"CASE WHEN instr({x}, {S.q(sep)}) > 0 AND length({head}) > 8 AND length({tail}) > 8 THEN [{head}, {tail}] END"


_REWRITTEN = "coalesce(nullif(trim(rewritten), ''), question)"
_GIVEN = "list_filter(list_transform(string_split(coalesce(supplied, ''), '|'), lambda s: trim(s)), lambda s: s <> '')"
_SUBS = f"coalesce(CASE WHEN len({_GIVEN}) >= 2 THEN {_GIVEN}[1:2] END, " + ", ".join(
    _cut(x, s) for x in (_REWRITTEN, "question") for s in P.SUBQUERY_SEPARATORS) + f", [{_REWRITTEN}, {_REWRITTEN}])"


@query("f27_sub_queries", f"SELECT query_id, s[1] AS first, s[2] AS second FROM (SELECT query_id, {_SUBS} AS s FROM questions)")
def f27(t):
    subs = R.sub_queries(F.col("question"), F.split("supplied", "[|]"), F.col("rewritten"))
    return t("questions").select("query_id", subs.alias("s")).select(
        "query_id", F.get("s", F.lit(0)).alias("first"), F.get("s", F.lit(1)).alias("second"))


_EXP = "flatten(list_filter([" + ", ".join(
    f"CASE WHEN contains({LQ}, {S.q(k)}) THEN [{', '.join(S.q(w) for w in ws)}] END" for k, ws in P.SYNONYMS.items()) + "], lambda g: g IS NOT NULL))"
shared("o_variants", f"""
    WITH e AS (SELECT query_id, question, h AS ex, regexp_extract_all(upper(question), {S.q(P.PROBE_ID)}, 1) AS ids FROM ({_ordered(_EXP, 'query_id, question')}))
    SELECT query_id, question AS variant FROM e
    UNION ALL SELECT query_id, question || ' ' || array_to_string(ex, ' ') FROM e WHERE len(ex) > 0
    UNION ALL SELECT query_id, array_to_string(ids, ' ') FROM e WHERE len(ids) > 0""")


@query("f28_query_variants", "SELECT * FROM o_variants")
def f28(t):
    return t("questions").select("query_id", F.explode(R.query_variants(F.col("question"))).alias("variant"))


@query("u2_variant_pool", rf"""
    SELECT query_id, lower(trim(variant)) AS phrasing, count(*) AS repeats FROM (
      SELECT query_id, variant FROM o_variants UNION ALL SELECT query_id, upper(question) || '  ' FROM questions UNION ALL SELECT query_id, '  ' FROM questions)
    WHERE trim(variant) <> '' GROUP BY ALL""")
def u2(t):
    q = t("questions")
    rows = f28(t).select("query_id", "variant").unionByName(q.select("query_id", F.concat(F.upper("question"), F.lit("  ")).alias("variant"))).unionByName(
        q.select("query_id", F.lit("  ").alias("variant")))
    return rows.where(F.trim("variant") != "").groupBy("query_id", F.lower(F.trim("variant")).alias("phrasing")).agg(F.count("*").alias("repeats"))


@query("f29_coreference", """
    SELECT conv_id, turn, CASE WHEN prior IS NOT NULL AND length(text) <= 120 THEN prior || ' ' || text ELSE text END AS question FROM (
      SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations WHERE role = 'user')""")
def f29(t):
    users = t("conversations").where("role = 'user'")
    rows = previous_value(users, "conv_id", "turn", "text", "prior")
    return rows.select("conv_id", "turn", F.when(F.col("prior").isNotNull() & (F.length("text") <= 120), F.concat_ws(" ", "prior", "text")).otherwise(F.col("text")).alias("question"))


_OWN = {p[0]: S.q(p[0]) for p in P.PROFILES}
_PROT, _INV, _RESP = (S.q(p[0]) for p in P.PROFILES)


def _owner(x: str) -> str:
    ids, low = f"regexp_extract_all({x}, {S.q(P.QUESTION_RECORD_ID)}, 1)", f"lower({x})"

    def named(prefixes: str) -> str:
        return f"len(list_filter({ids}, lambda i: regexp_matches(i, '^({prefixes})-'))) > 0"

    return (
        f"CASE WHEN {named('FAU|FLR')} THEN {_PROT} WHEN {named('MED|KC')} THEN {_RESP} WHEN {named('INC|WS|FN|LAB|SV')} THEN {_INV} "
        f"WHEN {S.any_contains(low, P.ACTION_TERMS)} THEN {_RESP} WHEN {S.any_contains(low, P.SPECIES_TERMS)} THEN {_PROT} ELSE {_INV} END")


_CLS = "CASE WHEN upper(trim(severity_class)) IN ('W1', 'W2', 'W3', 'W4') THEN upper(trim(severity_class)) ELSE 'informational' END"
shared("o_routes", f"""
    SELECT query_id, question, rewritten, supplied, coalesce(forced_mode, CASE WHEN query_shape = 'compare' OR {_has(P.COMPARE_TERMS)} THEN 'compare' WHEN {_CLS} <> 'informational' THEN 'sitrep'
      WHEN {_has(P.INCIDENT_TERMS)} THEN 'sitrep' ELSE 'focused' END) AS mode, {_owner('question')} AS owner FROM questions""")


def routed(t):
    from evidentia.functions.labels import priority_class

    q = spread(t("questions")).withColumn("class", priority_class(F.col("severity_class")))
    return q.withColumn("mode", R.dispatch_mode(F.col("question"), F.col("class"), F.col("forced_mode"), F.col("query_shape"))).withColumn(
        "owner", R.focused_owner(F.col("question")))


@query("f30_route", "SELECT query_id, mode, owner FROM o_routes")
def f30(t):
    return routed(t).select("query_id", "mode", "owner")


@query("f31_roster", f"""
    WITH r AS (SELECT *, {_SUBS} AS s FROM o_routes),
    c AS (SELECT *, {_owner('s[1]')} AS o1, {_owner('s[2]')} AS o2 FROM r)
    SELECT query_id, {_PROT} AS owner, question AS sub_question FROM c WHERE mode = 'sitrep' UNION ALL SELECT query_id, {_INV}, question FROM c WHERE mode = 'sitrep'
    UNION ALL SELECT query_id, {_RESP}, question FROM c WHERE mode = 'sitrep' UNION ALL SELECT query_id, o1, s[1] FROM c WHERE mode = 'compare'
    UNION ALL SELECT query_id, CASE WHEN o1 <> o2 THEN o2 WHEN o1 = {_INV} THEN {_RESP} ELSE {_INV} END, s[2] FROM c WHERE mode = 'compare'
    UNION ALL SELECT query_id, owner, question FROM c WHERE mode = 'focused'""")
def f31(t):
    rows = R.with_roster(routed(t).select("query_id", "question", "mode", "rewritten", F.split("supplied", "[|]").alias("sub_queries")))
    return rows.select("query_id", F.col("roster_owner").alias("owner"), "sub_question")


_JSON = """'{"severity_class": "' || coalesce(severity_class, '') || '", "query_shape": "' || CASE WHEN query_id % 3 = 0 THEN ' Compare ' ELSE 'odd' END || '", "use_case": "' || CASE WHEN query_id % 2 = 0 THEN 'Research Assistant' ELSE 'Other' END || '", "variants": ' || CASE WHEN query_id % 4 = 0 THEN '"one"' WHEN query_id % 4 = 1 THEN '["a", " ", "b", "c"]' ELSE '[]' END || ', "rewritten_query": "' || CASE WHEN query_id % 5 = 0 THEN ' ' ELSE 'again ' || query_id || ' ' END || '", "record_ids": ["INC-1", " FAU-2 ", ""], "region_ids": "REG-01", "severity_reason": " seen ", "sub_queries": ["x", "y", "z"]' || CASE WHEN query_id % 9 = 0 THEN '' ELSE '}' END"""


@query("f24_classification_payload", """
    SELECT query_id, CASE WHEN query_id % 9 <> 0 AND severity_class IN ('W1', 'W2', 'W3', 'W4', 'Informational') THEN severity_class ELSE 'Informational' END AS severity_class,
      CASE WHEN query_id % 9 <> 0 AND query_id % 3 = 0 THEN 'compare' ELSE 'simple' END AS query_shape,
      CASE WHEN query_id % 9 <> 0 AND query_id % 2 = 0 THEN 'Research Assistant' ELSE 'Environmental Incident Investigation' END AS use_case,
      CASE WHEN query_id % 9 = 0 THEN '' WHEN query_id % 4 = 0 THEN 'one' WHEN query_id % 4 = 1 THEN 'a,b' ELSE '' END AS variants,
      CASE WHEN query_id % 9 <> 0 AND query_id % 5 <> 0 THEN 'again ' || query_id ELSE question END AS rewritten, CASE WHEN query_id % 9 <> 0 THEN 'INC-1,FAU-2' ELSE '' END AS record_ids,
      CASE WHEN query_id % 9 <> 0 THEN 'REG-01' ELSE '' END AS region_ids, CASE WHEN query_id % 9 <> 0 THEN 'seen' ELSE '' END AS severity_reason, '' AS severity_citation,
      CASE WHEN query_id % 9 <> 0 THEN 'x,y' ELSE '' END AS sub_queries FROM questions""")
def f24(t):
    raw = t("questions").select("query_id", "question", F.expr(_JSON).alias("payload"))
    lists = [F.array_join(c, ",").alias(c) for c in ("variants", "record_ids", "region_ids", "sub_queries")]
    return R.classification(raw).select("query_id", "severity_class", "query_shape", "use_case", "rewritten", "severity_reason", "severity_citation", *lists)


@query("f34_conversation_title", "SELECT conv_id, left(arg_min(text, turn), 200) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id")
def f34(t):
    return t("conversations").where("role = 'user'").groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 200).alias("title"))


@query("f36_history_text", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role <> 'system') WHERE r <= 4 GROUP BY conv_id")
def f36(t):
    recent = top_n(t("conversations").where("role <> 'system'"), ["conv_id"], [F.desc("turn")], 4, "r")
    lines = recent.select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"))
    return lines.groupBy("conv_id").agg(F.expr("listagg(line, '\n') within group (order by turn)").alias("history"))


# ---- filters and listings ---------------------------------------------------
@query("p1_metadata_filter", "SELECT chunk_id FROM chunks WHERE record_type IN ('incident', 'fauna') AND region_id IN ('REG-01', 'REG-03')")
def p1(t):
    return LS.metadata_filter(t("chunks"), ["incident", "fauna"], ["REG-01", "REG-03"]).select("chunk_id")


@query("p2_incident_listing", "SELECT record_id, title, region_id, risk_level, (SELECT count(*) FROM chunks WHERE record_type = 'incident' AND risk_level = 'critical') AS total FROM chunks WHERE record_type = 'incident' AND risk_level = 'critical' ORDER BY record_id LIMIT 50 OFFSET 20")
def p2(t):
    rows = LS.metadata_filter(t("chunks"), ["incident"]).where("risk_level = 'critical'")
    page = LS.page_of(rows, [F.asc("record_id")], 20, 50)
    return LS.with_total(page, rows).select("record_id", "title", "region_id", "risk_level", "total")


@query("p5_visibility", "SELECT id, user_id, is_preloaded FROM documents_meta WHERE user_id = 'U7' OR is_preloaded")
def p5(t):
    return LS.visible_to(t("documents_meta"), "U7").select("id", "user_id", "is_preloaded")


@query("p6_document_listing", "SELECT id, status, seq, (SELECT count(*) FROM documents_meta WHERE status = 'indexed') AS total FROM documents_meta WHERE status = 'indexed' ORDER BY seq DESC LIMIT 25 OFFSET 5")
def p6(t):
    rows = t("documents_meta").where("status = 'indexed'")
    return LS.with_total(LS.page_of(rows, [F.desc("seq")], 5, 25), rows).select("id", "status", "seq", "total")


@query("p7_report_listing", """
    SELECT report_id, had_conflict, citation_count, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM reports WHERE had_conflict AND NOT has_sufficient_evidence ORDER BY reports.created_at DESC, report_id LIMIT 20""")
def p7(t):
    from evidentia.operators.reports import iso_utc

    rows = t("reports").where("had_conflict AND NOT has_sufficient_evidence")
    return LS.page_of(rows, [F.desc("created_at"), F.asc("report_id")], 0, 20).select("report_id", "had_conflict", "citation_count", iso_utc(F.col("created_at")).alias("created_at"))


@query("p8_evidence_by_region", "SELECT report_id, rnk, citation_id FROM evidence WHERE region_id = 'REG-05'")
def p8(t):
    return LS.metadata_filter(t("evidence"), region_ids=["REG-05"]).select("report_id", "rnk", "citation_id")


@query("p11_deletable", "SELECT id, CASE WHEN is_preloaded THEN 'preloaded' WHEN status IN ('pending', 'indexing') THEN 'in flight' END AS blocked_by FROM documents_meta")
def p11(t):
    return LS.deletable(t("documents_meta")).select("id", "blocked_by")


@query("g11_unpaged_total", "SELECT status, count(*) AS total FROM documents_meta GROUP BY status")
def g11(t):
    return t("documents_meta").groupBy("status").agg(F.count("*").alias("total"))


@query("w12_latest_row", "SELECT user_id, arg_max(id, seq) AS id, max(seq) AS seq FROM documents_meta GROUP BY user_id")
def w12(t):
    from evidentia.operators.reports import latest_per

    return latest_per(t("documents_meta"), "user_id", "seq", ["id", "seq"])


@query("j12_conversation_resolve", """
    SELECT q.conversation_id, q.user_id, c.id IS NULL AS created, coalesce(c.title, left(q.question, 200)) AS title
    FROM (SELECT query_id, 'K' || conversation_id AS conversation_id, 'U' || (query_id % 5) AS user_id, question FROM questions) q
    LEFT JOIN (SELECT 'K' || c_custkey AS id, 'U' || (c_custkey % 5) AS user_id, c_name AS title FROM customer) c ON c.id = q.conversation_id AND c.user_id = q.user_id""")
def j12(t):
    from evidentia.operators.reports import resolve_conversations

    asked = t("questions").select(F.concat(F.lit("K"), "conversation_id").alias("conversation_id"), F.concat(F.lit("U"), F.col("query_id") % 5).alias("user_id"), "question")
    known = t("customer").select(F.concat(F.lit("K"), "c_custkey").alias("id"), F.concat(F.lit("U"), F.col("c_custkey") % 5).alias("user_id"), F.col("c_name").alias("title"))
    return resolve_conversations(asked, known)


@query("j11_latest_answer", """
    SELECT q.query_id, l.question AS last_question FROM questions q LEFT JOIN (SELECT conversation_id, arg_max(question, query_id) AS question, max(query_id) AS m FROM questions GROUP BY conversation_id) l USING (conversation_id)""")
def j11(t):
    from evidentia.operators.reports import latest_per

    q = t("questions")
    last = latest_per(q, "conversation_id", "query_id", ["question"]).withColumnRenamed("question", "last_question")
    return q.select("query_id", "conversation_id").join(last, "conversation_id", "left").select("query_id", "last_question")
