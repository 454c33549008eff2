"""Claim split and the eight grounding rules, as one wide row per answer.

Evidence arrives cut to the retrieval depth, so a report's evidence fits in one
array; answers and evidence meet in a single join and every rule is an expression
over that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia import params as P
from evidentia.functions import labels as L
from evidentia.functions import text as X
from evidentia.functions.bounds import first_per, top_n, unroll

STRINGS = "array<string>"


def split_inference(answer: Column) -> Column:
    """``struct(body, inference)`` cut at the first known marker that occurs."""
    low = F.lower(answer)
    at = F.coalesce(*[F.nullif(F.instr(low, m), F.lit(0)) for m in P.INFERENCE_MARKERS])
    return F.struct(
        F.when(at.isNull(), answer).otherwise(F.substring(answer, F.lit(1), at - 1)).alias("body"),
        F.when(at.isNull(), F.lit("")).otherwise(answer.substr(at, F.length(answer))).alias("inference"))


def _line_class(line: Column) -> Column:
    """One line with its marks: blank, structure, template slot, citation, opening and closing quote."""
    s = F.trim(line)
    return F.struct(
        s.alias("s"), (s == "").alias("blank"), s.rlike(r"^(#|\||---|\*\*\*|===)").alias("structure"),
        (s.contains("[") & s.rlike(P.PLACEHOLDER)).alias("slot"), (s.contains("[") & s.rlike(P.CITATION)).alias("cites"),
        (s.startswith('"') | s.startswith("'")).alias("quoted"), s.endswith('"').alias("closes"))


def _prose_lines(text: Column) -> Column:
    """Lines that may hold claims: no structure, no quoted template blocks."""
    lines = F.transform(X.lines_of(text), _line_class)
    start = F.struct(F.lit(False).alias("inside"), F.array().cast(STRINGS).alias("kept"))

    def step(state: Column, c: Column) -> Column:
        inside, opens = state["inside"], c["quoted"] & ~c["cites"]
        after = (
            F.when(c["blank"], F.lit(False)).when(c["structure"], inside).when(c["slot"], F.lit(True))
            .when(inside, ~(c["cites"] | c["closes"])).otherwise(opens))
        keep = ~(c["blank"] | c["structure"] | c["slot"]) & F.when(inside, c["cites"]).otherwise(~opens)
        return F.struct(after.alias("inside"),
                        F.when(keep, F.concat(state["kept"], F.array(c["s"]))).otherwise(state["kept"]).alias("kept"))

    return F.aggregate(lines, start, step, lambda state: state["kept"])


def claim_sentences(text: Column) -> Column:
    """Sentences of at least 25 characters that state something."""

    def bare(s: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(s, r"^[-*+]\s+", ""), r"^\d+[.)]\s+", ""))

    def states(s: Column) -> Column:
        label = s.endswith(":") & ~s.rlike(P.CITATION)
        heading = (F.length(s) < 90) & ~s.rlike(r"[.!?]$") & ~s.contains("[")
        bold = s.rlike(r"^\*\*[^*]{0,80}\*\*:?$")
        return (F.length(s) >= P.MIN_CLAIM) & ~label & ~heading & ~bold

    lines = F.filter(F.transform(_prose_lines(text), bare), states)
    parts = F.flatten(F.transform(lines, lambda s: F.transform(F.split(s, P.SENTENCE_SPLIT), lambda p: F.trim(p))))
    return F.filter(parts, lambda p: F.length(p) >= P.MIN_CLAIM)


def with_claims(answers: DataFrame, answer: str = "answer") -> DataFrame:
    halves = answers.withColumn("__half", split_inference(F.col(answer)))
    return halves.withColumn("claims", claim_sentences(F.col("__half.body"))).withColumn(
        "inference", claim_sentences(F.col("__half.inference"))).drop("__half")


def claims(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, claim_no, text) rows."""
    def rows(col: str, kind: str) -> Column:
        return F.transform(col, lambda c, i: F.struct(F.lit(kind).alias("kind"), i.alias("claim_no"), c.alias("text")))

    both = F.concat(rows("claims", "claim"), rows("inference", "inference"))
    return unroll(with_claims(answers), [*keys], both, "c").select(*keys, "c.*")


def evidence_arrays(evidence: DataFrame, key: str = "report_id") -> DataFrame:
    cols = ["rnk", "citation_id", "record_type", "evidence_quality", "record_date", "content"]
    return evidence.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("ev"))


def _ids(items: Column) -> Column:
    """['A', 'B'] as text."""
    return F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))


def _pick(cond: Column, yes: Column | str, no: Column | str) -> Column:
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.when(cond, as_col(yes)).otherwise(as_col(no))


def _text(n: Column) -> Column:
    return n.cast("string")


def rule_citations() -> tuple[Column, Column]:
    total, bad = F.size("claims"), F.size("unsupported")
    return bad == 0, F.concat(_text(total - bad), F.lit("/"), _text(total), F.lit(" factual sentences carry a resolving marker"))


def rule_hypotheses() -> tuple[Column, Column]:
    multi = F.size(F.filter("ev", lambda e: X.contains_any(F.lower(e["content"]), P.MULTI_CAUSE_PHRASES)))
    hedged = X.contains_any(F.lower("answer"), P.HEDGE_TERMS)
    return (multi == 0) | hedged, _pick(
        multi == 0, "no multi-cause record retrieved; rule not engaged",
        F.concat(_text(multi), F.lit(" multi-cause record(s) retrieved; answer "),
                 _pick(hedged, "presents them as hypotheses", "ASSERTS a cause without hedging")))


def merged_records(claim: Column, ev: Column) -> Column:
    """Per sensitive type cited twice or more in a sentence: the sorted IDs, in order of first mention."""
    cited = X.citation_markers(claim)

    def of(kind: str) -> Column:
        known = F.transform(F.filter(ev, lambda e: e["record_type"] == kind), lambda e: e["citation_id"])
        ids = F.filter(cited, lambda c: F.array_contains(known, c))
        return F.struct(F.array_position(cited, F.get(ids, F.lit(0))).alias("at"), F.array_sort(ids).alias("ids"))

    groups = F.array(*[of(kind) for kind in P.MERGE_SENSITIVE])
    found = F.transform(F.array_sort(F.filter(groups, lambda g: F.size(g["ids"]) > 1)), lambda g: g["ids"])
    return F.when(F.size(cited) > 1, found).otherwise(F.array().cast(f"array<{STRINGS}>"))


def rule_no_merging() -> tuple[Column, Column, Column]:
    hits = F.col("merged")
    n = F.size(hits)
    detail = _pick(n == 0, "no sentence blends same-type records", F.concat(
        F.lit("review: "), _text(n), F.lit(" sentence(s) cite multiple same-type records ("), _ids(F.get(hits, F.lit(0))), F.lit(" in one sentence)")))
    return F.lit(True), detail, n > 0


def rule_time_and_place() -> tuple[Column, Column]:
    dated, cited, good = (F.size(F.col(c)) for c in ("dated", "cited_dated", "qualified"))
    return good == cited, (
        F.when(dated == 0, F.lit("no dated record retrieved; rule not engaged"))
        .when(cited == 0, F.lit("no dated record was cited"))
        .otherwise(F.concat(_text(good), F.lit("/"), _text(cited), F.lit(" cited dated record(s) carry their date in the answer"))))


def rule_health() -> tuple[Column, Column]:
    engaged = F.exists("ev", lambda e: (e["record_type"] == "health") & F.array_contains(F.col("markers"), e["citation_id"]))
    low = F.lower("answer")
    flags, disclaimer = X.contains_any(low, P.RED_FLAG_TERMS), X.contains_any(low, P.DISCLAIMER_TERMS)
    missing = F.concat_ws(", ", F.when(~flags, F.lit("red flags")), F.when(~disclaimer, F.lit("fiction disclaimer")))
    return ~engaged | (flags & disclaimer), (
        F.when(~engaged, F.lit("no MED-* record cited; rule not engaged"))
        .when(flags & disclaimer, F.lit("both present")).otherwise(F.concat(F.lit("MISSING: "), missing)))


def rule_absence() -> tuple[Column, Column]:
    says = F.lower("answer").contains(P.ABSENCE_PHRASE)
    return F.col("sufficient") | says, (
        F.when(F.col("sufficient"), F.lit("evidence was sufficient; rule not engaged"))
        .when(says, F.lit("insufficiency stated explicitly"))
        .otherwise(F.lit("evidence was insufficient but the answer did not say so")))


def rule_conflicts() -> tuple[Column, Column]:
    ids = F.transform(F.filter("ev", lambda e: e["evidence_quality"] == "disputed report"), lambda e: e["citation_id"])
    low = F.lower("answer")
    engaged = F.size(ids) >= 2
    ok = X.contains_any(low, P.CONFLICT_TERMS) & F.forall(ids, lambda i: F.contains(low, F.lower(i)))
    return ~engaged | ok, _pick(
        engaged, F.concat(F.lit("conflict across "), _ids(ids), _pick(ok, " surfaced with its limitation", " was NOT fully presented")),
        "no conflicting records retrieved; rule not engaged")


def rule_documented() -> tuple[Column, Column]:
    marked = X.contains_any(F.lower("answer"), P.INFERENCE_MARKERS)
    return F.lit(True), _pick(
        marked, F.concat(F.lit("inference block present ("), _text(F.size("inference")), F.lit(" sentence(s))")),
        "no inference offered; every statement is attributed to a record")


def groundedness(supported: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(100)).otherwise(F.bround(100 * supported / total).cast("int"))


def gate(answers: DataFrame, evidence: DataFrame, keys: list[str], key: str = "report_id") -> DataFrame:
    """One row per answer: claims, unsupported claims, groundedness and the array of eight rule results.

    ``answers``: keys, answer, sufficient. ``evidence``: key, rnk and record columns.
    """
    rows = with_claims(answers).join(evidence_arrays(evidence, key), key, "left")
    none = F.array().cast(evidence_type(evidence))
    rows = rows.withColumn("ev", F.coalesce("ev", none)).withColumn("markers", X.citation_markers(F.col("answer")))
    rows = rows.withColumn("valid", F.transform("ev", lambda e: e["citation_id"]))
    # Facts that several rules or details read are columns of their own, evaluated once.
    rows = rows.withColumn("unsupported", F.filter("claims", lambda c: ~F.arrays_overlap(X.citation_markers(c), F.col("valid"))))
    rows = rows.withColumn("merged", F.flatten(F.transform("claims", lambda c: merged_records(c, F.col("ev")))))
    rows = rows.withColumn("dated", F.filter("ev", lambda e: e["record_date"].isNotNull()))
    rows = rows.withColumn("cited_dated", F.filter("dated", lambda e: F.array_contains(F.col("markers"), e["citation_id"])))
    rows = rows.withColumn("qualified", F.filter("cited_dated", lambda e: X.date_present(e["record_date"], F.col("answer"))))
    merge_ok, merge_detail, merge_flag = rule_no_merging()
    outcomes = [
        (*rule_citations(), None), (*rule_hypotheses(), None), (merge_ok, merge_detail, merge_flag), (*rule_time_and_place(), None),
        (*rule_health(), None), (*rule_absence(), None), (*rule_conflicts(), None), (*rule_documented(), None)]
    rules = F.array(*[
        F.struct(F.lit(i).alias("number"), F.lit(P.RULE_NAMES[i]).alias("name"), passed.alias("passed"), detail.alias("detail"),
                 (F.lit(False) if flag is None else flag).alias("flagged"))
        for i, (passed, detail, flag) in enumerate(outcomes, 1)])
    total = F.size("claims")
    return rows.select(
        *keys, total.alias("claim_count"), (total - F.size("unsupported")).alias("supported_claim_count"),
        groundedness(total - F.size("unsupported"), total).alias("groundedness"), "unsupported", rules.alias("rules"))


def evidence_type(evidence: DataFrame) -> str:
    types = dict(evidence.dtypes)
    cols = ["rnk", "citation_id", "record_type", "evidence_quality", "record_date", "content"]
    return "array<struct<" + ",".join(f"{c}:{types[c]}" for c in cols) + ">>"


def rule_rows(gates: DataFrame, keys: list[str]) -> DataFrame:
    return unroll(gates, [*keys], "rules", "r").select(*keys, "r.*")


def merge_rules(rules: DataFrame, key: str = "report_id", order: str = "pos") -> DataFrame:
    """Per report and rule: passes if all pass; the detail of the first failure, else of the first engaged, else the first."""
    idle = F.col("passed") & F.contains("detail", F.lit("not engaged"))
    return rules.groupBy(key, "number", "name").agg(
        F.bool_and("passed").alias("passed"), F.min_by("detail", F.struct("passed", idle, order)).alias("detail"))


def merge_groundedness(gates: DataFrame, key: str = "report_id", order: str = "pos") -> DataFrame:
    """Mean groundedness (half to even) and the unsupported claims of all sections in order. Sections per report are fixed."""
    lists = F.array_sort(F.collect_list(F.struct(order, "unsupported")))
    return gates.groupBy(key).agg(
        F.bround(F.avg("groundedness")).cast("int").alias("groundedness"), F.sum("claim_count").alias("claim_count"),
        F.sum("supported_claim_count").alias("supported_claim_count"),
        F.flatten(F.transform(lists, lambda s: s["unsupported"])).alias("unsupported"))


def cited_markers(answers: DataFrame, keys: list[str]) -> DataFrame:
    return unroll(answers, [*keys], X.citation_markers(F.col("answer")), "citation_id", "marker_no")


def resolve_citations(answers: DataFrame, evidence: DataFrame, key: str = "report_id", order: str = "pos") -> DataFrame:
    """Cited evidence of a report in order of first mention, renumbered from one; unknown markers drop out."""
    mentioned = cited_markers(answers, [key, order]).groupBy(key, "citation_id").agg(F.min(F.struct(order, "marker_no")).alias("first"))
    known = first_per(evidence, [key, "citation_id"], [F.asc("rnk")])
    resolved = known.join(mentioned, [key, "citation_id"])
    place = F.row_number().over(Window.partitionBy(key).orderBy("first"))
    return resolved.withColumn("marker", place).drop("first")


def invented_citations(answers: DataFrame, evidence: DataFrame, keys: list[str], key: str = "report_id") -> DataFrame:
    """Markers that resolve to no evidence."""
    return cited_markers(answers, keys).join(evidence.select(key, "citation_id"), [key, "citation_id"], "left_anti")


def conflicts(evidence: DataFrame, key: str = "report_id") -> DataFrame:
    """Two or more disputed records in one evidence set: every position with its limitation."""
    disputed = evidence.where(F.col("evidence_quality") == "disputed report").select(
        key, F.struct(
            "rnk", F.col("citation_id").alias("record_id"), X.excerpt(F.col("content"), 200).alias("claim"),
            L.limitation(F.col("content")).alias("reliability_limitation"), "content").alias("p"))
    rows = disputed.groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("p")).where(F.size("p") >= 2)
    joined = F.array_join(F.transform("p", lambda p: p["content"]), " ")
    return rows.select(
        key, F.transform("p", lambda p: p["record_id"]).alias("record_ids"), L.limitation(joined).alias("reliability_limitation"),
        F.transform("p", lambda p: F.struct(p["record_id"], p["claim"], p["reliability_limitation"])).alias("positions"))


def unique_conflicts(rows: DataFrame, key: str = "report_id") -> DataFrame:
    """One conflict per report and set of IDs."""
    ids = F.array_join(F.array_sort("record_ids"), ",")
    return rows.withColumn("id_set", ids).dropDuplicates([key, "id_set"])


def confidence(ground: Column, top_score: Column, sources: Column, conflicted: Column) -> tuple[Column, Column]:
    """Level and reason from groundedness, best score of ten, number of sources and conflict."""
    n, g = _text(sources), _text(ground)
    none = F.lit("no record scored above the relevance threshold")

    def chain(empty, high, contested, moderate, low, otherwise) -> Column:
        return (
            F.when(sources == 0, empty)
            .when((ground >= 90) & (top_score >= 7.5) & (sources >= 3) & ~conflicted, high)
            .when(conflicted, contested).when(ground >= 70, moderate).when(ground >= 40, low).otherwise(otherwise))

    level = chain(*[F.lit(v) for v in ("insufficient", "high", "moderate", "moderate", "low", "insufficient")])
    reason = chain(
        none, F.concat(F.lit("High — "), n, F.lit(" sources, groundedness "), g, F.lit("%, no conflicts")),
        F.concat(F.lit("Moderate — "), n, F.lit(" sources, 1 unresolved conflict, chain of custody incomplete")),
        F.concat(F.lit("Moderate — "), n, F.lit(" sources, groundedness "), g, F.lit("%")),
        F.concat(F.lit("Low — "), n, F.lit(" sources, groundedness "), g, F.lit("%")), none)
    return level, reason


def simple_confidence(cited: Column, top: Column, disputed: Column) -> Column:
    """Level for a plain answer: cited records, best display score, disputed records among the cited."""
    return (
        F.when(cited == 0, F.lit("insufficient")).when(disputed > 0, F.lit("moderate"))
        .when((cited >= 3) & (top >= 0.55), F.lit("high")).when(cited >= 2, F.lit("moderate")).otherwise(F.lit("low")))


def first_three(evidence: DataFrame, key: str = "report_id") -> DataFrame:
    """The best three by display score ``shown``."""
    return top_n(evidence, [key], [F.desc("shown"), F.asc("rnk")], 3, "r")
