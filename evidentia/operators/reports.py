"""Report assembly: sections, priority, sufficiency, histories and nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia import params as P
from evidentia.functions import labels as L
from evidentia.functions.bounds import first_per, unroll

NO_CONTENT = "No content was produced for this section."
NOT_APPLICABLE = "Not applicable to this query"


def map_priority(reports: DataFrame) -> DataFrame:
    """Normalise the class; a W class without a citation becomes informational."""
    cls = L.priority_class(F.col("priority_class"))
    citation = F.nullif(F.trim("priority_citation"), F.lit(""))
    down = (cls != "informational") & citation.isNull()
    return reports.withColumn("class", F.when(down, F.lit("informational")).otherwise(cls)).withColumn(
        "label", F.when(down, F.lit("OBSERVATION")).otherwise(F.coalesce(F.nullif("priority_label", F.lit("")), F.lit("OBSERVATION")))).withColumn(
        "reason", F.coalesce(F.nullif("priority_reason", F.lit("")), F.when(down, F.lit("Severity could not be attributed to a corpus record.")).otherwise(F.lit("")))).withColumn(
        "citation", F.when(~down, citation))


def map_sections(sections: DataFrame) -> DataFrame:
    """Known section types only; unknown status, owner and missing reasons take safe defaults."""
    kind = L.one_of(F.col("section_type"), P.SECTION_TYPES, None)
    status = L.one_of(F.col("status"), P.SECTION_STATUSES, "empty")
    status = F.coalesce(status, F.lit("empty"))
    owner = F.coalesce(L.one_of(F.col("owning_agent"), P.OWNING_AGENTS, "orchestrator"), F.lit("orchestrator"))
    rows = sections.withColumn("section_type", kind).where("section_type IS NOT NULL").withColumn("status", status).withColumn("owning_agent", owner)
    reason = F.when(F.col("status") == "filled", F.lit(None)).otherwise(F.coalesce(F.nullif("empty_reason", F.lit("")), F.lit(NO_CONTENT)))
    return rows.withColumn("empty_reason", reason).withColumn("content", F.coalesce("content", F.lit("")))


def complete_sections(reports: DataFrame, sections: DataFrame) -> DataFrame:
    """Three sections per report in display order; a missing one is not applicable."""
    slots = F.array(*[F.struct(F.lit(s).alias("section_type"), F.lit(order).alias("display_order")) for _, s, order, *_ in P.PROFILES])
    wanted = reports.select("report_id", F.explode(slots).alias("s")).select("report_id", "s.*")
    rows = wanted.join(sections.drop("display_order"), ["report_id", "section_type"], "left")
    return rows.withColumn("empty_reason", F.when(F.col("status").isNull(), F.lit(NOT_APPLICABLE)).otherwise(F.col("empty_reason"))).withColumn(
        "owning_agent", F.coalesce("owning_agent", F.lit("orchestrator"))).withColumn(
        "status", F.coalesce("status", F.lit("not_applicable"))).withColumn("content", F.coalesce("content", F.lit("")))


def sufficiency(top_score: Column, groundedness: Column, gates: Column, citations: Column, filled: Column, threshold: float) -> Column:
    """Any one of weak retrieval, no grounded claim, no citation or nothing filled makes a report insufficient."""
    return ~((top_score < threshold * 10) | ((groundedness == 0) & (gates > 0)) | (citations == 0) | (filled == 0))


def flatten_history(reports: DataFrame, sections: DataFrame) -> DataFrame:
    """Plain text of a report for the next turn: priority, then each section's content or reason."""
    body = F.when((F.col("status") == "filled") & (F.col("content") != ""), F.col("content")).otherwise(F.col("empty_reason"))
    rows = sections.select("report_id", "display_order", F.concat("section_type", F.lit(": "), body).alias("part")).where("part IS NOT NULL")
    texts = rows.groupBy("report_id").agg(F.expr("listagg(part, '\n\n') within group (order by display_order)").alias("parts"))
    head = F.when(F.col("reason") != "", F.concat(F.lit("["), "label", F.lit("] "), "reason"))
    text = F.nullif(F.concat_ws("\n\n", head, "parts"), F.lit(""))
    return reports.join(texts, "report_id", "left").select("report_id", F.coalesce(text, F.lit("No report content was produced.")).alias("history"))


def degraded_comparison(sections: DataFrame, title: str, content: str, key: str = "report_id", order: str = "pos") -> DataFrame:
    part = F.concat(F.lit("### "), title, F.lit("\n\n"), content)
    return sections.select(key, order, part.alias("part")).groupBy(key).agg(
        F.expr(f"listagg(part, '\n\n---\n\n') within group (order by {order})").alias("text"))


def with_steps(reports: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """Each report beside its own steps as rows; a report without steps keeps one row.

    Rows, not an array: a report may have very many steps. The inner join lets AQE split
    a hot report on the side of the steps, which an outer join would not.
    """
    matched = reports.join(steps, key)
    alone = reports.join(steps.select(key).distinct(), key, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def latest_per(rows: DataFrame, key: str, when: str, columns: list[str]) -> DataFrame:
    """Latest row per key by a partial maximum, no window over the whole history."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), when).alias("r")).select(key, "r.*")


def resolve_conversations(requests: DataFrame, conversations: DataFrame, title_chars: int = 200) -> DataFrame:
    """The user's own conversation where it exists, else a new one under the given ID titled by the question."""
    own = conversations.select("id", "user_id", F.col("title").alias("old_title"))
    joined = requests.join(own, [requests.conversation_id == own.id, requests.user_id == own.user_id], "left")
    return joined.select(
        requests.conversation_id, requests.user_id, own.id.isNull().alias("created"),
        F.coalesce(own.old_title, F.substring(requests.question, 1, title_chars)).alias("title"))


def resolve_document_id(raw: Column, slug: str, fixed: str) -> Column:
    return F.when(raw == slug, F.lit(fixed)).when(raw.rlike(P.UUID), F.lower(raw))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def evolve_answers(answers: DataFrame) -> DataFrame:
    """Bring answer rows of the earlier layout to the present one: new columns with defaults, renamed confidence."""
    defaults = {"assembly_mode": "sitrep", "priority_class": "informational", "had_conflict": False, "was_partial": False,
                "llm_call_count": 0}
    out = answers
    for name, value in defaults.items():
        have = F.col(name) if name in out.columns else F.lit(None)
        out = out.withColumn(name, F.coalesce(have, F.lit(value)))
    return out.withColumn("confidence", L.confidence_level(F.col("confidence")))


def domain_violations(rows: DataFrame, key: str, domains: dict[str, list[str]]) -> DataFrame:
    """(key, column, value) of every value outside its domain."""
    bad = F.array(*[
        F.when(~F.col(c).isin(allowed), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c, allowed in domains.items()])
    return unroll(rows, [key], F.filter(bad, lambda b: b.isNotNull()), "b").select(key, "b.*")


def affected_regions(reports: DataFrame, evidence: DataFrame, supplied: str) -> DataFrame:
    """Supplied regions, else the sorted distinct regions of the evidence (a bounded domain)."""
    found = evidence.groupBy("report_id").agg(F.array_sort(F.collect_set("region_id")).alias("found"))
    given = F.when(F.size(supplied) > 0, F.col(supplied))
    return reports.join(found, "report_id", "left").select("report_id", F.coalesce(given, "found", F.array().cast("array<string>")).alias("regions"))


def keep_first_citation(rows: DataFrame) -> DataFrame:
    return first_per(rows, ["report_id", "citation_id"], [F.asc("rnk")])


def nest(reports: DataFrame, sections: DataFrame, citations: DataFrame, rules: DataFrame, conflicts: DataFrame, key: str = "report_id") -> DataFrame:
    """One row per report with all that belongs to it as ordered arrays of structs.

    Each kind is summed up by report once and joined; a report has three sections, eight rules, and as many citations and
    conflicts as its evidence has rows. What a report has none of is an empty array.
    """

    def listed(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
        return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    parts = {
        "sections": (sections, ["display_order", "section_type", "status", "owning_agent", "content", "empty_reason"]),
        "citations": (citations, ["marker", "citation_id", "chunk_id", "record_type", "title", "page", "evidence_quality"]),
        "rules": (rules, ["number", "name", "passed", "detail"]),
        "conflicts": (conflicts, ["record_ids", "reliability_limitation", "positions"]),
    }
    out = reports
    for name, (rows, columns) in parts.items():
        out = out.join(listed(rows, name, columns), key, "left").withColumn(name, F.coalesce(F.col(name), F.array()))
    return out


def seed_preloaded(documents: DataFrame, row: dict) -> DataFrame:
    """``documents`` with the preloaded document, unless one has its ID: seeding twice adds one row."""
    spark = documents.sparkSession
    fields = [f for f in documents.schema.fields if f.name in row]
    given = spark.range(1).select(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in fields])
    new = given.join(documents.select("id"), "id", "left_anti")
    return documents.unionByName(new, allowMissingColumns=True)
