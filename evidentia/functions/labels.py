"""Classification expressions over record type, title and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia import params as P
from evidentia.functions.text import contains_any, group


def lookup(value: Column, table: dict[str, str]) -> Column:
    """A bounded literal map; NULL for an unknown key."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), value)


def record_type(record_id: Column, prefixes: dict[str, str] | None = None) -> Column:
    return lookup(F.upper(F.split_part(record_id, F.lit("-"), F.lit(1))), prefixes or P.PREFIX_TYPES)


def region_listed(text: Column, regions: dict[str, str] | None = None) -> Column:
    """Region ID of the first listed name that occurs."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(n), F.lit(i)) for n, i in (regions or P.REGIONS).items()])


def region_earliest(text: Column, regions: dict[str, str] | None = None) -> Column:
    """Region ID whose name occurs first in the text."""
    low = F.lower(text)
    hits = F.array(*[
        F.struct(F.instr(low, n).alias("at"), F.lit(k).alias("k"), F.lit(i).alias("id"))
        for k, (n, i) in enumerate((regions or P.REGIONS).items())
    ])
    return F.array_min(F.filter(hits, lambda h: h["at"] > 0))["id"]


def risk_level(text: Column) -> Column:
    return F.lower(group(text, r"Initial risk level:\s*([A-Z]+)", 1))


def severity(kind: Column, text: Column) -> Column:
    stated = F.lower(group(text, r"(?i)initial risk level:\s*(CRITICAL|HIGH|MEDIUM|LOW)", 1))
    low = F.lower(text)
    return (
        F.when(stated.isNotNull(), stated)
        .when(kind == "incident", F.lit("medium"))
        .when(low.rlike(r"\bw4\b|regional crisis"), F.lit("critical"))
        .when(low.rlike(r"\bw3\b|emergency") & (kind != "accommodation"), F.lit("high"))
        .otherwise(F.lit("none"))
    )


def evidence_quality(kind: Column, text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(contains_any(low, P.DISPUTED_PHRASES), F.lit("disputed report"))
        .when((kind == "incident") | low.contains("these are hypotheses"), F.lit("provisional interpretation"))
        .when(kind == "monitoring", F.lit("verified observation"))
        .when(contains_any(low, P.TRADITION_PHRASES), F.lit("community tradition"))
        .when(contains_any(low, P.MODELED_PHRASES), F.lit("modeled estimate"))
        .otherwise(F.lit("verified observation"))
    )


def evidence_quality_strict(kind: Column, text: Column) -> Column:
    """Second rule set: only concrete custody failures dispute, and definitions are exempt."""
    low = F.lower(text)
    defines = kind.isin("chapter", "section", "appendix")
    return (
        F.when(~defines & contains_any(low, P.STRICT_DISPUTED_PHRASES), F.lit("disputed report"))
        .when(contains_any(low, P.STRICT_PROVISIONAL_PHRASES), F.lit("provisional interpretation"))
        .when(contains_any(low, P.STRICT_TRADITION_PHRASES), F.lit("community tradition"))
        .when((kind == "monitoring") & low.rlike(P.STRICT_TABLE_COMMENTS), F.lit("disputed report"))
        .when(kind == "monitoring", F.lit("verified observation"))
        .when(kind.isin("policy", "knowledge_card"), F.lit("documented protocol"))
        .when(contains_any(low, ["modeled", "estimate"]), F.lit("modeled estimate"))
        .when(kind.isin("health", "shared_protocol"), F.lit("documented protocol"))
        .otherwise(F.lit("verified observation"))
    )


def access_class(kind: Column, text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(contains_any(low, ["sacred", "restricted knowledge", "without consent"]), F.lit("community-limited"))
        .when(kind == "health", F.lit("healer-limited"))
        .when((kind == "flora") & low.rlike("healer|dose|infusion|toxic|medicinal"), F.lit("healer-limited"))
        .when(kind == "incident", F.lit("guardian-limited"))
        .otherwise(F.lit("public"))
    )


def navigational(title: Column, section: Column) -> Column:
    return F.lower(title).rlike(P.NAVIGATIONAL_TITLES) | F.coalesce(section.rlike(P.NAVIGATIONAL_SECTION), F.lit(False))


def retrieval_prior(kind: Column, is_navigational: Column) -> Column:
    prior = F.when(is_navigational, F.lit(P.NAVIGATIONAL_PRIOR))
    for name, weight in P.PRIORS.items():
        prior = prior.when(kind == name, F.lit(weight))
    return prior.otherwise(F.lit(1.0))


def triage_boost(level: Column, triage: Column) -> Column:
    boost = F.when(~triage, F.lit(1.0))
    for name, weight in P.TRIAGE_BOOST.items():
        boost = boost.when(level == name, F.lit(weight))
    return boost.otherwise(F.lit(1.0))


def limitation(text: Column) -> Column:
    low = F.lower(text)
    first, *rest = P.LIMITATIONS
    out = F.when(low.contains(first[0]), F.lit(first[1]))
    for needle, label in rest:
        out = out.when(low.contains(needle), F.lit(label))
    return out.otherwise(F.lit(P.DEFAULT_LIMITATION))


def confidence_level(raw: Column) -> Column:
    return F.coalesce(lookup(F.lower(F.trim(raw)), P.CONFIDENCE_LEVELS), F.lit("insufficient"))


def priority_class(raw: Column) -> Column:
    return F.coalesce(lookup(F.lower(F.trim(raw)), P.PRIORITY_CLASSES), F.lit("informational"))


def one_of(raw: Column, domain: list[str], default: str | None) -> Column:
    value = F.lower(F.trim(raw))
    return F.when(value.isin(domain), value).otherwise(F.lit(default))
