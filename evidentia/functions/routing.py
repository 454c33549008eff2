"""Question analysis: identifiers, hints, shape, mode and roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.bounds import unroll
from evidentia import params as P
from evidentia.functions.labels import one_of
from evidentia.functions.text import contains_any, find_all

STRINGS = "array<string>"


def question_ids(question: Column, supplied: Column, pattern: str) -> Column:
    """Supplied IDs and those named in the question; malformed ones dropped."""
    bare = pattern.replace(r"\b", "").replace("(", "^(").replace(")", ")$")
    merged = F.array_union(F.coalesce(supplied, F.array().cast(STRINGS)), find_all(question, pattern))
    return F.filter(merged, lambda x: x.rlike(bare))


def type_hints(question: Column) -> Column:
    """Record types suggested by the wording; NULL when none is."""
    low = F.lower(question)
    groups = F.array(*[
        F.when(contains_any(low, words), F.array(*[F.lit(t) for t in kinds])) for words, kinds in P.TYPE_HINTS
    ])
    hit = F.array_distinct(F.flatten(F.filter(groups, lambda g: g.isNotNull())))
    return F.when(F.size(hit) > 0, hit)


def is_comparison(question: Column) -> Column:
    return contains_any(F.lower(question), P.COMPARE_TERMS)


def query_shape(question: Column, given: Column) -> Column:
    low = F.lower(question)
    return (
        F.when(contains_any(low, P.COMPARE_TERMS), F.lit("compare"))
        .when(contains_any(low, P.SUMMARISE_TERMS) & (given == "simple"), F.lit("summarize"))
        .otherwise(given)
    )


def is_triage(question: Column) -> Column:
    return question.rlike(P.TRIAGE_INTENT)


def has_incident_shape(question: Column) -> Column:
    return contains_any(F.lower(question), P.INCIDENT_TERMS)


def aspects(question: Column) -> Column:
    """Sides of a comparison, the carrier phrase of the first put before the others."""
    first_hit = "(?s)^(.*?)" + P.COMPARISON_INTENT.replace("(?i)", "(?i:") + ")"
    stripped = F.regexp_replace(question, first_hit, "$1")
    stripped = F.trim(F.regexp_replace(F.regexp_replace(stripped, r"^[\s,:-]+", ""), r"\?+$", ""))
    sides = F.transform(F.split(stripped, P.ASPECT_SPLIT), lambda p: F.trim(p))
    sides = F.filter(sides, lambda p: F.size(F.split(p, r"\s+")) >= 2)
    words = F.split(F.get(sides, F.lit(0)), r"\s+")
    carrier = F.when(F.size(words) > 4, F.array_join(F.slice(words, F.lit(1), F.size(words) - 2), " "))
    joined = F.transform(
        sides, lambda p, i: F.when((i == 0) | carrier.isNull(), p).otherwise(F.concat(carrier, F.lit(" "), p)))
    return F.when(question.rlike(P.COMPARISON_INTENT) & (F.size(sides) >= 2), joined).otherwise(F.array().cast(STRINGS))


def rewritten_text(question: Column, rewritten: Column | None) -> Column:
    """The rewritten question where there is one."""
    return question if rewritten is None else F.coalesce(F.nullif(F.trim(rewritten), F.lit("")), question)


def sub_queries(question: Column, supplied: Column | None = None, rewritten: Column | None = None) -> Column:
    """Two sides of a comparison: the first two that were supplied, else the rewritten question and then the question as
    asked, cut at the first separator that leaves more than eight characters on both sides, else one text twice."""
    tries = []
    if supplied is not None:
        given = F.filter(F.transform(supplied, lambda s: F.trim(s)), lambda s: s != "")
        tries.append(F.when(F.size(given) >= 2, F.slice(given, 1, 2)))
    text = rewritten_text(question, rewritten)
    for source in [text] if rewritten is None else [text, question]:
        for sep in P.SUBQUERY_SEPARATORS:
            at = F.instr(source, sep)
            head = F.trim(F.substring(source, F.lit(1), at - 1))
            tail = F.trim(source.substr(at + len(sep), F.length(source)))
            tries.append(F.when((at > 0) & (F.length(head) > 8) & (F.length(tail) > 8), F.array(head, tail)))
    return F.coalesce(*tries, F.array(text, text))


def expansions(question: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    low = F.lower(question)
    groups = F.array(*[
        F.when(low.contains(term), F.array(*[F.lit(s) for s in words]))
        for term, words in (synonyms or P.SYNONYMS).items()
    ])
    return F.array_distinct(F.flatten(F.filter(groups, lambda g: g.isNotNull())))


def query_variants(question: Column) -> Column:
    """The question, its synonym expansion, and a probe of the identifiers it names."""
    extra = expansions(question)
    ids = find_all(F.upper(question), P.PROBE_ID)
    return F.filter(
        F.array(
            question,
            F.when(F.size(extra) > 0, F.concat(question, F.lit(" "), F.array_join(extra, " "))),
            F.when(F.size(ids) > 0, F.array_join(ids, " ")),
        ),
        lambda v: v.isNotNull(),
    )


def classification(rows: DataFrame, payload: str = "payload", question: str = "question") -> DataFrame:
    """Tolerant reading of a classification payload: malformed JSON, scalars for lists and unknown labels get defaults."""
    v = F.try_parse_json(payload)

    def text(path: str) -> Column:
        return F.trim(F.coalesce(F.try_variant_get(v, f"$.{path}", "string"), F.lit("")))

    def listed(path: str) -> Column:
        items = F.coalesce(F.try_variant_get(v, f"$.{path}", "array<string>"), F.array(text(path)))
        return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))

    severity = text("severity_class")
    return rows.select(
        "*", rewritten_text(F.col(question), text("rewritten_query")).alias("rewritten"),
        F.when(severity.isin("W1", "W2", "W3", "W4", "Informational"), severity).otherwise(F.lit("Informational")).alias("severity_class"),
        text("severity_reason").alias("severity_reason"), text("severity_citation").alias("severity_citation"),
        F.coalesce(one_of(text("query_shape"), P.QUERY_SHAPES, "simple"), F.lit("simple")).alias("query_shape"),
        F.when(text("use_case").isin(P.USE_CASES), text("use_case")).otherwise(F.lit(P.USE_CASES[0])).alias("use_case"),
        F.slice(listed("variants"), 1, 2).alias("variants"), listed("record_ids").alias("record_ids"), listed("region_ids").alias("region_ids"),
        F.slice(listed("sub_queries"), 1, 2).alias("sub_queries"))


def focused_owner(question: Column) -> Column:
    low = F.lower(question)
    ids = find_all(question, P.QUESTION_RECORD_ID)

    def names(prefix: str) -> Column:
        return F.exists(ids, lambda i: i.rlike(f"^(?:{prefix})-"))

    protector, investigator, responder = (F.lit(p[0]) for p in P.PROFILES)
    return (
        F.when(names("FAU|FLR"), protector)
        .when(names("MED|KC"), responder)
        .when(names("INC|WS|FN|LAB|SV"), investigator)
        .when(contains_any(low, P.ACTION_TERMS), responder)
        .when(contains_any(low, P.SPECIES_TERMS), protector)
        .when(contains_any(low, P.CAUSE_TERMS), investigator)
        .otherwise(investigator)
    )


def dispatch_mode(question: Column, severity: Column, forced: Column, shape: Column | None = None) -> Column:
    """Forced mode, else by comparison (as classified in ``shape`` or worded), severity and wording."""
    compared = is_comparison(question) if shape is None else (F.coalesce(shape, F.lit("")) == "compare") | is_comparison(question)
    return (
        F.when(forced.isin("sitrep", "focused", "compare"), forced)
        .when(compared, F.lit("compare"))
        .when(severity.isin("W1", "W2", "W3", "W4"), F.lit("sitrep"))
        .when(has_incident_shape(question), F.lit("sitrep"))
        .otherwise(F.lit("focused"))
    )


def with_roster(rows: DataFrame) -> DataFrame:
    """(owner, sub_question) rows for ``mode`` and ``question``: three, two distinct, or one.

    A classified question brings its ``sub_queries`` and ``rewritten`` text along.

    Each step is a column of its own, so the split and the owners are evaluated once.
    """
    protector, investigator, responder = (p[0] for p in P.PROFILES)
    compare = F.col("mode") == "compare"
    supplied, rewritten = (F.col(c) if c in rows.columns else None for c in ("sub_queries", "rewritten"))
    staged = rows.withColumn("__subs", F.when(compare, sub_queries(F.col("question"), supplied, rewritten)).otherwise(F.array("question")))
    staged = staged.withColumn("__a", F.get("__subs", F.lit(0))).withColumn("__b", F.get("__subs", F.lit(1)))
    staged = staged.withColumn("__first", focused_owner(F.col("__a"))).withColumn("__second", F.when(compare, focused_owner(F.col("__b"))))
    second = F.when(F.col("__first") != F.col("__second"), F.col("__second")).when(
        F.col("__first") == investigator, F.lit(responder)).otherwise(F.lit(investigator))

    def row(owner: Column, text: str) -> Column:
        return F.struct(owner.alias("owner"), F.col(text).alias("sub_question"))

    picks = (
        F.when(F.col("mode") == "sitrep", F.array(*[row(F.lit(o), "question") for o in (protector, investigator, responder)]))
        .when(compare, F.array(row(F.col("__first"), "__a"), row(second, "__b"))).otherwise(F.array(row(F.col("__first"), "__a"))))
    return unroll(staged, [*rows.columns], picks, "__r").select(*rows.columns, F.col("__r.owner").alias("roster_owner"), "__r.sub_question")
