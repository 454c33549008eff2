"""Golden cases: routing, confidence, merging, conflicts, splitting, hashing."""

import pytest
from pyspark.sql import functions as F

from evidentia import params as P
from evidentia.functions import routing as R
from evidentia.functions import text as X
from evidentia.functions import vectors as V
from evidentia.operators import grounding as G
from evidentia.operators import structure as C


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("ground,top,sources,conflict,level", [
    (96, 8.0, 5, False, "high"), (96, 8.0, 5, True, "moderate"), (75, 6.0, 3, False, "moderate"),
    (50, 5.0, 2, False, "low"), (10, 5.0, 1, False, "insufficient"), (100, 9.0, 0, False, "insufficient")])
def test_confidence(spark, ground, top, sources, conflict, level):
    col, _ = G.confidence(F.col("g"), F.col("t"), F.col("s"), F.col("c"))
    assert one(spark, col, g=ground, t=top, s=sources, c=conflict) == level


@pytest.mark.parametrize("text,severity,forced,mode,owner", [
    ("Compare the recommended responses for two events", "informational", None, "compare", None),
    ("difference between INC-001 and INC-005", "informational", None, "compare", None),
    ("coral loss versus storm damage", "informational", None, "compare", None),
    ("anything at all", "W3", None, "sitrep", None),
    ("The water has turned turquoise and the fish are leaving the area", "informational", None, "sitrep", None),
    ("what is the approach distance for a Deepbell Singer?", "informational", None, "focused", None),
    ("anything", "W4", "focused", "focused", None),
    ("which species are vulnerable?", "informational", None, "focused", "marine_life_protector"),
    ("tell me about FAU-014", "informational", None, "focused", "marine_life_protector"),
    ("what should we do about the spill?", "informational", None, None, "emergency_responder"),
    ("immediate actions for MED-003?", "informational", None, None, "emergency_responder"),
    ("what caused the turquoise water?", "informational", None, None, "incident_investigator"),
    ("investigate the readings at WS-03", "informational", None, None, "incident_investigator"),
    ("hmm", "informational", None, "focused", "incident_investigator")])
def test_routing(spark, text, severity, forced, mode, owner):
    forced_col = F.lit(forced).cast("string")
    if mode:
        assert one(spark, R.dispatch_mode(F.col("q"), F.col("s"), forced_col), q=text, s=severity) == mode
    if owner:
        assert one(spark, R.focused_owner(F.col("q")), q=text) == owner


def test_merge_rules(spark):
    rows = spark.createDataFrame(
        [(1, 1, 1, "n", True, "9/9"), (1, 2, 1, "n", False, "1/2"), (1, 1, 2, "m", True, "rule not engaged"), (1, 2, 2, "m", True, "hedged")],
        "report_id int, pos int, number int, name string, passed boolean, detail string")
    got = {r.number: (r.passed, r.detail) for r in G.merge_rules(rows).collect()}
    assert got == {1: (False, "1/2"), 2: (True, "hedged")}
    gates = spark.createDataFrame([(1, 1, 100, 2, 2, []), (1, 2, 50, 2, 1, ["x"])], "report_id int, pos int, groundedness int, claim_count int, supported_claim_count int, unsupported array<string>")
    assert G.merge_groundedness(gates).first()["groundedness"] == 75


def test_conflicts(spark):
    rows = [(1, i, f"FN-{c}", "disputed report", text) for i, (c, text) in enumerate([("A", "bloom"), ("B", "waste"), ("C", "chain of custody")])]
    rows += [(2, 0, "FN-A", "disputed report", "x"), (3, 0, "A-1", "verified observation", "x"), (3, 1, "A-2", "verified observation", "y")]
    ev = spark.createDataFrame(rows, "report_id int, rnk int, citation_id string, evidence_quality string, content string")
    got = G.conflicts(ev).collect()
    assert len(got) == 1 and got[0].record_ids == ["FN-A", "FN-B", "FN-C"] and len(got[0].positions) == 3
    assert "chain of custody" in got[0].reliability_limitation


def test_hash(spark):
    for text, value in [("a", 3826002220), ("foobar", 3214735720), ("water_color", 3084058096)]:
        assert one(spark, V.fnv1a(F.col("t")), t=text) == value


def test_hashed_vector_pairs(spark):
    """The batched helper hashes words and pairs as the column expression does."""
    texts = ["Water color changes", "a", "", "x-ray INC-005 seen", "water water water"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", V.hashed_vector(F.col("t")).alias("v"), V.gram_buckets(F.col("t")).alias("b")).collect()
    for r in rows:
        assert {k for k, x in enumerate(r.v) if x > 0} == set(r.b)
        assert abs(sum(x * x for x in r.v) - (1 if r.b else 0)) < 1e-9


def test_sentence_split(spark):
    text = "INC-005. Then 2026-06-14. Next claim [A].  - item? Yes"
    assert one(spark, F.split("t", P.SENTENCE_SPLIT), t=text) == ["INC-005.", "Then 2026-06-14.", "Next claim [A].", "- item?", "Yes"]


def test_citation_markers(spark):
    text = "cites [INC-005] and [FN-A], not [inc-1] [SEC-2]"
    assert one(spark, X.citation_markers(F.col("t")), t=text) == ["INC-005", "FN-A", "SEC-2"]


def test_tokens(spark):
    assert one(spark, X.tokens(F.col("t")), t="INC-005 blooms while sampling the glass") == [
        "inc-005", "inc", "005", "5", "blooms", "bloom", "while", "sampling", "sampl", "glass"]


def test_claims_skip_templates(spark):
    answer = "\n".join([
        "# Heading that is long enough to be taken", "At [time] we observed a change of water here.", "Avoid entering restricted areas of the bay.", "",
        "The reef lost a third of its cover in one season [INC-001].", "Observed facts, as documented by the wardens:",
        "**Model inference:** A storm could explain the loss of the cover."])
    df = spark.createDataFrame([(1, answer)], "k int, answer string")
    got = [(r.kind, r.text) for r in G.claims(df, ["k"]).collect()]
    assert got == [("claim", "The reef lost a third of its cover in one season [INC-001]."), ("inference", "Model inference:** A storm could explain the loss of the cover.")]


def test_date_forms(spark):
    for text in ["seen 2026-03-14", "14 March 2026", "Mar 14, 2026", "2026/03/14"]:
        assert one(spark, X.date_present(F.col("d"), F.col("t")), d="2026-03-14", t=text), text
    assert not one(spark, X.date_present(F.col("d"), F.col("t")), d="2026-03-14", t="in March of 2026")


def test_record_ends_at_level_three_or_two(spark):
    text = ["## 6. Flora", "### FLR-020 — Reed", "body", "### 6.21 Notes", "more", "## 7. Next"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "doc_id string, line_no long, text string")
    deep = C.record_chunks(lines).first()
    assert "6.21" not in deep.content and deep.chapter == "6 · Flora" and deep.record_type == "flora"
    assert "6.21" in C.record_chunks(lines, end_level=2).first().content
