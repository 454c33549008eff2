"""Operator inputs rendered from the driver tables.

Each input is one SELECT in the dialect that Spark SQL and DuckDB share, so that
the Spark query and its check read identical rows. ``{name}`` stands for a
driver table or another input. Nothing is sampled: every row of the source
tables takes part.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia import params as P
from evidentia.functions.bounds import spread_by, unroll

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

NL = "chr(10)"


def _case(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


def _lines(key: str, source: str, base: str, rows: list[tuple[int, str]]) -> dict[str, str]:
    """Turn one source row into many lines: array of structs, exploded in each engine."""
    spark_rows = ", ".join(f"named_struct('k', {k}, 't', {t})" for k, t in rows)
    duck_rows = ", ".join(f"{{'k': {k}, 't': {t}}}" for k, t in rows)
    spark = (
        f"SELECT doc_id, CAST(base + v.k AS BIGINT) AS line_no, v.t AS text FROM "
        f"(SELECT {key} AS doc_id, {base} AS base, explode(array({spark_rows})) AS v FROM {source}) x "
        "WHERE v.t IS NOT NULL"
    )
    duck = (
        f"SELECT doc_id, CAST(base + v.k AS BIGINT) AS line_no, v.t AS text FROM "
        f"(SELECT {key} AS doc_id, {base} AS base, unnest([{duck_rows}]) AS v FROM {source}) x "
        "WHERE v.t IS NOT NULL"
    )
    return {"spark": spark, "duck": duck}


_REGION = _case("CAST(o_custkey % 10 AS INT)", [n.title() for n in P.REGIONS])
_RISK = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' "
    "WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' END"
)
_PREFIX = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'INC' WHEN '2-HIGH' THEN 'MED' "
    "WHEN '3-MEDIUM' THEN 'FAU' WHEN '4-NOT SPECIFIED' THEN 'KC' ELSE 'POL' END"
)
_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_STATUS = (
    "CASE o_orderstatus WHEN 'O' THEN 'The chain of custody was incomplete for this lot.' "
    "WHEN 'F' THEN 'Elders keep a community tradition about this route.' "
    "ELSE 'An estimate of the load is projected for the season.' END"
)

RENDERED: dict[str, str | dict[str, str]] = {}

# Markdown register: one document per customer, one record per order.
ORDER_LINES = [
    (1, f"CASE WHEN o_orderkey % 4 = 0 THEN concat('[[PAGE ', CAST(floor(o_orderkey / 4) + 1 AS BIGINT), ']]') END"),
    (2, "CASE WHEN o_orderkey % 6 = 0 THEN concat('## ', o_orderkey % 17 + 1, '. Orders of quarter ', o_orderkey % 4) END"),
    (3, f"concat('### ', CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Knowledge Card ' ELSE '' END, {_PREFIX}, '-', o_orderkey, ' — Order in state ', o_orderstatus)"),
    (4, f"CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN concat('Initial risk level: ', {_RISK}) END"),
    (5, f"concat('  Reported in the ', {_REGION}, ' on ', {_DAY}, '.  ')"),
    (6, "''"),
    (7, _STATUS),
    (8, "'Responders must keep the exclusion boundary closed until two consecutive samples are clear.'"),
    (9, "CASE WHEN o_orderkey % 7 = 0 THEN concat('[INC-', o_orderkey + 1, '] is a related record.') END"),
    (10, "CASE WHEN o_orderkey % 5 = 0 THEN concat('### 6.', o_orderkey % 30, ' Supply notes') END"),
    (11, "CASE WHEN o_orderkey % 5 = 0 THEN repeat('Supply remarks for the season are kept here. ', CAST(1 + o_orderkey % 8 AS INT)) END"),
    (12, f"CASE WHEN o_orderkey % 3 = 0 THEN concat('| WS-', o_orderkey % 90, ' | ', {_REGION}, ' | ', {_DAY}, ' | ', CASE WHEN o_orderstatus = 'P' THEN 'Low' ELSE '24.1' END, ' | clear |') END"),
    (13, "CASE WHEN o_orderkey % 10 = 0 THEN concat('Field Note FN-A, observer ', o_orderkey, ' saw a plankton  bloom near the pier on 2026-06-14.') END"),
    (14, "CASE WHEN o_orderkey % 10 = 0 THEN 'Laboratory Note LAB-C. The sample held carbonates but the form was incomplete.' END"),
]
RENDERED["order_lines"] = _lines("concat('C', o_custkey)", "{orders}", "o_orderkey * 32", ORDER_LINES)
RENDERED["record_lines"] = """
    SELECT concat('C', c_custkey) AS doc_id, CAST(-3 AS BIGINT) AS line_no, concat('# ', c_name) AS text FROM {customer}
    UNION ALL
    SELECT concat('C', c_custkey), CAST(-2 AS BIGINT), concat('## ', c_nationkey + 1, '. Register of nation ', c_nationkey) FROM {customer}
    UNION ALL
    SELECT concat('C', c_custkey), CAST(-1 AS BIGINT), concat(repeat('This register lists the orders of one customer. ', 5), c_mktsegment) FROM {customer}
    UNION ALL
    SELECT doc_id, line_no, text FROM {order_lines}
"""
# The same lines, those of an order or a customer in one text.
RENDERED["record_texts"] = f"""
    SELECT concat('C', c_custkey) AS doc_id, CAST(-3 AS BIGINT) AS line_no, concat_ws({NL}, concat('# ', c_name),
      concat('## ', c_nationkey + 1, '. Register of nation ', c_nationkey),
      concat(repeat('This register lists the orders of one customer. ', 5), c_mktsegment)) AS text FROM {{customer}}
    UNION ALL
    SELECT concat('C', o_custkey), CAST(o_orderkey * 32 AS BIGINT), concat_ws({NL}, {", ".join(t for _, t in ORDER_LINES)}) FROM {{orders}}
"""
_CUSTOMER_LINES = [
    (-3, "concat('# ', c_name)"),
    (-2, "concat('## ', c_nationkey + 1, '. Register of nation ', c_nationkey)"),
    (-1, "concat(repeat('This register lists the orders of one customer. ', 5), c_mktsegment)"),
]
#: Rows of orders and customers whose lines a task holds.
REGISTER_ROWS = 1 << 17


def register_lines(customers: DataFrame, orders: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """The lines of ``record_lines``, each document in one task: the narrow rows are shuffled and rendered where they arrive.

    The documents ``without`` are left out before that.
    """
    a = orders.selectExpr("concat('C', o_custkey) AS doc_id", "o_orderkey * 32 AS base", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    b = customers.selectExpr("concat('C', c_custkey) AS doc_id", "c_name", "c_nationkey", "c_mktsegment", "true AS heads")
    rows = a.unionByName(b, allowMissingColumns=True)
    rows = rows if without is None else rows.join(without, "doc_id", "left_anti")
    rows = spread_by(rows, "doc_id", least=-(-(customers.count() + orders.count()) // REGISTER_ROWS))
    array = lambda lines: "array(" + ", ".join(f"named_struct('k', {k}, 't', {t})" for k, t in lines) + ")"
    lines = unroll(rows, ["doc_id", "base", "heads"], F.expr(f"CASE WHEN heads THEN {array(_CUSTOMER_LINES)} ELSE {array(ORDER_LINES)} END"), "line")
    line_no = F.when(F.col("heads"), F.col("line.k")).otherwise(F.col("base") + F.col("line.k"))
    return lines.where("heads OR line.t IS NOT NULL").select("doc_id", line_no.cast("bigint").alias("line_no"), F.col("line.t").alias("text"))


# Plain-text register: one document per forty parts.
RENDERED["plain_lines"] = _lines(
    "concat('P', CAST(floor(p_partkey / 40) AS BIGINT))", "{part}", "p_partkey * 32",
    [
        (1, "CASE WHEN p_partkey % 40 = 0 THEN 'PURPOSE:' END"),
        (2, "CASE WHEN p_partkey % 40 = 0 THEN 'This part register is kept for the whole of the trading season.' END"),
        (3, "CASE WHEN p_partkey % 10 = 0 THEN concat(p_partkey % 23, '. Register of ', p_type) END"),
        (4, "CASE WHEN p_partkey % 11 = 0 THEN concat(p_size, '.', p_partkey % 9, ' Handling of ', p_name) END"),
        (5, "CASE WHEN p_partkey % 37 = 0 THEN 'Appendix B - Checklists' END"),
        (6, "CASE WHEN p_partkey % 38 = 0 THEN concat('B.', p_partkey % 7, ' Boundary checklist') END"),
        (7, "CASE WHEN p_type = 'MEDIUM' THEN concat('Knowledge Card KC-', lpad(CAST(p_partkey % 100 AS STRING), 2, '0')) ELSE concat(CASE p_type WHEN 'ECONOMY' THEN 'FAU' WHEN 'SMALL' THEN 'FLR' WHEN 'STANDARD' THEN 'MED' WHEN 'PROMO' THEN 'ACC' ELSE 'INC' END, '-', lpad(CAST(p_partkey % 1000 AS STRING), 3, '0'), ' — ', p_name) END"),
        (8, "concat('The ', p_name, ' carries the mark ', p_brand, ' and a drink-')"),
        (9, "concat('ing water note. Size ', p_size, '!')"),
        (10, "CASE WHEN p_partkey % 4 <> 1 THEN 'Secondary pressures include trade, noise and the loss of shaded shallow water. Keep distance.' END"),
        (11, "CASE WHEN p_type = 'PROMO' THEN 'Guests are asked to keep the storm shutters closed until the warden gives the all clear.' END"),
        (12, "CASE WHEN p_partkey % 13 = 0 THEN concat('Observers differ on the matter and wrote down what each of them saw. Field Note FN-A saw a bloom by the pier of ', p_name, '. Laboratory Note LAB-C found carbonates in the sample of lot ', p_partkey, '.') END"),
    ],
)
# Flat chunk table: orders, parts, suppliers, nations, regions and one narrative per customer.
RENDERED["chunks"] = f"""
    SELECT concat('rec-', lower({_PREFIX}), '-', o_orderkey) AS chunk_id, concat('C', o_custkey) AS doc_id,
           concat('Orders of customer ', o_custkey) AS doc_name, o_orderkey AS ordinal,
           concat('[', {_PREFIX}, '-', o_orderkey, '] Order in state ', o_orderstatus, {NL}, {NL},
                  '### ', {_PREFIX}, '-', o_orderkey, {NL},
                  'Initial risk level: ', coalesce({_RISK}, 'NONE'), {NL},
                  'Plausible causes include late dispatch on the route through the ', {_REGION}, '.  ', {NL},
                  {_STATUS}, ' Value ', CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING), '.') AS content,
           concat({_PREFIX}, '-', o_orderkey) AS record_id,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'incident' WHEN '2-HIGH' THEN 'health' WHEN '3-MEDIUM' THEN 'fauna'
                WHEN '4-NOT SPECIFIED' THEN 'knowledge_card' ELSE 'policy' END AS record_type,
           concat('Order in state ', o_orderstatus) AS title,
           concat(o_custkey % 17 + 1, ' · Orders') AS chapter,
           concat('Orders ', o_orderstatus) AS section,
           CAST(o_orderkey % 56 + 1 AS BIGINT) AS page,
           CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE concat('REG-', lpad(CAST(o_custkey % 10 + 1 AS STRING), 2, '0')) END AS region_id,
           CASE o_orderstatus WHEN 'O' THEN 'disputed report' WHEN 'F' THEN 'community tradition' ELSE 'modeled estimate' END AS evidence_quality,
           lower({_RISK}) AS risk_level,
           CASE WHEN o_orderkey % 3 = 0 THEN {_DAY} END AS record_date,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'guardian-limited' WHEN '2-HIGH' THEN 'healer-limited'
                WHEN '3-MEDIUM' THEN 'community-limited' ELSE 'public' END AS access_class
    FROM {{orders}}
    UNION ALL
    SELECT concat('rec-flr-', p_partkey), concat('P', CAST(floor(p_partkey / 40) AS BIGINT)), 'Parts', p_partkey,
           concat('[FLR-', p_partkey, '] ', p_name, {NL}, {NL}, p_name, ' of ', p_brand, ' is a ', lower(p_type), ' plant.'),
           concat('FLR-', p_partkey), 'flora', p_name, '7 · Flora', p_brand, CAST(p_size AS BIGINT), NULL,
           'verified observation', NULL, NULL, CASE WHEN p_type = 'PROMO' THEN 'healer-limited' ELSE 'public' END
    FROM {{part}}
    UNION ALL
    SELECT concat('rec-stl-', s_suppkey), concat('S', s_nationkey), 'Settlements', s_suppkey,
           concat('[STL-', s_suppkey, '] ', s_name, {NL}, {NL}, s_name, ' is a village of nation ', s_nationkey, '.'),
           concat('STL-', s_suppkey), 'settlement', s_name, '5 · Settlements', concat('Nation ', s_nationkey), CAST(5 AS BIGINT),
           concat('REG-', lpad(CAST(s_nationkey % 10 + 1 AS STRING), 2, '0')), 'verified observation', NULL, NULL, 'public'
    FROM {{supplier}}
    UNION ALL
    SELECT concat('rec-reg-', r_regionkey), 'R', 'Regions', CAST(r_regionkey AS BIGINT),
           concat('[REG-', lpad(CAST(r_regionkey + 1 AS STRING), 2, '0'), '] ', r_name, {NL}, {NL}, 'The region of ', r_name, '.'),
           concat('REG-', lpad(CAST(r_regionkey + 1 AS STRING), 2, '0')), 'region', r_name, '3 · Regions', r_name, CAST(3 AS BIGINT),
           concat('REG-', lpad(CAST(r_regionkey + 1 AS STRING), 2, '0')), 'verified observation', NULL, NULL, 'public'
    FROM {{region}}
    UNION ALL
    SELECT concat('nar-', c_custkey), concat('C', c_custkey), concat('Orders of customer ', c_custkey), CAST(-1 AS BIGINT),
           concat('## ', c_nationkey + 1, '. Register', {NL}, repeat('This register lists the orders of one customer. ', 3), c_mktsegment),
           NULL, 'narrative', 'Register', concat(c_nationkey + 1, ' · Register'), 'Register', CAST(1 AS BIGINT), NULL,
           'verified observation', NULL, NULL, 'public'
    FROM {{customer}}
"""
# Evidence: the six highest-valued order chunks of each customer.
RENDERED["evidence"] = f"""
    SELECT report_id, rnk, chunk_id, doc_id, record_id, record_type, title, chapter, section, page, region_id,
           evidence_quality, risk_level, record_date, content, score, rerank_score,
           coalesce(record_id, concat('SEC-', sum(CASE WHEN record_id IS NULL THEN 1 ELSE 0 END)
                    OVER (PARTITION BY report_id ORDER BY rnk ROWS UNBOUNDED PRECEDING))) AS citation_id
    FROM (
      SELECT CAST(o_custkey AS BIGINT) AS report_id,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rnk,
             concat('rec-', o_orderkey) AS chunk_id, concat('C', o_custkey) AS doc_id,
             CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE concat({_PREFIX}, '-', o_orderkey) END AS record_id,
             CASE o_orderpriority WHEN '1-URGENT' THEN 'incident' WHEN '2-HIGH' THEN 'health' WHEN '3-MEDIUM' THEN 'fauna'
                  WHEN '4-NOT SPECIFIED' THEN 'knowledge_card' ELSE 'narrative' END AS record_type,
             CASE WHEN o_orderkey % 15 = 0 THEN '' ELSE concat('Order ', o_orderkey) END AS title, concat(o_custkey % 17 + 1, ' · Orders') AS chapter,
             CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('Orders ', o_orderstatus) END AS section,
             CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 56 + 1 AS BIGINT) END AS page,
             CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('REG-', lpad(CAST(o_orderkey % 10 + 1 AS STRING), 2, '0')) END AS region_id,
             CASE o_orderstatus WHEN 'O' THEN 'disputed report' WHEN 'F' THEN 'verified observation' ELSE 'modeled estimate' END AS evidence_quality,
             CASE WHEN o_orderpriority = '1-URGENT' THEN 'critical' END AS risk_level,
             CASE WHEN o_orderkey % 2 = 0 THEN {_DAY} END AS record_date,
             concat('[', {_PREFIX}, '-', o_orderkey, '] Order', {NL}, '# Heading', {NL},
                    CASE WHEN o_orderkey % 4 = 1 THEN 'Plausible causes are listed. ' ELSE '' END,
                    CASE WHEN o_orderkey % 5 = 1 THEN 'The chain-of-custody form is missing. '
                         WHEN o_orderkey % 5 = 2 THEN 'Counts are not directly comparable. '
                         WHEN o_orderkey % 5 = 3 THEN 'The report is unconfirmed. ' ELSE '' END,
                    repeat('Some  longer text about the order. ', CAST(1 + o_orderkey % 9 AS INT))) AS content,
             o_totalprice / 10000000.0 AS score,
             CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice / 400000.0 END AS rerank_score
      FROM {{orders}}
    ) e WHERE rnk <= 6
"""


def _answers() -> str:
    arms = []
    for pos, section in enumerate(P.SECTION_TYPES, 1):
        n = f"(report_id * 3 + {pos})"
        arms.append(f"""
    SELECT report_id, CAST({pos} AS BIGINT) AS pos, '{section}' AS section_type,
      concat_ws({NL}, '## Findings',
        concat('- The carrier reported a long delay in the eastern basin [', c1, ']. A second look ', CASE WHEN {n} % 3 = 0 THEN 'did' ELSE 'might' END, ' confirm the cause [', c2, '].'),
        CASE WHEN {n} % 9 = 0 THEN concat('**', c1, ' Tide Grazer** — pressed by trade along the whole coast [', c1, '].') END,
        CASE WHEN {n} % 4 = 0 THEN concat('Both shipments were compared side by side by the inspectors [', c1, '] [', c2, '].') END,
        CASE WHEN {n} % 5 = 0 THEN 'The harbour was closed without any notice to the crews.' END,
        CASE WHEN {n} % 7 = 0 THEN 'An invented source claims that the vessel has sunk [ZZ-999].' END,
        CASE WHEN {n} % 6 = 0 THEN 'At [time] in the harbour, we observed a change of water.' END,
        CASE WHEN {n} % 6 = 0 THEN 'Avoid entering the restricted areas of the harbour.' END,
        CASE WHEN {n} % 12 = 0 THEN 'Stay on the marked roads until the end of the watch."' END,
        CASE WHEN {n} % 6 = 0 AND {n} % 4 = 2 THEN '' END,
        CASE WHEN {n} % 3 = 0 THEN concat('It was recorded on ', coalesce(d1, '2026-06-14'), ' at the station near the delta [', c1, '].') END,
        CASE WHEN {n} % 4 = 1 THEN concat('Seek a healer when a red flag appears; this is training material [', c2, '].') END,
        CASE WHEN {n} % 5 = 1 THEN concat('The records conflict and the chain of custody is incomplete for ', c1, ', ', c2, ', ', c3, ' [', c3, '].') END,
        CASE WHEN {n} % 8 = 3 THEN '{P.INSUFFICIENT_MESSAGE}' END,
        CASE WHEN {n} % 10 = 2 THEN '"Keep calm and stay indoors, the wardens will come."' END,
        'Immediate actions:',
        concat('1. Close the gate and keep the log up to date [', c3, '].'),
        concat('2. Inform the wardens of the next basin in good time [', c2, '].'),
        CASE WHEN {n} % 2 = 0 THEN '**Model inference:** The delay could be caused by the storm season. More samples would help to settle it.' END
      ) AS answer,
      ({n} % 8 <> 3 AND {n} % 11 <> 0) AS sufficient
    FROM top3""")
    return (
        "SELECT report_id, pos, section_type, answer, sufficient FROM (WITH top3 AS ("
        "SELECT report_id, max(CASE WHEN rnk = 1 THEN citation_id END) AS c1, "
        "coalesce(max(CASE WHEN rnk = 2 THEN citation_id END), 'INC-0') AS c2, "
        "coalesce(max(CASE WHEN rnk = 3 THEN citation_id END), 'INC-0') AS c3, "
        "max(CASE WHEN rnk = 1 THEN record_date END) AS d1 FROM {evidence} GROUP BY report_id) "
        + " UNION ALL ".join(arms) + ") a"
    )


RENDERED["answers"] = _answers()

# Questions: one per order, twelve templates.
RENDERED["questions"] = f"""
    SELECT CAST(o_orderkey AS BIGINT) AS query_id, CAST(o_custkey AS BIGINT) AS conversation_id,
      {_case("CAST(o_orderkey % 12 AS INT)", [
        "What caused the turquoise water near INC-@?",
        "Compare the recommended responses for water contamination and an underwater volcanic event @",
        "which species are vulnerable to contamination in REG-0@?",
        "tell me about FAU-@ and FLR-@",
        "What are the immediate actions for MED-@?",
        "Which areas should receive emergency attention first?",
        "The water at station WS-@ has turned green and the fish are leaving the area",
        "Summarize the policy rules across the reports for settlement @",
        "difference between INC-00@ and INC-005, with a note on storm damage",
        "hmm @",
        "Reef cut infection vs. marine sting reaction versus coral bleaching @",
        "What does the reading of WS-0@ show, and what happened to the turbidity sensor?",
      ]).replace("@", "', o_custkey % 97, '").replace("THEN '", "THEN concat('").replace("' WHEN", "') WHEN").replace("' END", "') END")} AS question,
      CASE WHEN o_orderkey % 13 = 0 THEN 'focused' WHEN o_orderkey % 29 = 0 THEN 'sitrep' END AS forced_mode,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'W4' WHEN '2-HIGH' THEN 'w3' WHEN '3-MEDIUM' THEN 'Informational' WHEN '5-LOW' THEN 'odd' END AS severity_class,
      CASE WHEN o_orderkey % 5 = 0 THEN 'INC-77' WHEN o_orderkey % 5 = 1 THEN 'inc-1' END AS supplied_id,
      CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'guardian' WHEN 1 THEN 'healer' WHEN 2 THEN 'researcher' ELSE 'citizen' END AS role,
      CASE WHEN o_orderkey % 17 = 0 THEN 'compare' WHEN o_orderkey % 17 = 1 THEN 'summarize' ELSE 'simple' END AS query_shape,
      CASE WHEN o_orderkey % 7 = 0 THEN concat('Long water report of ', o_custkey, ' versus the FAU-0', o_custkey % 9, ' coral report') WHEN o_orderkey % 7 = 1 THEN ' ' END AS rewritten,
      CASE WHEN o_orderkey % 19 = 0 THEN 'What of the FAU-01 reefs?| |What should we do about MED-2?|more' WHEN o_orderkey % 19 = 1 THEN 'only one' END AS supplied,
      o_orderdate AS asked_at
    FROM {{orders}}
"""
# Documents carried as retrieval units with metadata columns.
RENDERED["doc_chunks"] = """
    SELECT doc_id AS chunk_id, text,
      CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN 'incident' WHEN 1 THEN 'fauna' WHEN 2 THEN 'field_note' WHEN 3 THEN 'policy'
           WHEN 4 THEN 'knowledge_card' WHEN 5 THEN 'health' WHEN 6 THEN 'chapter' ELSE 'narrative' END AS record_type,
      CASE WHEN doc_id % 8 >= 6 THEN NULL ELSE concat(CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN 'INC-' WHEN 1 THEN 'FAU-' WHEN 2 THEN 'FN-'
           WHEN 3 THEN 'POL-' WHEN 4 THEN 'KC-' ELSE 'MED-' END, doc_id) END AS record_id,
      CASE WHEN doc_id % 8 = 0 OR doc_id % 24 = 2 THEN 'guardian-limited' WHEN doc_id % 8 = 5 OR doc_id % 24 = 10 THEN 'healer-limited'
           WHEN doc_id % 8 = 1 THEN 'community-limited' ELSE 'public' END AS access_class,
      CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'none' END AS severity,
      doc_id % 11 = 0 AS navigational, concat(source, '/', CAST(floor(doc_id / 64) AS BIGINT)) AS section,
      concat('REG-', lpad(CAST(doc_id % 10 + 1 AS STRING), 2, '0')) AS region_id
    FROM {documents}
"""
RENDERED["doc_queries"] = """
    SELECT item_id AS query_id, text AS question,
      CASE CAST(item_id % 4 AS INT) WHEN 0 THEN 'guardian' WHEN 1 THEN 'healer' WHEN 2 THEN 'researcher' ELSE 'citizen' END AS role,
      item_id % 3 = 0 AS triage
    FROM {benchmark}
"""
# Report rows, one per customer.
RENDERED["reports"] = """
    SELECT CAST(o_custkey AS BIGINT) AS report_id, max(o_orderdate) AS created_at, concat('U', o_custkey % 40) AS user_id,
      concat('Question of ', o_custkey) AS question,
      CASE CAST(o_custkey % 7 AS INT) WHEN 0 THEN 'W4' WHEN 1 THEN ' w3 ' WHEN 2 THEN 'Informational' WHEN 3 THEN 'W1' WHEN 4 THEN 'w2' WHEN 5 THEN 'x9' END AS priority_class,
      CASE WHEN o_custkey % 6 = 0 THEN NULL WHEN o_custkey % 6 = 1 THEN '' ELSE concat('Reason ', o_custkey) END AS priority_reason,
      CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN '4.5 Scale' WHEN 1 THEN '  ' END AS priority_citation,
      CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 4 = 1 THEN '' ELSE 'EMERGENCY' END AS priority_label,
      CASE CAST(o_custkey % 6 AS INT) WHEN 0 THEN 'medium' WHEN 1 THEN 'High' WHEN 2 THEN 'low' WHEN 3 THEN 'unsure' WHEN 4 THEN 'insufficient' END AS confidence,
      o_custkey % 5 = 0 AS had_conflict, o_custkey % 4 <> 0 AS has_sufficient_evidence, o_custkey % 9 = 0 AS was_partial,
      count(*) AS citation_count
    FROM {orders} GROUP BY o_custkey
"""
RENDERED["raw_sections"] = """
    SELECT report_id, pos, CASE WHEN report_id % 10 = 9 THEN 'priority' ELSE concat(' ', upper(section_type)) END AS section_type,
      CASE CAST((report_id + pos) % 6 AS INT) WHEN 0 THEN 'filled' WHEN 1 THEN 'empty' WHEN 2 THEN 'Timed_Out' WHEN 3 THEN 'broken' WHEN 4 THEN 'filled' END AS status,
      CASE WHEN (report_id + pos) % 4 = 0 THEN '' WHEN (report_id + pos) % 4 = 1 THEN 'No species records matched this query' END AS empty_reason,
      CASE WHEN (report_id + pos) % 3 = 0 THEN '' ELSE answer END AS content,
      CASE CAST((report_id + pos) % 4 AS INT) WHEN 0 THEN 'marine_life_protector' WHEN 1 THEN 'INCIDENT_INVESTIGATOR' WHEN 2 THEN 'stranger' END AS owning_agent,
      CAST(4 - pos AS BIGINT) AS display_order
    FROM {answers}
"""
# Reports of which one section was never filed; section completion fills it.
RENDERED["filed_sections"] = "SELECT * FROM {raw_sections} WHERE NOT (report_id % 3 = 1 AND pos = 2)"
RENDERED["documents_meta"] = """
    SELECT concat('D', c_custkey) AS id, concat('U', c_custkey % 40) AS user_id, concat('file', c_custkey, CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.csv' WHEN 3 THEN '.md' WHEN 4 THEN '.exe' WHEN 5 THEN '.tar.txt' ELSE '' END) AS file_name,
      CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/csv' WHEN 2 THEN 'text/plain' ELSE 'application/octet-stream' END AS content_type,
      CAST(c_acctbal * 2000 AS BIGINT) AS size_bytes,
      CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'pending' WHEN 1 THEN 'indexing' WHEN 2 THEN 'indexed' ELSE 'failed' END AS status,
      c_custkey % 25 = 0 AS is_preloaded, c_custkey AS seq
    FROM {customer}
"""
# Every known step type, and one that no reader knows.
_STEP = _case(f"CAST(event_id % {len(P.STEP_TYPES) + 1} AS INT)", [*P.STEP_TYPES, "unheard.of"])
RENDERED["agent_steps"] = f"""
    SELECT CAST(user_id AS BIGINT) AS run_id, event_id AS sequence_number, ts AS created_at,
      {_STEP} AS step_type,
      CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'marine_life_protector' WHEN 1 THEN 'incident_investigator' ELSE 'emergency_responder' END AS agent,
      CAST(floor(value * 10) AS BIGINT) AS duration_ms,
      CASE WHEN event_id % 17 = 0 THEN '{{"k": ' ELSE props END AS payload
    FROM {{events}}
"""
RENDERED["turns"] = "SELECT conv_id, turn, role, text FROM {conversations}"

_REF = re.compile(r"\{(\w+)\}")


def _text(name: str, engine: str) -> str:
    body = RENDERED[name]
    return body if isinstance(body, str) else body[engine]


def _deps(text: str) -> list[str]:
    return [d for d in dict.fromkeys(_REF.findall(text)) if d in RENDERED or d in TABLES]


def _bind(text: str) -> str:
    return _REF.sub(lambda m: m.group(1) if m.group(1) in RENDERED or m.group(1) in TABLES else m.group(0), text)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or an input rendered from driver tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _text(name, "spark")
    deps = {d: load(spark, sf_dir, d) for d in _deps(text)}
    # Inline every reference as a view of the same session; views are lazy.
    for dep, frame in deps.items():
        frame.createOrReplaceTempView(f"evidentia_{dep}")
    bound = _REF.sub(lambda m: f"evidentia_{m.group(1)}" if m.group(1) in deps else m.group(0), text)
    return spark.sql(bound)


def check_sql(body: str, ctes: dict[str, str] | None = None) -> str:
    """Complete a DuckDB check: add the rendered inputs and shared CTEs it names."""
    pool = ctes or {}
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b\w+\b", text)):
            if name in wanted or name in done:
                continue
            if name in pool or name in RENDERED:
                done.add(name)
                need(pool[name] if name in pool else _text(name, "duck"))
                wanted.append(name)

    done: set[str] = set()
    need(body)
    parts = []
    for name in wanted:
        text = pool[name] if name in pool else _bind(_text(name, "duck"))
        parts.append(f"{name} AS MATERIALIZED ({text})")
    body = body.strip()
    if not parts:
        return body
    head = "WITH " + ",\n".join(parts)
    if body[:5].upper() == "WITH ":
        return head + ",\n" + body[5:]
    return head + "\n" + body
