"""Registered queries: document structure, chunking, labels and inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia import params as P
from evidentia.functions import labels as L
from evidentia.functions import text as X
from evidentia.functions.bounds import spread, unroll
from evidentia.operators import boilerplate as B
from evidentia.operators import structure as C
from evidentia.plans import sqltext as S
from evidentia.plans.registry import query, shared

REC, HEAD, CHAP, PAGE = (S.q(x) for x in (P.MD_RECORD_HEADING, P.MD_HEADING, P.MD_CHAPTER, P.PAGE_MARKER))
_CHAPTER = f"CASE WHEN regexp_matches(text, {CHAP}) THEN regexp_extract(text, {CHAP}, 1) || ' · ' || trim(regexp_extract(text, {CHAP}, 2)) END"
_PAGE = f"CASE WHEN regexp_matches(text, {PAGE}) THEN CAST(regexp_extract(text, {PAGE}, 1) AS BIGINT) END"
_ASOF = "OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _outline(level: int) -> str:
    return f"""
    WITH m AS (SELECT *, regexp_matches(text, {REC}) AS is_rec, length(regexp_extract(text, {HEAD}, 1)) AS lvl FROM record_lines),
    b AS (SELECT *, is_rec OR lvl BETWEEN 1 AND {level} AS bound FROM m)
    SELECT doc_id, line_no, text,
      last_value(CASE WHEN bound THEN line_no END IGNORE NULLS) {_ASOF} AS segment,
      last_value(CASE WHEN is_rec THEN regexp_extract(text, {REC}, 1) WHEN bound THEN '' END IGNORE NULLS) {_ASOF} AS record_id,
      last_value(CASE WHEN is_rec THEN trim(regexp_extract(text, {REC}, 2)) WHEN bound THEN '' END IGNORE NULLS) {_ASOF} AS title,
      last_value(CASE WHEN lvl > 0 THEN line_no END IGNORE NULLS) {_ASOF} AS piece,
      last_value({_CHAPTER} IGNORE NULLS) {_ASOF} AS chapter, last_value({_PAGE} IGNORE NULLS) {_ASOF} AS page FROM b"""


shared("outline3", _outline(3))
shared("outline2", _outline(2))
_TYPE = S.case_map("split_part(record_id, '-', 1)", P.PREFIX_TYPES)
_REGION = "CASE " + " ".join(f"WHEN contains(lower(body), {S.q(n)}) THEN {S.q(i)}" for n, i in P.REGIONS.items()) + " END"


def _quality(kind: str, x: str) -> str:
    low = f"lower({x})"
    return (
        f"CASE WHEN {S.any_contains(low, P.DISPUTED_PHRASES)} THEN 'disputed report' "
        f"WHEN {kind} = 'incident' OR contains({low}, 'these are hypotheses') THEN 'provisional interpretation' "
        f"WHEN {kind} = 'monitoring' THEN 'verified observation' "
        f"WHEN {S.any_contains(low, P.TRADITION_PHRASES)} THEN 'community tradition' "
        f"WHEN {S.any_contains(low, P.MODELED_PHRASES)} THEN 'modeled estimate' ELSE 'verified observation' END"
    )


_RISK = r"CASE WHEN regexp_matches(body, 'Initial risk level:\s*([A-Z]+)') THEN lower(regexp_extract(body, 'Initial risk level:\s*([A-Z]+)', 1)) END"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _records(outline: str) -> str:
    return f"""
    WITH s AS (SELECT doc_id, segment, any_value(record_id) AS record_id, any_value(title) AS title, any_value(chapter) AS chapter,
                 arg_min(page, line_no) FILTER (page IS NOT NULL) AS page_any, min(line_no) AS l0,
                 {_STRIP.format("string_agg(text, chr(10) ORDER BY line_no)")} AS body
               FROM {outline} WHERE record_id <> '' GROUP BY doc_id, segment),
    p AS (SELECT s.*, o.page, {_TYPE} AS record_type FROM s JOIN (SELECT doc_id, line_no, page FROM {outline}) o ON o.doc_id = s.doc_id AND o.line_no = s.l0)
    SELECT 'rec-' || lower(record_id) AS chunk_id, doc_id, segment AS ordinal, record_id, record_type, title, chapter, title AS section, page,
      {_REGION} AS region_id, {_quality('record_type', 'body')} AS evidence_quality, {_RISK} AS risk_level,
      trim('[' || record_id || '] ' || title) || CASE WHEN chapter IS NULL THEN '' ELSE ' · Chapter ' || chapter END || chr(10) || chr(10) || body AS content
    FROM p"""


shared("o_records", _records("outline3"))


# ---- lines ------------------------------------------------------------------
def doc_lines(t):
    return C.explode_lines(spread(t("documents")), ["doc_id"])


shared("doc_lines", r"SELECT doc_id, i - 1 AS line_no, trim(ls[i]) AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS ls FROM documents))")


@query("c1_flatten_lines", "SELECT doc_id, line_no, text FROM doc_lines")
def c1(t):
    return doc_lines(t)


_HEADERS = [r"^\[\[PAGE \d+\]\]$", r"(?i)^page\s+\d+$", r"(?i)^\| ws-\d+ .*clear \|$"]


@query("c2_running_headers", "SELECT doc_id, line_no, text FROM record_lines WHERE trim(text) = '' OR NOT (" + " OR ".join(f"regexp_matches(trim(text), {S.q(p)})" for p in _HEADERS) + ")")
def c2(t):
    return C.strip_running_headers(t("record_lines"), _HEADERS)


def _g(p: str, i: int) -> str:
    return f"regexp_extract(t, {S.q(p)}, {i})"


def _m(p: str) -> str:
    return f"regexp_matches(t, {S.q(p)})"


_NUM = f"TRY_CAST({_g(P.PLAIN_CHAPTER, 1)} AS INT)"
_CHAP_OK = f"({_m(P.PLAIN_CHAPTER)} AND {_NUM} BETWEEN 1 AND 20)"
_APP = f"'Appendix ' || upper({_g(P.PLAIN_APPENDIX, 1)})"
shared("plain_heads", f"""
    SELECT doc_id, line_no, t,
      CASE WHEN {_m(P.PLAIN_RECORD)} THEN 'record' WHEN {_m(P.PLAIN_CARD)} THEN 'card' WHEN {_m(P.PLAIN_SECTION)} THEN 'section'
           WHEN {_CHAP_OK} THEN 'chapter' WHEN {_m(P.PLAIN_APPENDIX_SECTION)} THEN 'appendix_section' WHEN {_m(P.PLAIN_APPENDIX)} THEN 'appendix'
           WHEN {_m(P.PLAIN_NAMED)} THEN 'named' END AS k
    FROM (SELECT doc_id, line_no, trim(text) AS t FROM plain_lines)""")
shared("plain_parsed", f"""
    SELECT doc_id, line_no, t, CASE WHEN k = 'appendix_section' THEN 'appendix' ELSE k END AS kind,
      CASE k WHEN 'record' THEN {_g(P.PLAIN_RECORD, 1)} WHEN 'card' THEN upper({_g(P.PLAIN_CARD, 1)}) END AS record_id,
      CASE k WHEN 'record' THEN trim({_g(P.PLAIN_RECORD, 2)}) WHEN 'card' THEN 'Knowledge Card ' || upper({_g(P.PLAIN_CARD, 1)})
        WHEN 'section' THEN trim({_g(P.PLAIN_SECTION, 2)}) WHEN 'chapter' THEN trim({_g(P.PLAIN_CHAPTER, 2)})
        WHEN 'appendix_section' THEN trim({_g(P.PLAIN_APPENDIX_SECTION, 2)})
        WHEN 'appendix' THEN {_APP} || CASE WHEN trim({_g(P.PLAIN_APPENDIX, 2)}) <> '' THEN ' — ' || trim({_g(P.PLAIN_APPENDIX, 2)}) ELSE '' END
        WHEN 'named' THEN trim(regexp_replace(t, ':$', '')) END AS title,
      CASE k WHEN 'section' THEN {_g(P.PLAIN_SECTION, 1)} WHEN 'chapter' THEN CAST({_NUM} AS VARCHAR)
        WHEN 'appendix_section' THEN {_g(P.PLAIN_APPENDIX_SECTION, 1)} WHEN 'appendix' THEN {_APP} END AS section
    FROM plain_heads""")


@query("c3_headings", "SELECT doc_id, line_no, kind, record_id, title, section FROM plain_parsed WHERE kind IS NOT NULL")
def c3(t):
    rows = t("plain_lines").select("doc_id", "line_no", C.plain_heading(F.trim("text")).alias("h")).where("h IS NOT NULL")
    return rows.select("doc_id", "line_no", "h.*")


@query("c4_chapter_page_lookup", f"SELECT doc_id, line_no, last_value({_CHAPTER} IGNORE NULLS) {_ASOF} AS chapter, last_value({_PAGE} IGNORE NULLS) {_ASOF} AS page FROM record_lines")
def c4(t):
    return C.locate(t("record_lines")).select("doc_id", "line_no", "chapter", "page")


@query("j8_asof_join", f"""
    SELECT l.doc_id, l.line_no, c.chapter FROM (SELECT doc_id, line_no FROM record_lines WHERE regexp_matches(text, {REC})) l
    ASOF LEFT JOIN (SELECT doc_id, line_no, {_CHAPTER} AS chapter FROM record_lines WHERE regexp_matches(text, {CHAP})) c
      ON l.doc_id = c.doc_id AND l.line_no >= c.line_no""")
def j8(t):
    return C.locate(t("record_lines")).where(F.col("text").rlike(P.MD_RECORD_HEADING)).select("doc_id", "line_no", "chapter")


@query("c5_record_chunks", "SELECT * FROM o_records")
def c5(t):
    return C.record_chunks(t("record_lines")).drop("record_date")


@query("c5_record_chunks_level2", _records("outline2"))
def c5_level2(t):
    return C.record_chunks(t("record_lines"), end_level=2).drop("record_date")


shared("o_segments", f"""
    WITH h AS (SELECT *, kind IS NOT NULL AS is_head, CASE WHEN kind IS NOT NULL THEN {{'kind': kind, 'record_id': record_id, 'title': title, 'section': section, 'start': line_no}} END AS hd FROM plain_parsed),
    c AS (SELECT *, last_value(hd IGNORE NULLS) {_ASOF} AS cur, last_value(CASE WHEN kind = 'chapter' THEN section END IGNORE NULLS) {_ASOF} AS chapter,
            last_value(CASE WHEN kind = 'chapter' THEN title END IGNORE NULLS) {_ASOF} AS chapter_title FROM h),
    g AS (SELECT doc_id, coalesce(cur.start, -1) AS start, any_value(cur) AS cur, any_value(chapter) AS chapter, any_value(chapter_title) AS chapter_title, trim(string_agg(t, ' ' ORDER BY line_no)) AS body
          FROM c WHERE NOT is_head GROUP BY ALL)
    SELECT doc_id, start, cur.record_id AS record_id,
      CASE WHEN cur.kind = 'record' THEN {S.case_map("split_part(cur.record_id, '-', 1)", P.PREFIX_TYPES)} WHEN cur.kind = 'card' THEN 'knowledge_card'
           WHEN cur.kind IS NULL OR cur.kind = 'chapter' THEN 'chapter' WHEN cur.kind = 'named' THEN 'section' ELSE cur.kind END AS record_type,
      coalesce(cur.title, doc_id || ' — front matter') AS title, cur.section AS section, chapter, chapter_title, body
    FROM g WHERE length(body) > 40""")


@query("c6_linear_segments", "SELECT * FROM o_segments")
def c6(t):
    return C.segment_plain(t("plain_lines"))


_CELLS = r"list_transform(string_split(regexp_replace(trim(text), '^\|+|\|+$', '', 'g'), '|'), lambda c: trim(c))"
shared("o_rows", rf"""
    WITH r AS (SELECT doc_id, line_no, regexp_extract(text, '\b(WS-\d+|SV-\d+)\b', 1) AS record_id, {_CELLS} AS cells FROM record_lines
               WHERE trim(text) LIKE '|%' AND regexp_matches(text, '\b(WS-\d+|SV-\d+)\b')),
    d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, record_id, cells[1:4] ORDER BY line_no) AS n FROM r WHERE len(cells) >= 3),
    b AS (SELECT *, list_filter(cells, lambda c: regexp_full_match(c, '\d{{4}}-\d{{2}}-\d{{2}}'))[1] AS record_date,
            array_to_string(list_filter(cells, lambda c: c <> ''), ' · ') AS body,
            CASE WHEN record_id LIKE 'WS%' THEN 'Water monitoring reading' ELSE 'Wildlife survey record' END AS label FROM d WHERE n = 1)
    SELECT 'row-' || lower(record_id) || '-' || coalesce(record_date, CAST(line_no AS VARCHAR)) AS chunk_id, doc_id, line_no AS ordinal, record_id, 'monitoring' AS record_type,
      record_id || ' ' || label AS title, label AS section, {_REGION} AS region_id,
      CASE WHEN list_contains(list_transform(cells, lambda c: lower(c)), 'low') THEN 'disputed report' ELSE 'verified observation' END AS evidence_quality, record_date,
      '[' || record_id || '] ' || label || chr(10) || chr(10) || body AS content FROM b""")


@query("c7_table_rows", "SELECT * FROM o_rows")
def c7(t):
    return C.table_row_chunks(t("record_lines"))


shared("o_notes", rf"""
    WITH p AS (SELECT *, string_split(regexp_replace(body, '{P.FIELD_NOTE}', chr(1) || '\1 \2', 'g'), chr(1)) AS ps FROM o_segments),
    z AS (SELECT * EXCLUDE (ps), len(ps) > 2 AS many, unnest(CASE WHEN len(ps) > 2 THEN list_zip(range(0, len(ps)), ps) ELSE [(0, body)] END) AS q FROM p),
    r AS (SELECT * EXCLUDE (q, body), q[1] AS part_no, trim(q[2]) AS part FROM z)
    SELECT doc_id, start, part_no, CASE WHEN many AND part_no > 0 THEN regexp_extract(part, '{P.FIELD_NOTE}', 2) ELSE record_id END AS record_id,
      CASE WHEN many AND part_no > 0 THEN 'field_note' ELSE record_type END AS record_type,
      CASE WHEN many AND part_no > 0 THEN regexp_extract(part, '{P.FIELD_NOTE}', 1) || ' ' || regexp_extract(part, '{P.FIELD_NOTE}', 2) ELSE title END AS title,
      section, chapter, chapter_title, part AS body
    FROM r WHERE CASE WHEN NOT many THEN true WHEN part_no = 0 THEN length(part) > 60 ELSE length(part) >= 40 END""")


@query("c9_split_notes", "SELECT * FROM o_notes")
def c9(t):
    return C.split_notes(C.segment_plain(t("plain_lines")))


shared("o_pieces", rf"""
    WITH p AS (SELECT doc_id, coalesce(greatest(piece, segment), -1099511627776) AS piece, any_value(chapter) AS chapter, min(line_no) AS l0,
                 {_STRIP.format("string_agg(text, chr(10) ORDER BY line_no)")} AS content
               FROM outline3 WHERE coalesce(record_id, '') = '' GROUP BY ALL)
    SELECT p.doc_id, p.piece, p.chapter, o.page, trim(regexp_replace(string_split(content, chr(10))[1], '^[# ]+', '')) AS title, content
    FROM p JOIN outline3 o ON o.doc_id = p.doc_id AND o.line_no = p.l0 WHERE length(content) >= 200""")


@query("c10_narrative_pieces", "SELECT * FROM o_pieces")
def c10(t):
    return C.narrative_pieces(t("record_lines"))


@query("c8_field_notes", rf"""
    WITH p AS (SELECT doc_id, piece, unnest(list_zip(ps[2:], range(0, len(ps) - 1))) AS z FROM (
        SELECT doc_id, piece, string_split(regexp_replace(content, '({P.FIELD_NOTE_LABEL})', chr(1) || '\1', 'g'), chr(1)) AS ps FROM o_pieces)),
    n AS (SELECT doc_id, piece, z[2] AS note_no, regexp_extract(z[1], '^({P.FIELD_NOTE_LABEL})', 1) AS title,
            trim(regexp_replace(regexp_replace(string_split(z[1], chr(10) || '#')[1], '^({P.FIELD_NOTE_LABEL})[,.]?\s*', ''), '\s+', ' ', 'g')) AS body FROM p)
    SELECT doc_id, piece, note_no, regexp_extract(title, '(FN-[AB]|LAB-C)', 1) AS record_id, 'field_note' AS record_type, title, 'disputed report' AS evidence_quality,
      {_REGION} AS region_id, nullif(regexp_extract(body, '(\d{{4}}-\d{{2}}-\d{{2}})', 1), '') AS record_date,
      '[' || regexp_extract(title, '(FN-[AB]|LAB-C)', 1) || '] ' || title || chr(10) || chr(10) || body AS content FROM n WHERE length(body) >= 40""")
def c8(t):
    return C.field_note_chunks(C.narrative_pieces(t("record_lines")), ["doc_id", "piece"], "content")


@query("u4_span_complement", "SELECT doc_id, CAST(count(*) AS BIGINT) AS narrative_lines, CAST(sum(length(text)) AS BIGINT) AS narrative_chars FROM outline3 WHERE coalesce(record_id, '') = '' GROUP BY doc_id")
def u4(t):
    rows = C.outline(t("record_lines")).where(F.coalesce("record_id", F.lit("")) == "")
    return rows.groupBy("doc_id").agg(F.count("*").alias("narrative_lines"), F.sum(F.length("text")).alias("narrative_chars"))


@query("c11_pack_windows")
def c11(t):
    rows = unroll(spread(t("documents")), ["doc_id"], X.pack_paragraphs(F.col("text"), paragraph="\n"), "window", "window_no")
    return rows.select("doc_id", "window_no", F.length("window").alias("chars"), F.md5("window").alias("digest"))


@query("c12_pack_sentences")
def c12(t):
    sentences = X.reflow(X.lines_of(F.col("text")))
    rows = unroll(spread(t("documents")), ["doc_id"], X.pack_sentences(sentences), "body", "body_no")
    return rows.select("doc_id", "body_no", F.length("body").alias("chars"), F.md5("body").alias("digest"))


def _reflow(x: str) -> str:
    joined = rf"trim(regexp_replace(regexp_replace(array_to_string({x}, ' '), '(\w)-\s+(\w)', '\1\2', 'g'), '\s{{2,}}', ' ', 'g'))"
    parts = rf"regexp_extract_all({joined}, '([^.!?]+[.!?]+(?:\s|$)|[^.!?]+$)', 1)"
    return f"list_filter(list_transform(CASE WHEN len({parts}) = 0 THEN [{joined}] ELSE {parts} END, lambda s: trim(s)), lambda s: s <> '')"


def _key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


shared("doc_sentences", rf"SELECT doc_id, {_reflow(r'''string_split_regex(text, '\r?\n')''')} AS ss FROM documents")


@query("c13_reflow_sentences", "SELECT doc_id, len(ss) AS n_sentences, array_to_string(ss, '|') AS sentences FROM doc_sentences")
def c13(t):
    return spread(t("documents")).select("doc_id", X.reflow(X.lines_of(F.col("text"))).alias("s")).select(
        "doc_id", F.size("s").alias("n_sentences"), F.array_join("s", "|").alias("sentences"))


@query("c14_sentence_keys", f"SELECT doc_id, key, count(*) AS n FROM (SELECT doc_id, {_key('s')} AS key FROM (SELECT doc_id, unnest(ss) AS s FROM doc_sentences)) GROUP BY ALL")
def c14(t):
    return B.sentence_rows(doc_segments(t)).groupBy(F.col("segment_id").alias("doc_id"), "key").agg(F.count("*").alias("n"))


def doc_segments(t):
    return spread(t("documents")).select(
        F.col("doc_id").alias("segment_id"), F.col("lang").alias("record_type"), F.concat(F.lit("DOC-"), "doc_id").alias("record_id"),
        X.reflow(X.lines_of(F.col("text"))).alias("sentences"))


shared("o_sent", f"SELECT doc_id AS segment_id, lang AS record_type, 'DOC-' || doc_id AS record_id, i - 1 AS pos, ss[i] AS sentence, {_key('ss[i]')} AS key FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM doc_sentences JOIN documents USING (doc_id))")
shared("o_keys", "SELECT key, count(DISTINCT segment_id) AS n_segments FROM o_sent WHERE length(key) >= 45 GROUP BY key HAVING count(DISTINCT segment_id) >= 3")
shared("o_marked", "SELECT s.*, n_segments, pos > 0 AND n_segments IS NOT NULL AS removed FROM o_sent s LEFT JOIN o_keys USING (key)")


@query("g4_sentence_frequency", "SELECT * FROM o_keys")
def g4(t):
    return B.shared_keys(doc_segments(t))


@query("c15_boilerplate", """
    SELECT record_type, key, arg_min(sentence, segment_id * 1000000 + pos) AS sentence, max(n_segments) AS n_segments,
      min(segment_id) AS first_segment, CAST(min(segment_id * 1000000 + pos) % 1000000 AS BIGINT) AS first_pos
    FROM o_marked WHERE removed GROUP BY record_type, key""")
def c15(t):
    return B.shared_sentences(B.mark_shared(doc_segments(t)))


@query("c15_clean_segments", "SELECT segment_id, string_agg(sentence, '|' ORDER BY pos) FILTER (NOT removed) AS sentences, CAST(count(*) FILTER (removed) AS BIGINT) AS removed FROM o_marked GROUP BY segment_id")
def c15_clean(t):
    return B.clean_segments(B.mark_shared(doc_segments(t))).withColumn("sentences", F.array_join("sentences", "|"))


shared("o_pairs", "SELECT DISTINCT record_type, record_id FROM o_marked WHERE removed")


@query("c15_applies_to", "SELECT * FROM o_pairs")
def c15_applies(t):
    return B.applies_to(B.mark_shared(doc_segments(t)))


_HEADER = """'Shared protocol — ' || replace(record_type, '_', ' ') || ' records' || chr(10) || 'This text is shared verbatim across ' || n || ' records (' || array_to_string(ids[1:6], ', ') || CASE WHEN n > 6 THEN ', …' ELSE '' END || '). It is stored once to keep individual records distinctive.'"""
shared("o_headers", f"SELECT record_type, n AS n_records, {_HEADER} AS header FROM (SELECT record_type, count(*) AS n, list(record_id ORDER BY record_id) AS ids FROM o_pairs GROUP BY record_type)")


@query("c16_shared_headers", "SELECT * FROM o_headers")
def c16(t):
    return B.shared_headers(B.applies_to(B.mark_shared(doc_segments(t))))


@query("c16_shared_chunks", """
    WITH f AS (SELECT record_type, key, arg_min(sentence, segment_id * 1000000 + pos) AS sentence, min(segment_id) AS fs, min(segment_id * 1000000 + pos) AS fp FROM o_marked WHERE removed GROUP BY ALL)
    SELECT 'shared-' || record_type || '-' || fs AS chunk_id, record_type, count(*) AS n_sentences, any_value(header) || chr(10) || string_agg(sentence, ' ' ORDER BY fp) AS content
    FROM f JOIN o_headers USING (record_type) GROUP BY record_type, fs""")
def c16_chunks(t):
    return B.shared_chunks(B.mark_shared(doc_segments(t)))


# Every plain segment holds well under one body of text, so the check has one part per segment.
@query("c17_final_chunks", rf"""
    SELECT doc_id, start, n.part_no AS note_no, 0 AS part_no, record_id, record_type, content, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM (
      SELECT *, CASE WHEN record_id IS NOT NULL THEN record_id || ' — ' || title WHEN section IS NOT NULL THEN section || ' ' || title ELSE title END || chr(10) || array_to_string({_reflow('[body]')}, ' ') AS content FROM o_notes) n""")
def c17(t):
    notes = C.split_notes(C.segment_plain(t("plain_lines"))).withColumn("sentences", X.reflow(F.array("body"))).withColumnRenamed("part_no", "note_no")
    return C.segment_chunks(notes, ["doc_id", "start", "note_no"])


@query("c18_drop_bare_headings", rf"""
    SELECT doc_id, piece, title FROM o_pieces WHERE length(trim(array_to_string(list_filter(string_split(content, chr(10)), lambda l: ltrim(l) NOT LIKE '#%'), chr(10)))) >= 260""")
def c18(t):
    pieces = C.narrative_pieces(t("record_lines"))
    return pieces.where(F.length(X.body_without_headings(F.col("content"))) >= 260).select("doc_id", "piece", "title")


@query("c19_unique_keys", """
    SELECT chunk_id || CASE WHEN n > 1 THEN '-' || (n - 1) ELSE '' END AS chunk_id, ordinal FROM (
      SELECT 'part-' || replace(p_name, ' ', '-') AS chunk_id, p_partkey AS ordinal, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""")
def c19(t):
    rows = t("part").select(F.concat(F.lit("part-"), F.translate("p_name", " ", "-")).alias("chunk_id"), F.col("p_partkey").alias("ordinal"))
    return C.unique_keys(rows)


@query("c20_slug", r"SELECT doc_id, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug FROM documents")
def c20(t):
    return t("documents").select("doc_id", X.slug(F.col("text")).alias("slug"))


_IDS = rf"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{P.RECORD_ID_ANY}')) AS id FROM record_lines"


@query("c21_chunking_mode", f"""
    SELECT d.doc_id, coalesce(n, 0) AS record_count, CASE WHEN coalesce(n, 0) >= 10 THEN 'record_aware' ELSE 'narrative' END AS mode
    FROM (SELECT DISTINCT doc_id FROM record_lines) d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_IDS}) GROUP BY doc_id) USING (doc_id)""")
def c21(t):
    return C.chunking_mode(t("record_lines"), threshold=10)


@query("c21_upload_chunks")
def c21_upload(t):
    names = t("customer").select(F.concat(F.lit("C"), "c_custkey").alias("doc_id"), F.col("c_name").alias("doc_name"))
    return C.upload_chunks(t("record_lines"), names)


@query("g3_distinct_ids", f"SELECT doc_id, count(*) AS n_ids FROM ({_IDS}) GROUP BY doc_id")
def g3(t):
    return C.chunking_mode(t("record_lines")).where("record_count > 0").select("doc_id", F.col("record_count").alias("n_ids"))


@query("g20_chunking_statistics", "SELECT count(DISTINCT segment_id) AS segments, count(*) AS sentences, CAST(count(*) FILTER (removed) AS BIGINT) AS hoisted, count(DISTINCT CASE WHEN removed THEN key END) AS shared FROM o_marked")
def g20(t):
    segments = doc_segments(t)
    return B.chunking_statistics(segments, B.mark_shared(segments))


# ---- labels -----------------------------------------------------------------
@query("f1_record_type", f"SELECT chunk_id, record_id, {_TYPE} AS record_type FROM chunks WHERE record_id IS NOT NULL")
def f1(t):
    return t("chunks").where("record_id IS NOT NULL").select("chunk_id", "record_id", L.record_type(F.col("record_id")).alias("record_type"))


_TWO = "content || ' then ' || CASE WHEN ordinal % 2 = 0 THEN 'Sunfall Archipelago and Emerald Canopy' ELSE title END"


@query("f2_region_list_order", "SELECT chunk_id, " + _REGION.replace("lower(body)", f"lower({_TWO})") + " AS region FROM chunks")
def f2(t):
    return t("chunks").select("chunk_id", L.region_listed(F.expr(_TWO)).alias("region"))


@query("f3_region_first_position", "SELECT chunk_id, list_sort(list_filter([" + ", ".join(
    f"{{'p': instr(lower({_TWO}), {S.q(n)}), 'i': {S.q(i)}}}" for n, i in P.REGIONS.items()) + "], lambda x: x.p > 0))[1].i AS region FROM chunks")
def f3(t):
    return t("chunks").select("chunk_id", L.region_earliest(F.expr(_TWO)).alias("region"))


@query("f4_risk_level", "SELECT chunk_id, " + _RISK.replace("body", "content") + " AS risk FROM chunks")
def f4(t):
    return t("chunks").select("chunk_id", L.risk_level(F.col("content")).alias("risk"))


@query("f5_severity", r"""
    SELECT chunk_id, CASE WHEN regexp_matches(x, '(?i)initial risk level:\s*(CRITICAL|HIGH|MEDIUM|LOW)') THEN lower(regexp_extract(x, '(?i)initial risk level:\s*(CRITICAL|HIGH|MEDIUM|LOW)', 1))
      WHEN record_type = 'incident' THEN 'medium' WHEN regexp_matches(lower(x), '\bw4\b|regional crisis') THEN 'critical'
      WHEN regexp_matches(lower(x), '\bw3\b|emergency') AND record_type <> 'accommodation' THEN 'high' ELSE 'none' END AS severity
    FROM (SELECT chunk_id, record_type, content || CASE WHEN ordinal % 3 = 0 THEN ' class W4' WHEN ordinal % 3 = 1 THEN ' emergency' ELSE '' END AS x FROM chunks)""")
def f5(t):
    x = F.expr("content || CASE WHEN ordinal % 3 = 0 THEN ' class W4' WHEN ordinal % 3 = 1 THEN ' emergency' ELSE '' END")
    return t("chunks").select("chunk_id", L.severity(F.col("record_type"), x).alias("severity"))


@query("f6_evidence_quality", f"SELECT chunk_id, {_quality('record_type', 'content')} AS quality FROM chunks")
def f6(t):
    return t("chunks").select("chunk_id", L.evidence_quality(F.col("record_type"), F.col("content")).alias("quality"))


_LC = "lower(content)"


@query("f7_evidence_quality_strict", f"""
    SELECT chunk_id, CASE WHEN record_type NOT IN ('chapter', 'section', 'appendix') AND {S.any_contains(_LC, P.STRICT_DISPUTED_PHRASES)} THEN 'disputed report'
      WHEN {S.any_contains(_LC, P.STRICT_PROVISIONAL_PHRASES)} THEN 'provisional interpretation' WHEN {S.any_contains(_LC, P.STRICT_TRADITION_PHRASES)} THEN 'community tradition'
      WHEN record_type = 'monitoring' THEN CASE WHEN regexp_matches({_LC}, '{P.STRICT_TABLE_COMMENTS}') THEN 'disputed report' ELSE 'verified observation' END
      WHEN record_type IN ('policy', 'knowledge_card') THEN 'documented protocol' WHEN {S.any_contains(_LC, ['modeled', 'estimate'])} THEN 'modeled estimate'
      WHEN record_type IN ('health', 'shared_protocol') THEN 'documented protocol' ELSE 'verified observation' END AS quality FROM chunks""")
def f7(t):
    return t("chunks").select("chunk_id", L.evidence_quality_strict(F.col("record_type"), F.col("content")).alias("quality"))


@query("f8_access_class", f"""
    SELECT chunk_id, CASE WHEN {S.any_contains("x", ['sacred', 'restricted knowledge', 'without consent'])} THEN 'community-limited' WHEN record_type = 'health' THEN 'healer-limited'
      WHEN record_type = 'flora' AND regexp_matches(x, 'healer|dose|infusion|toxic|medicinal') THEN 'healer-limited' WHEN record_type = 'incident' THEN 'guardian-limited' ELSE 'public' END AS access
    FROM (SELECT chunk_id, record_type, lower(content || CASE WHEN ordinal % 7 = 0 THEN ' Sacred site' WHEN ordinal % 7 = 1 THEN ' an infusion' ELSE '' END) AS x FROM chunks)""")
def f8(t):
    x = F.expr("content || CASE WHEN ordinal % 7 = 0 THEN ' Sacred site' WHEN ordinal % 7 = 1 THEN ' an infusion' ELSE '' END")
    return t("chunks").select("chunk_id", L.access_class(F.col("record_type"), x).alias("access"))


@query("f9_navigational_prior", f"""
    SELECT doc_id, start, nav, CAST(CASE WHEN nav THEN 0.3 WHEN record_type = 'knowledge_card' THEN 0.5 WHEN record_type = 'chapter' THEN 0.85 ELSE 1 END AS DOUBLE) AS prior FROM (
      SELECT *, regexp_matches(lower(title), '{P.NAVIGATIONAL_TITLES}') OR coalesce(regexp_matches(section, '{P.NAVIGATIONAL_SECTION}'), false) AS nav FROM o_segments)""")
def f9(t):
    rows = C.segment_plain(t("plain_lines")).withColumn("nav", L.navigational(F.col("title"), F.col("section")))
    return rows.select("doc_id", "start", "nav", L.retrieval_prior(F.col("record_type"), F.col("nav")).alias("prior"))


@query("f10_display_labels", f"SELECT chunk_id, {S.case_map('record_type', P.TYPE_LABELS)} AS type_label, {S.case_map('evidence_quality', P.QUALITY_LABELS)} AS quality_label, {S.case_map('access_class', P.ACCESS_LABELS)} AS access_label FROM chunks")
def f10(t):
    return t("chunks").select(
        "chunk_id", L.lookup(F.col("record_type"), P.TYPE_LABELS).alias("type_label"),
        L.lookup(F.col("evidence_quality"), P.QUALITY_LABELS).alias("quality_label"), L.lookup(F.col("access_class"), P.ACCESS_LABELS).alias("access_label"))
