"""Documents to lines, headings, records, rows, notes and narrative pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia import params as P
from evidentia.functions import labels as L
from evidentia.functions import text as X
from evidentia.functions.bounds import BROADCAST_ROWS, first_per, unroll
from evidentia.functions.durable import durable, stored
from evidentia.functions.scan import carry_forward, number_rows, place_blocks


def explode_lines(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Trimmed lines in order: ``keys, line_no, text``."""
    rows = unroll(docs, [*keys], X.lines_of(F.col(text)), "line", "line_no")
    return rows.select(*keys, "line_no", F.trim("line").alias("text"))


def strip_running_headers(lines: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    hits = [F.trim("text").rlike(p) for p in (patterns or P.RUNNING_HEADERS)]
    return lines.where((F.trim("text") == "") | ~X.any_of(hits))


def plain_heading(text: Column) -> Column:
    """Heading of a plain-text line as ``struct(kind, record_id, title, section)``; NULL for body text."""

    def row(kind, record_id=None, title=None, section=None) -> Column:
        null = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("kind"), (null if record_id is None else record_id).alias("record_id"),
            title.alias("title"), (null if section is None else section).alias("section"))

    def g(pattern: str, i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    card = F.upper(g(P.PLAIN_CARD, 1))
    number = g(P.PLAIN_CHAPTER, 1).try_cast("int")
    letter, rest = F.upper(g(P.PLAIN_APPENDIX, 1)), F.trim(g(P.PLAIN_APPENDIX, 2))
    appendix = F.concat(F.lit("Appendix "), letter)
    return (
        F.when(text.rlike(P.PLAIN_RECORD), row("record", g(P.PLAIN_RECORD, 1), F.trim(g(P.PLAIN_RECORD, 2))))
        .when(text.rlike(P.PLAIN_CARD), row("card", card, F.concat(F.lit("Knowledge Card "), card)))
        .when(text.rlike(P.PLAIN_SECTION), row("section", None, F.trim(g(P.PLAIN_SECTION, 2)), g(P.PLAIN_SECTION, 1)))
        .when(text.rlike(P.PLAIN_CHAPTER) & number.between(1, P.MAX_CHAPTER),
              row("chapter", None, F.trim(g(P.PLAIN_CHAPTER, 2)), number.cast("string")))
        .when(text.rlike(P.PLAIN_APPENDIX_SECTION),
              row("appendix", None, F.trim(g(P.PLAIN_APPENDIX_SECTION, 2)), g(P.PLAIN_APPENDIX_SECTION, 1)))
        .when(text.rlike(P.PLAIN_APPENDIX),
              row("appendix", None, F.when(rest != "", F.concat(appendix, F.lit(" — "), rest)).otherwise(appendix), appendix))
        .when(text.rlike(P.PLAIN_NAMED), row("named", None, F.trim(F.regexp_replace(text, ":$", ""))))
    )


def segment_plain(lines: DataFrame, min_chars: int = 40) -> DataFrame:
    """Linear segments of plain text: each heading opens one; the chapter is inherited."""
    head = plain_heading(F.trim("text"))
    marked = place_blocks(lines, "doc_id", "line_no").withColumn("head", head).withColumn("start", F.when(F.col("head").isNotNull(), F.col("line_no")))
    is_chapter = F.col("head.kind") == "chapter"
    marked = marked.withColumn("is_heading", F.col("head").isNotNull()).withColumn(
        "chapter", F.when(is_chapter, F.col("head.section"))).withColumn("chapter_title", F.when(is_chapter, F.col("head.title")))
    carried = carry_forward(marked, "doc_id", "line_no", ["head", "start", "chapter", "chapter_title"])
    front = F.struct(
        F.lit("front").alias("kind"), F.lit(None).cast("string").alias("record_id"),
        F.concat(F.col("doc_id"), F.lit(" — front matter")).alias("title"), F.lit(None).cast("string").alias("section"))
    body = carried.where(~F.col("is_heading")).withColumn("start", F.coalesce("start", F.lit(-1))).withColumn("head", F.coalesce("head", front))
    segments = body.groupBy("doc_id", "start").agg(
        F.first("head").alias("head"), F.first("chapter").alias("chapter"), F.first("chapter_title").alias("chapter_title"),
        F.expr("listagg(trim(text), ' ') within group (order by line_no)").alias("body"))
    kind = F.col("head.kind")
    record_type = (
        F.when(kind == "record", L.record_type(F.col("head.record_id"))).when(kind == "card", F.lit("knowledge_card"))
        .when(kind.isin("front", "chapter"), F.lit("chapter")).when(kind == "named", F.lit("section")).otherwise(kind))
    return segments.where(F.length(F.trim("body")) > min_chars).select(
        "doc_id", "start", F.col("head.record_id").alias("record_id"), record_type.alias("record_type"),
        F.col("head.title").alias("title"), F.col("head.section").alias("section"), "chapter", "chapter_title",
        F.trim("body").alias("body"))


def split_notes(segments: DataFrame, min_preamble: int = 60, min_note: int = 40) -> DataFrame:
    """A segment with two or more notes becomes its preamble and one segment per note."""
    mark = "\u0001"
    parts = F.split(F.regexp_replace("body", P.FIELD_NOTE, mark + "$1 $2"), mark)
    rows = segments.withColumn("parts", parts).withColumn("many", F.size("parts") > 2)
    rows = unroll(rows, ["*"], F.when(F.col("many"), F.col("parts")).otherwise(F.array("body")), "part", "part_no")
    part = F.trim("part")
    note = F.col("many") & (F.col("part_no") > 0)
    keep = F.when(note, F.length(part) >= min_note).when(F.col("many"), F.length(part) > min_preamble).otherwise(F.lit(True))
    note_id = F.regexp_extract("part", P.FIELD_NOTE, 2)
    return rows.where(keep).select(
        "doc_id", "start", "part_no", F.when(note, note_id).otherwise(F.col("record_id")).alias("record_id"),
        F.when(note, F.lit("field_note")).otherwise(F.col("record_type")).alias("record_type"),
        F.when(note, F.concat(F.regexp_extract("part", P.FIELD_NOTE, 1), F.lit(" "), note_id)).otherwise(F.col("title")).alias("title"),
        "section", "chapter", "chapter_title", part.alias("body"))


def locate(lines: DataFrame) -> DataFrame:
    """Add ``chapter`` and ``page`` by the last chapter heading or page marker at or before each line."""
    text = F.col("text")
    marked = place_blocks(lines, "doc_id", "line_no").withColumn(
        "chapter", F.when(text.rlike(P.MD_CHAPTER), F.concat(
            F.regexp_extract(text, P.MD_CHAPTER, 1), F.lit(" · "), F.trim(F.regexp_extract(text, P.MD_CHAPTER, 2)))))
    marked = marked.withColumn("page", X.group(text, P.PAGE_MARKER, 1).cast("bigint"))
    return carry_forward(marked, "doc_id", "line_no", ["chapter", "page"])


def outline(lines: DataFrame, end_level: int = 3) -> DataFrame:
    """Each markdown line with the record or piece it belongs to, its chapter and its page.

    A record runs from its heading to the next record or the next heading of level
    ``end_level`` or less. ``record_id`` is the empty string outside of records.
    """
    text = F.col("text")
    # Body lines fail the prefix tests, so the patterns run on headings and markers alone.
    hashed = text.startswith("#")
    record = hashed & text.rlike(P.MD_RECORD_HEADING)
    heading = hashed & text.rlike(P.MD_HEADING)
    level = F.when(heading, F.length(F.regexp_extract(text, P.MD_HEADING, 1)))
    boundary = F.coalesce(record | (heading & (level <= end_level)), F.lit(False))
    marked = place_blocks(lines, "doc_id", "line_no").select(
        "*", F.when(boundary, F.col("line_no")).alias("segment"),
        F.when(record, F.regexp_extract(text, P.MD_RECORD_HEADING, 1)).when(boundary, F.lit("")).alias("record_id"),
        F.when(record, F.trim(F.regexp_extract(text, P.MD_RECORD_HEADING, 2))).when(boundary, F.lit("")).alias("title"),
        F.when(heading, F.col("line_no")).alias("piece"),
        F.when(hashed & text.rlike(P.MD_CHAPTER), F.concat(
            F.regexp_extract(text, P.MD_CHAPTER, 1), F.lit(" · "), F.trim(F.regexp_extract(text, P.MD_CHAPTER, 2)))).alias("chapter"),
        F.when(text.startswith("[["), X.group(text, P.PAGE_MARKER, 1)).cast("bigint").alias("page"))
    return carry_forward(marked, "doc_id", "line_no", ["segment", "record_id", "title", "piece", "chapter", "page"])


#: The place of text before the first heading.
NO_HEADING = -(1 << 40)
_JOIN_LINES = "listagg(text, '\n') within group (order by line_no)"


def record_chunks(lines: DataFrame, end_level: int = 3) -> DataFrame:
    """One labelled chunk per record, a provenance header before its text."""
    rows = outline(lines, end_level).where(F.col("record_id") != "")
    return _labelled_records(rows.groupBy("doc_id", "segment").agg(
        F.first("record_id").alias("record_id"), F.first("title").alias("title"), F.first("chapter").alias("chapter"),
        F.min_by("page", "line_no").alias("page"), F.expr(_JOIN_LINES).alias("body")))


def _labelled_records(segments: DataFrame) -> DataFrame:
    segments = segments.withColumn("body", X.trim_edges(F.col("body"))).withColumn("record_type", L.record_type(F.col("record_id")))
    header = _record_header(F.col("record_id"), F.col("title"), F.col("chapter"))
    return segments.select(
        F.concat(F.lit("rec-"), F.lower("record_id")).alias("chunk_id"), "doc_id", F.col("segment").alias("ordinal"), "record_id",
        "record_type", "title", "chapter", F.col("title").alias("section"), "page",
        L.region_listed(F.col("body")).alias("region_id"), L.evidence_quality(F.col("record_type"), F.col("body")).alias("evidence_quality"),
        L.risk_level(F.col("body")).alias("risk_level"), F.lit(None).cast("string").alias("record_date"),
        F.concat(header, "body").alias("content"))


def _record_header(record_id: Column, title: Column, chapter: Column) -> Column:
    of_chapter = F.when(chapter.isNotNull(), F.concat(F.lit(" · Chapter "), chapter)).otherwise(F.lit(""))
    return F.concat(F.trim(F.concat(F.lit("["), record_id, F.lit("] "), title)), of_chapter, F.lit("\n\n"))


def _cells(row: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(row), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))


def _row_key(record_id: Column, cells: Column) -> Column:
    return F.concat_ws("|", record_id, F.slice(cells, 1, 4))


def _row_fields(line_no: Column, record_id: Column, cells: Column) -> dict[str, Column]:
    """A monitoring row's chunk, apart from what is read from its body."""
    record_date = F.try_element_at(F.filter(cells, lambda c: c.rlike(rf"^{P.ISO_DATE}$")), F.lit(1))
    label = F.when(record_id.startswith("WS"), F.lit("Water monitoring reading")).otherwise(F.lit("Wildlife survey record"))
    low = F.exists(cells, lambda c: F.lower(c) == "low")
    return {
        "chunk_id": F.concat(F.lit("row-"), F.lower(record_id), F.lit("-"), F.coalesce(record_date, line_no.cast("string"))),
        "ordinal": line_no, "record_id": record_id, "record_type": F.lit("monitoring"), "title": F.concat(record_id, F.lit(" "), label),
        "section": label, "evidence_quality": F.when(low, F.lit("disputed report")).otherwise(F.lit("verified observation")),
        "record_date": record_date, "header": F.concat(F.lit("["), record_id, F.lit("] "), label, F.lit("\n\n")),
        "body": F.array_join(F.filter(cells, lambda c: c != ""), " · ")}


def table_row_chunks(lines: DataFrame) -> DataFrame:
    """One chunk per monitoring row; repeats of an ID and its first four cells are dropped within a document."""
    ids = X.find_all(F.col("text"), P.TABLE_ROW_ID)
    rows = lines.where(F.trim("text").startswith("|") & (F.size(ids) > 0)).select(
        "doc_id", "line_no", F.element_at(ids, 1).alias("record_id"), _cells(F.col("text")).alias("cells")).where(F.size("cells") >= 3)
    rows = rows.withColumn("key", _row_key(F.col("record_id"), F.col("cells")))
    rows = first_per(rows, ["doc_id", "key"], [F.asc("line_no")])
    fields = _row_fields(F.col("line_no"), F.col("record_id"), F.col("cells"))
    rows = rows.select("doc_id", *[c.alias(k) for k, c in fields.items()])
    return rows.select(
        "chunk_id", "doc_id", "ordinal", "record_id", "record_type", "title", "section", L.region_listed(F.col("body")).alias("region_id"),
        "evidence_quality", "record_date", F.concat("header", "body").alias("content"))


#: A labelled note, up to the next label, heading or the end.
_NOTE = rf"(?s)((?:{P.FIELD_NOTE_LABEL})[,.]?\s*.+?)(?={P.FIELD_NOTE_LABEL}|\n#|\z)"


def _note_title(note: Column) -> Column:
    return F.regexp_extract(note, rf"^({P.FIELD_NOTE_LABEL})", 1)


def _note_body(note: Column) -> Column:
    return X.fold(F.regexp_replace(note, rf"^(?:{P.FIELD_NOTE_LABEL})[,.]?\s*", ""))


def _note_fields(title: Column, body: Column) -> dict[str, Column]:
    """A note's chunk, apart from its place and what is read from its body as from any other."""
    record_id = F.regexp_extract(title, r"(FN-[AB]|LAB-C)", 1)
    return {
        "record_id": record_id, "record_type": F.lit("field_note"), "title": title, "evidence_quality": F.lit("disputed report"),
        "record_date": X.group(body, f"({P.ISO_DATE})", 1), "header": F.concat(F.lit("["), record_id, F.lit("] "), title, F.lit("\n\n")), "body": body}


def field_note_chunks(texts: DataFrame, keys: list[str], text: str = "text", min_chars: int = 40) -> DataFrame:
    """Labelled notes cut out of running text, each up to the next label, heading or the end."""
    rows = unroll(texts, [*keys], X.find_all(F.col(text), _NOTE), "note", "note_no")
    rows = rows.withColumn("title", _note_title(F.col("note"))).withColumn("body", _note_body(F.col("note"))).where(F.length("body") >= min_chars)
    fields = _note_fields(F.col("title"), F.col("body"))
    return rows.select(
        *keys, "note_no", *[fields[c].alias(c) for c in ("record_id", "record_type", "title", "evidence_quality")],
        L.region_listed(F.col("body")).alias("region_id"), fields["record_date"].alias("record_date"), F.concat(fields["header"], fields["body"]).alias("content"))


def narrative_pieces(lines: DataFrame, end_level: int = 3, min_chars: int = P.NARRATIVE_PIECE) -> DataFrame:
    """Text outside of records, one piece per heading; short pieces are dropped."""
    rows = outline(lines, end_level).where(F.coalesce("record_id", F.lit("")) == "")
    rows = rows.withColumn("piece", F.coalesce(F.greatest("piece", "segment"), F.lit(NO_HEADING)))
    return _titled_pieces(rows.groupBy("doc_id", "piece").agg(
        F.first("chapter").alias("chapter"), F.min_by("page", "line_no").alias("page"), F.expr(_JOIN_LINES).alias("content")), min_chars)


def _titled_pieces(pieces: DataFrame, min_chars: int) -> DataFrame:
    pieces = pieces.withColumn("content", X.trim_edges(F.col("content"))).where(F.length("content") >= min_chars)
    return pieces.select("doc_id", "piece", "chapter", "page", _piece_title(F.col("content")).alias("title"), "content")


def _piece_title(content: Column) -> Column:
    return F.trim(F.regexp_replace(F.element_at(F.split(content, "\n"), 1), "^[# ]+", ""))


def _window_key(chapter: Column, title: Column, piece: Column, window_no: Column) -> Column:
    return F.concat_ws("-", F.lit("nar"), X.slug(F.coalesce(chapter, F.lit("general"))), X.slug(title), piece.cast("string"), window_no.cast("string"))


def narrative_chunks(pieces: DataFrame, limit: int = P.WINDOW_CHARS, overlap: int = P.WINDOW_OVERLAP, paragraph: str = "\n\n",
                     min_body: int = 100) -> DataFrame:
    """Pack pieces into windows; a window whose text without headings is short is dropped."""
    rows = unroll(pieces, ["doc_id", "piece", "chapter", "page", "title"], X.pack_paragraphs(F.col("content"), limit, overlap, paragraph), "window", "window_no")
    rows = rows.where(F.length(X.body_without_headings(F.col("window"))) >= min_body)
    return rows.select(
        _window_key(F.col("chapter"), F.col("title"), F.col("piece"), F.col("window_no")).alias("chunk_id"),
        "doc_id", F.col("piece").alias("ordinal"), F.lit(None).cast("string").alias("record_id"), F.lit("narrative").alias("record_type"),
        "title", "chapter", F.col("title").alias("section"), "page", L.region_listed(F.col("window")).alias("region_id"),
        L.evidence_quality(F.lit("narrative"), F.col("window")).alias("evidence_quality"), F.col("window").alias("content"))


def unique_keys(chunks: DataFrame, key: str = "chunk_id", order: str = "ordinal") -> DataFrame:
    """The nth repeat of a key gets ``-n``."""
    return _number_repeats(number_rows(chunks, key, order, "__nth"), key)


def _number_repeats(numbered: DataFrame, key: str) -> DataFrame:
    suffix = F.when(F.col("__nth") > 1, F.concat(F.lit("-"), (F.col("__nth") - 1).cast("string"))).otherwise(F.lit(""))
    return numbered.withColumn(key, F.concat(key, suffix)).drop("__nth")


def heading_pieces(lines: DataFrame, heading: str = "^#") -> DataFrame:
    """All text of a document cut at its headings: ``doc_id``, ``piece`` (line of the heading, far below 0 before the first),
    ``content``, and ``page`` where the lines have one."""
    placed = place_blocks(lines, "doc_id", "line_no").withColumn("piece", F.when(F.col("text").rlike(heading), F.col("line_no")))
    rows = carry_forward(placed, "doc_id", "line_no", ["piece"])
    page = [F.min_by("page", "line_no").alias("page")] if "page" in lines.columns else []
    return rows.groupBy("doc_id", F.coalesce("piece", F.lit(NO_HEADING)).alias("piece")).agg(F.expr(_JOIN_LINES).alias("content"), *page)


#: Columns of a chunk before it is embedded.
CHUNK_COLUMNS = [
    "chunk_id", "doc_id", "ordinal", "record_id", "record_type", "title", "chapter", "section", "page", "region_id", "evidence_quality", "risk_level",
    "record_date", "content"]


#: Documents of more lines are scanned block by block.
LARGE_LINES = 1 << 18


def corpus_chunks(lines: DataFrame, large: DataFrame | None = None, placed: Callable[[DataFrame | None], DataFrame] | None = None) -> DataFrame:
    """The four tiers of a corpus-shaped document: records, table rows, field notes, narrative windows, under keys of its own.

    A key is the document's ID before the tier's key, so no two documents share one; what repeats inside a document is
    numbered in the order of tiers and lines. Notes are cut out of all text, that of records included, as they are
    evidence by themselves.

    Documents are cut in the task that they are placed in, one shuffle of the lines at most. Those of more than
    ``LARGE_LINES`` lines are spread over many tasks: the IDs in ``large``, counted here if they are not given. ``placed``
    makes the lines of all documents but those it is given, each document in one task; it is used for the others.
    """
    if large is None:
        large = lines.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > LARGE_LINES).select("doc_id")
    n = large.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return _placed_chunks(placed(None) if placed else lines)
    hinted = F.broadcast(large) if n <= BROADCAST_ROWS else large
    others = placed(hinted) if placed else lines.join(hinted, "doc_id", "left_anti")
    return _placed_chunks(others).unionByName(_block_chunks(lines.join(hinted, "doc_id", "left_semi")))


def _block_chunks(lines: DataFrame) -> DataFrame:
    """Chunks of lines that are scanned in blocks; stored before their keys are numbered, which reads them several times."""
    tiers = stored(_tiers(record_chunks(lines), table_row_chunks(lines), heading_pieces(lines), narrative_pieces(lines)), "tiers")
    return unique_keys(tiers, "chunk_id", "__order").drop("__order")


def _line_parts(lines: DataFrame) -> DataFrame:
    """Lines cut before their headings as in ``outline``, each document in one task.

    ``piece`` is the first line of a part, or ``NO_HEADING``; ``hashes`` the lines with a hash sign, ``rows`` those of tables.
    """
    text, line_no = F.col("text"), F.col("line_no")
    hashed = text.startswith("#")
    cut = hashed & (text.rlike(P.MD_RECORD_HEADING) | text.rlike(P.MD_HEADING))
    sofar = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    piece = F.coalesce(F.last(F.when(cut, line_no), ignorenulls=True).over(sofar), F.lit(NO_HEADING))
    marker = F.when(text.startswith("[["), X.group(text, P.PAGE_MARKER, 1)).cast("bigint")
    parts = lines.select("doc_id", "line_no", "text", piece.alias("piece")).groupBy("doc_id", "piece").agg(
        F.expr(_JOIN_LINES).alias("text"), F.max(F.when(line_no == F.col("piece"), text)).alias("head"),
        F.min_by(marker, line_no).alias("page"), F.max_by(marker, F.when(marker.isNotNull(), line_no)).alias("last_page"),
        F.sort_array(F.collect_list(F.when(hashed, line_no))).alias("hashes"),
        F.collect_list(F.when(F.trim(text).startswith("|"), F.struct(line_no, text))).alias("rows"))
    head = F.col("head")
    record = F.coalesce(head.rlike(P.MD_RECORD_HEADING), F.lit(False))
    upto = Window.partitionBy("doc_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    chapter = F.when(head.rlike(P.MD_CHAPTER), F.concat(
        F.regexp_extract(head, P.MD_CHAPTER, 1), F.lit(" · "), F.trim(F.regexp_extract(head, P.MD_CHAPTER, 2))))
    return parts.select(
        "doc_id", "piece", "text", "hashes", "rows", F.when(record, F.regexp_extract(head, P.MD_RECORD_HEADING, 1)).alias("record_id"),
        F.when(record, F.trim(F.regexp_extract(head, P.MD_RECORD_HEADING, 2))).alias("record_title"),
        F.last(chapter, ignorenulls=True).over(upto).alias("chapter"),
        F.coalesce("page", F.last("last_page", ignorenulls=True).over(before)).alias("page"))


_ITEM = ("chunk_id", "ordinal", "record_id", "record_type", "title", "section", "evidence_quality", "record_date", "header", "body", "row")


def _item(tier: int, fields: dict[str, Column]) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(F.lit(tier).cast("bigint").alias("tier"), *[fields.get(c, null).alias(c) for c in _ITEM])


def _placed_chunks(lines: DataFrame) -> DataFrame:
    """Chunks of documents that each lie in one task: every part yields all of its tiers at once, so nothing is shuffled or read again."""
    parts = _line_parts(lines).withColumn("body", X.trim_edges(F.col("text")))
    text, body, piece, record_id = F.col("text"), F.col("body"), F.col("piece"), F.col("record_id")
    in_record = record_id.isNotNull()
    record = _item(0, {
        "chunk_id": F.concat(F.lit("rec-"), F.lower(record_id)), "ordinal": piece, "record_id": record_id, "record_type": L.record_type(record_id),
        "title": F.col("record_title"), "section": F.col("record_title"), "header": _record_header(record_id, F.col("record_title"), F.col("chapter")), "body": body})

    cells = F.transform("rows", lambda row: F.struct(
        row["line_no"].alias("line_no"), F.get(X.find_all(row["text"], P.TABLE_ROW_ID), F.lit(0)).alias("record_id"), _cells(row["text"]).alias("cells")))
    cells = F.filter(cells, lambda row: row["record_id"].isNotNull() & (F.size(row["cells"]) >= 3))
    rows = F.transform(cells, lambda row: _item(1, _row_fields(row["line_no"], row["record_id"], row["cells"]) | {
        "row": _row_key(row["record_id"], row["cells"])}))

    # Notes are cut at every line with a hash sign, heading or not.
    starts = F.when(text.startswith("#"), F.col("hashes")).otherwise(F.concat(F.array(F.lit(NO_HEADING)), "hashes"))
    notes = F.flatten(F.transform(F.split(text, "\n(?=#)"), lambda content, i: F.transform(X.find_all(content, _NOTE), lambda note, nth: F.struct(
        (F.get(starts, i) + nth).alias("ordinal"), _note_title(note).alias("title"), _note_body(note).alias("body")))))
    notes = F.transform(F.filter(notes, lambda note: F.length(note["body"]) >= 40), lambda note: _item(2, _note_fields(note["title"], note["body"]) | {
        "ordinal": note["ordinal"], "chunk_id": F.concat(F.lit("note-"), F.lower(_note_fields(note["title"], note["body"])["record_id"]))}))

    title = _piece_title(body)
    windows = F.transform(X.pack_paragraphs(body), lambda window, n: _item(3, {
        "chunk_id": _window_key(F.col("chapter"), F.col("piece_title"), piece, n), "ordinal": piece, "record_type": F.lit("narrative"), "title": F.col("piece_title"),
        "section": F.col("piece_title"), "header": F.lit(""), "body": window}))
    windows = F.filter(windows, lambda item: F.length(X.body_without_headings(item["body"])) >= 100)

    def some(condition: Column, items: Column) -> Column:
        return F.when(condition, items).otherwise(F.filter(F.array(record), lambda item: F.lit(False)))

    items = F.concat(
        some(in_record, F.array(record)), some(F.size("rows") > 0, rows), some(text.rlike(P.FIELD_NOTE_LABEL), notes),
        some(~in_record & (F.length("body") >= P.NARRATIVE_PIECE), windows))
    out = unroll(parts.withColumn("piece_title", title), ["doc_id", "chapter", "page"], items, "item").select("doc_id", "chapter", "page", "item.*")
    first = F.row_number().over(Window.partitionBy("doc_id", "row").orderBy("ordinal"))
    out = out.withColumn("__first", first).where(F.col("row").isNull() | (F.col("__first") == 1))

    tier, told = F.col("tier"), F.col("evidence_quality")
    own = lambda c: F.when(tier.isin(0, 3), F.col(c))
    chunks = out.select(
        F.concat_ws("-", "doc_id", "chunk_id").alias("chunk_id"), "doc_id", "ordinal", "record_id", "record_type", "title", own("chapter").alias("chapter"),
        "section", own("page").alias("page"), L.region_listed(F.col("body")).alias("region_id"),
        F.when(told.isNotNull(), told).otherwise(L.evidence_quality(F.col("record_type"), F.col("body"))).alias("evidence_quality"),
        F.when(tier == 0, L.risk_level(F.col("body"))).alias("risk_level"), "record_date", F.concat("header", "body").alias("content"),
        (tier * (1 << 44) + F.col("ordinal")).alias("__order"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy("__order"))
    return _number_repeats(chunks.withColumn("__nth", nth), "chunk_id").select(*CHUNK_COLUMNS)


def _tiers(records: DataFrame, table_rows: DataFrame, noted: DataFrame, narratives: DataFrame) -> DataFrame:
    """The tiers under keys that hold the document's ID, ``__order`` being their order."""
    notes = field_note_chunks(noted, ["doc_id", "piece"], "content").select(
        F.concat(F.lit("note-"), F.lower("record_id")).alias("chunk_id"), "*", (F.col("piece") + F.col("note_no")).alias("ordinal"))
    out = None
    for n, tier in enumerate([records, table_rows, notes, narrative_chunks(narratives)]):
        missing = [F.lit(None).cast("int" if c == "page" else "string").alias(c) for c in CHUNK_COLUMNS if c not in tier.columns]
        rows = tier.select("*", *missing).select(*CHUNK_COLUMNS, (F.lit(n).cast("bigint") * (1 << 44) + F.col("ordinal")).alias("__order"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_id"))


def _cut_before(*headings: str) -> str:
    """A pattern that cuts a text of many lines before each line that fits one of the headings."""
    shapes = [h.removeprefix("^").replace(r"\s", r"[^\S\n]") for h in headings]
    return "\n(?=" + "|".join(h[:-1] + r"[\r\u0085\u2028\u2029]?(?:\n|\z)" if h.endswith("$") else h for h in shapes) + ")"


#: A page marker as one line of a longer text.
_MARKER = P.PAGE_MARKER[1:-1] + r"[\r\u0085\u2028\u2029]?"


def document_parts(docs: DataFrame, threshold: int = P.RECORD_AWARE_IDS) -> DataFrame:
    """Whole documents ``(doc_id, doc_name, text)`` cut before their headings, as ``outline`` and ``upload_chunks`` cut lines.

    ``aware`` tells whether the document holds ``threshold`` distinct record IDs. Each part has the number of its first
    line, ``piece`` (the same, or ``NO_HEADING`` for what stands before the first heading), record, chapter and page. A
    document arrives in one row, so the order of its parts is settled where it lies, in one pass.
    """
    lines = F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n")
    plain = F.array_join(F.transform(lines, lambda line: F.trim(line)), "\n")
    whole = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").repartition("doc_id").select("doc_id", "doc_name", plain.alias("text"))
    # The look-ahead spares most characters the pattern; every ID starts with a capital.
    ids = F.array_distinct(X.find_all(F.col("text"), f"(?=[A-Z])({P.RECORD_ID_ANY})", 1))
    aware = F.col("aware")
    cut = F.when(aware, F.split("text", _cut_before(P.MD_RECORD_HEADING, P.MD_HEADING))).otherwise(F.split("text", _cut_before(P.UPLOAD_HEADING)))
    parts = unroll(whole.withColumn("aware", F.size(ids) >= threshold), ["doc_id", "doc_name", "aware"], cut, "text", "part")
    text, head = F.col("text"), F.col("head")
    record = head.rlike(P.MD_RECORD_HEADING)
    leading = F.when(aware, X.group(text, rf"\A{_MARKER}(?:\n|\z)", 1)).otherwise(X.group(text, rf"\A(?:{_MARKER}(?:\n|\z))+", 1))
    paged = text.contains("[[PAGE ")
    marked = parts.withColumn("head", F.substring_index("text", "\n", 1)).select(
        "doc_id", "doc_name", "aware", "part", "text", (record | head.rlike(P.MD_HEADING) | (~aware & head.rlike(P.UPLOAD_HEADING))).alias("headed"),
        F.when(record, F.regexp_extract(head, P.MD_RECORD_HEADING, 1)).otherwise(F.lit("")).alias("record_id"),
        F.when(record, F.trim(F.regexp_extract(head, P.MD_RECORD_HEADING, 2))).otherwise(F.lit("")).alias("title"),
        F.when(head.rlike(P.MD_CHAPTER), F.concat(
            F.regexp_extract(head, P.MD_CHAPTER, 1), F.lit(" · "), F.trim(F.regexp_extract(head, P.MD_CHAPTER, 2)))).alias("chapter"),
        (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
        F.when(paged & (F.col("part") == 0), leading).try_cast("bigint").alias("page"),
        F.when(paged, F.element_at(X.find_all(text, rf"(?:\A|\n){_MARKER}(?=\n|\z)"), -1)).try_cast("bigint").alias("last_page"))
    upto = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.select(
        "doc_id", "doc_name", "aware", "text", "headed", "record_id", "title", F.last("chapter", ignorenulls=True).over(upto).alias("chapter"),
        F.coalesce("page", F.last("last_page", ignorenulls=True).over(before)).alias("page"),
        F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("line_no"))
    return placed.withColumn("piece", F.when(F.col("headed"), F.col("line_no")).otherwise(F.lit(NO_HEADING))).drop("headed")


def _lines_that_start(parts: DataFrame, mark: str) -> DataFrame:
    """The lines of parts that start with ``mark``, and their numbers."""
    some = parts.where(F.col("text").startswith(mark) | F.col("text").contains("\n" + mark))
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("at"), line.alias("text")))
    rows = unroll(some, ["doc_id", "line_no"], F.filter(numbered, lambda line: line["text"].startswith(mark)), "line")
    return rows.select("doc_id", (F.col("line_no") + F.col("line.at")).alias("line_no"), F.col("line.text").alias("text"))


def _noted_pieces(parts: DataFrame) -> DataFrame:
    """What ``heading_pieces`` cuts, of the parts that hold a note."""
    noted = parts.where(F.col("text").rlike(P.FIELD_NOTE_LABEL)).select("doc_id", "line_no", F.split("text", "\n").alias("lines"))
    at = F.filter(F.transform("lines", lambda line, i: F.when((i == 0) | line.startswith("#"), i)), lambda i: i.isNotNull())
    starts = noted.withColumn("starts", at)
    end = lambda n: F.coalesce(F.get("starts", n + 1), F.size("lines"))
    cut = F.transform("starts", lambda i, n: F.struct(i.alias("at"), F.array_join(F.slice("lines", i + 1, end(n) - i), "\n").alias("content")))
    rows = unroll(starts, ["doc_id", "line_no"], cut, "cut").select("doc_id", F.col("line_no") + F.col("cut.at"), "cut.content").toDF("doc_id", "line_no", "content")
    return rows.select("doc_id", F.when(F.col("content").startswith("#"), F.col("line_no")).otherwise(F.lit(NO_HEADING)).alias("piece"), "content")


def chunk_documents(docs: DataFrame, threshold: int = P.RECORD_AWARE_IDS) -> DataFrame:
    """Chunks of documents ``(doc_id, doc_name, text)``, each by the mode its own text calls for.

    One with ``threshold`` distinct record IDs or more is read tier by tier, any other as narrative. Texts are cut and stored
    once; each tier reads these parts where they lie. A key repeats inside one document at most, so its repeats are numbered
    in one sort.
    """
    parts = durable(document_parts(docs, threshold))
    aware, plain = parts.where("aware"), parts.where("NOT aware")
    in_record = F.col("record_id") != ""
    records = aware.where(in_record).select(
        "doc_id", F.col("line_no").alias("segment"), "record_id", "title", "chapter", "page", F.col("text").alias("body"))
    narratives = aware.where(~in_record).select("doc_id", "piece", "chapter", "page", F.col("text").alias("content"))
    tiers = _tiers(_labelled_records(records), table_row_chunks(_lines_that_start(aware, "|")), _noted_pieces(aware),
                   _titled_pieces(narratives, P.NARRATIVE_PIECE))
    nth = F.row_number().over(Window.partitionBy("chunk_id").orderBy("__order"))
    keyed = _number_repeats(tiers.withColumn("__nth", nth), "chunk_id").drop("__order")
    kept = F.filter(F.split("text", "\n"), lambda line: ~line.rlike(P.PAGE_MARKER))
    body = F.when(F.col("text").contains("[[PAGE "), F.array_join(kept, "\n")).otherwise(F.col("text"))
    uploads = _upload_windows(plain.select("doc_id", "doc_name", "piece", "page", body.alias("content"))).select(
        F.concat_ws("-", "doc_id", F.lit("up"), F.col("piece").cast("string"), F.col("window_no").cast("string")).alias("chunk_id"), "doc_id",
        F.col("piece").alias("ordinal"), "title", "section", "page", F.lit("narrative").alias("record_type"),
        L.evidence_quality(F.lit("narrative"), F.col("content")).alias("evidence_quality"), "content")
    return keyed.unionByName(uploads, allowMissingColumns=True)


def inventory_problems(chunks: DataFrame, expected: dict[str, int], critical: list[str], min_chars: int = 50) -> DataFrame:
    """What a seed should not be published with: ``problem`` and ``detail`` rows, none if all is well.

    Record types with another count than ``expected``, ``critical`` records that are missing, records that hold another
    record's header, and chunks that are next to empty. ``expected`` and ``critical`` are parameters of a fixed size.
    """
    spark = chunks.sparkSession
    heads = X.find_all(F.col("content"), r"(?m)^\[([A-Z]{2,3}-\d+)\]", 1)
    others = F.array_sort(F.array_remove(F.array_distinct(heads), F.col("record_id")))
    others = F.when(F.col("record_id").isNotNull() & (F.col("record_type") != "narrative"), others)
    # One pass over the texts; what is kept of a chunk without a problem is its type, and its ID if it is critical.
    judged = chunks.select(
        "chunk_id", "record_type", F.when(F.col("record_id").isin(critical), F.col("record_id")).alias("record_id"),
        F.when(F.size(others) > 0, F.array_join(others, ",")).alias("others"), (F.length(F.trim("content")) < min_chars).alias("bare"))
    judged = stored(judged.withColumn("chunk_id", F.when(F.col("others").isNotNull() | F.col("bare"), F.col("chunk_id"))), "judged")
    wanted = spark.createDataFrame(list(expected.items()), "record_type string, expected long")
    counts = judged.groupBy("record_type").agg(F.count("*").alias("found"))
    off = wanted.join(counts, "record_type", "left").where(F.coalesce("found", F.lit(0)) != F.col("expected")).select(
        F.lit("count").alias("problem"), F.concat(F.col("record_type"), F.lit(": expected "), "expected", F.lit(", got "), F.coalesce("found", F.lit(0))).alias("detail"))
    named = spark.createDataFrame([(c,) for c in critical], "record_id string")
    gone = named.join(judged.select("record_id").distinct(), "record_id", "left_anti").select(F.lit("missing").alias("problem"), F.col("record_id").alias("detail"))
    mixed = judged.where("others IS NOT NULL").select(F.lit("mixed").alias("problem"), F.concat("chunk_id", F.lit(": "), "others").alias("detail"))
    bare = judged.where("bare").select(F.lit("short").alias("problem"), F.col("chunk_id").alias("detail"))
    return off.unionByName(gone).unionByName(mixed).unionByName(bare)


def chunking_mode(lines: DataFrame, threshold: int = P.RECORD_AWARE_IDS) -> DataFrame:
    """Distinct record IDs per document and the chunking mode they call for."""
    ids = unroll(lines, ["doc_id"], X.find_all(F.col("text"), f"({P.RECORD_ID_ANY})", 1), "id").distinct()
    counts = ids.groupBy("doc_id").agg(F.count("*").alias("record_count"))
    docs = lines.select("doc_id").distinct().join(counts, "doc_id", "left")
    count = F.coalesce("record_count", F.lit(0))
    return docs.select("doc_id", count.alias("record_count"),
                       F.when(count >= threshold, F.lit("record_aware")).otherwise(F.lit("narrative")).alias("mode"))


def upload_chunks(lines: DataFrame, names: DataFrame, min_chars: int = P.UPLOAD_PIECE, paragraph: str = "\n\n") -> DataFrame:
    """Narrative chunking of an upload: all of its text cut at headings, a short first line becomes the heading."""
    paged = locate(lines).where(~F.col("text").rlike(P.PAGE_MARKER))
    return _upload_windows(heading_pieces(paged, P.UPLOAD_HEADING).join(names, "doc_id"), min_chars, paragraph)


def _upload_windows(pieces: DataFrame, min_chars: int = P.UPLOAD_PIECE, paragraph: str = "\n\n") -> DataFrame:
    pieces = pieces.withColumn("content", X.trim_edges(F.col("content"))).where(F.length("content") >= min_chars)
    first = F.trim(F.regexp_replace(F.element_at(F.split("content", "\n"), 1), "^[# ]+", ""))
    heading = F.when(F.length(first) < 120, F.substring(first, 1, 80)).otherwise(F.lit(""))
    rows = unroll(pieces, ["doc_id", "doc_name", "piece", "page", heading.alias("section")], X.pack_paragraphs(F.col("content"), paragraph=paragraph), "window", "window_no")
    return rows.select(
        "doc_id", "piece", "window_no", "page", "section", F.when(F.col("section") != "", F.col("section")).otherwise(F.col("doc_name")).alias("title"),
        F.when(F.col("section") != "", F.concat(F.lit("["), "doc_name", F.lit("] "), "section", F.lit("\n\n"), "window"))
        .otherwise(F.col("window")).alias("content"))


def segment_chunks(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Final chunks of plain segments: heading, ``(part i of n)``, token estimate.

    ``segments`` carries ``sentences``; ``keys`` identify a segment in order.
    """
    rows = segments.withColumn("bodies", X.pack_sentences(F.col("sentences"))).withColumn("parts", F.size("bodies"))
    rows = unroll(rows, ["*"], "bodies", "part_body", "part_no")
    heading = (
        F.when(F.col("record_id").isNotNull(), F.concat("record_id", F.lit(" — "), "title"))
        .when(F.col("section").isNotNull(), F.concat("section", F.lit(" "), "title")).otherwise(F.col("title")))
    counter = F.when(F.col("parts") > 1, F.concat(
        F.lit(" (part "), (F.col("part_no") + 1).cast("string"), F.lit(" of "), F.col("parts").cast("string"), F.lit(")"))).otherwise(F.lit(""))
    text = F.concat(heading, counter, F.lit("\n"), "part_body")
    return rows.select(*keys, "part_no", "record_id", "record_type", text.alias("content"),
                       F.ceil(F.length(text) / 4).cast("bigint").alias("tokens"))
