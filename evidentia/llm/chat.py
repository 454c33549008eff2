"""Chat formatting of typed content parts, with attachments, a loss mask and a way back.

A message is a list of parts: text, image, audio or document. A visitor turns each part into a segment: text is escaped,
media become placeholders in their order, the k-th placeholder of a conversation standing for its k-th attachment, whose
reference and number of tokens after expansion are recorded. Messages are put between the marks of their role, and the
messages of a conversation follow each other. Only what an assistant says is under the loss mask.

Escaping is reversible: every control string starts with ``[`` or ``<`` and holds neither again, and a text gets one
backslash more behind such a sign wherever a control string with any number of backslashes behind its first sign would
stand. So no text holds a control string, and taking one backslash away gives the text back. Adjacent text parts are kept
apart by a mark of their own, since two harmless parts could make a control string together.

Everything is built-in expressions. One shuffle brings the messages of a conversation together, by its ID; a conversation
is one row of the result, so the longest one bounds the memory of a task.

Defined results: messages follow by turn, then role, then content, a NULL turn first; a NULL text or part list is one empty
text, a NULL role an empty name, a NULL ID an ID; parts of other kinds are text; media of unknown size count one token; messages that
repeat are messages; an empty table has no conversation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import let, table

# The template's control strings.
BEGIN = "<s>"
TURNS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
OTHER, NAMED, OTHER_END = "[ROLE]", "[SEP]", "[/ROLE]"
MEDIA = {"image": "[IMG]", "audio": "[AUD]", "document": "[DOC]"}
BESIDE = "[+]"
TRAINED = "assistant"

CONTROLS = [BEGIN, *[mark for marks in TURNS.values() for mark in marks], OTHER, NAMED, OTHER_END, *MEDIA.values(), BESIDE]
PARTS = "array<struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"

#: Tokens that media expand to: a square of ``PATCH`` pixels, a second of sound, a page.
PATCH, SECOND_TOKENS, PAGE_TOKENS = 16, 12.5, 256


def _rest(start: str) -> str:
    """What stands behind the first sign of the control strings with this one, as a pattern."""
    return f"(?:{'|'.join(re.escape(c[1:]) for c in CONTROLS if c[0] == start)})"


_ESCAPE = "|".join(rf"(?<={re.escape(start)})(?=\\*{_rest(start)})" for start in "[<")
_UNESCAPE = "|".join(rf"(?<={re.escape(start)})\\(?=\\*{_rest(start)})" for start in "[<")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "")


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    empty = F.lit(None)
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.alias("text"), empty.cast("string").alias("uri"), empty.cast("int").alias("width"), empty.cast("int").alias("height"),
        empty.cast("double").alias("seconds"), empty.cast("int").alias("pages")))


def expanded_tokens(part: Column) -> Column:
    """Tokens that a media part stands for; at least the one of its placeholder."""
    patches = lambda c: F.ceil(part[c] / PATCH)
    size = (F.when(part["kind"] == "image", patches("width") * patches("height"))
            .when(part["kind"] == "audio", F.ceil(part["seconds"] * SECOND_TOKENS))
            .when(part["kind"] == "document", part["pages"].cast("long") * PAGE_TOKENS))
    return F.greatest(F.coalesce(size, F.lit(1)), F.lit(1)).cast("long")


def _is_media(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(list(MEDIA)), F.lit(False))


def visit(parts: Column, trained: Column) -> tuple[Column, Column]:
    """The segments (text, and whether it is under the loss mask) and the attachments of a list of parts, in order."""
    given = F.coalesce(parts, F.array().cast(PARTS))

    def segment(part: Column, i: Column) -> Column:
        placeholder = F.coalesce(*[F.when(part["kind"] == kind, F.lit(mark)) for kind, mark in MEDIA.items()])
        follows = (i > 0) & ~_is_media(F.get(given, i - 1))
        mark = F.when(_is_media(part), placeholder).when(follows, F.lit(BESIDE)).otherwise(F.lit(""))
        said = F.when(_is_media(part), F.lit("")).otherwise(escape(F.coalesce(part["text"], F.lit(""))))
        return F.array(_segment(mark, F.lit(False)), _segment(said, trained))

    segments = F.filter(F.flatten(F.transform(given, segment)), lambda s: s["text"] != "")
    media = F.transform(F.filter(given, _is_media), lambda p: F.struct(
        p["kind"].alias("kind"), p["uri"].alias("uri"), expanded_tokens(p).alias("n_tokens")))
    return segments, media


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _marks(role: Column) -> tuple[Column, Column]:
    """What opens and closes a message of this role."""
    opened = F.coalesce(*[F.when(role == name, F.lit(start)) for name, (start, _) in TURNS.items()], F.concat(F.lit(OTHER), escape(role), F.lit(NAMED)))
    return opened, F.coalesce(*[F.when(role == name, F.lit(end)) for name, (_, end) in TURNS.items()], F.lit(OTHER_END))


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row per conversation of ``messages(conv_id, turn, role, parts)``.

    ``segments`` are the pieces of ``formatted`` in order, each with ``loss``; ``attachments`` has ``message`` (from 0),
    ``kind``, ``uri`` and ``n_tokens`` in the order of the placeholders; ``n_expanded`` is the sum of these tokens.
    """
    role = F.coalesce("role", F.lit(""))
    opened, closed = _marks(role)
    segments, media = visit(F.col("parts"), role == TRAINED)
    around = lambda mark: F.array(_segment(mark, F.lit(False)))
    said = messages.select("conv_id", F.struct(
        "turn", role.alias("role"), F.concat(around(opened), segments, around(closed)).alias("segments"), media.alias("media")).alias("message"))
    told = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("message")).alias("messages"))
    attachments = F.flatten(F.transform("messages", lambda m, i: F.transform(m["media"], lambda a: F.struct(
        i.cast("long").alias("message"), a["kind"].alias("kind"), a["uri"].alias("uri"), a["n_tokens"].alias("n_tokens")))))
    whole = F.concat(around(F.lit(BEGIN)), F.flatten(F.transform("messages", lambda m: m["segments"])))
    laid = told.select("conv_id", whole.alias("segments"), attachments.alias("attachments"))
    return laid.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]).alias("n_expanded"))


def _any_of(marks: list[str]) -> str:
    return "|".join(map(re.escape, marks))


def read_turns(formatted: Column) -> Column:
    """The messages of a formatted conversation: ``role``, ``text`` (its text parts, joined) and ``media`` (kinds, in order)."""
    ends = [end for _, end in TURNS.values()] + [OTHER_END]
    bodies = F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), _any_of(ends))
    between = _any_of([*MEDIA.values(), BESIDE])

    def read(body: Column) -> Column:
        role = F.coalesce(
            *[F.when(F.startswith(body, F.lit(start)), F.lit(name)) for name, (start, _) in TURNS.items()],
            unescape(F.substr(F.substring_index(body, NAMED, 1), F.lit(len(OTHER) + 1))))
        opened = F.coalesce(
            *[F.when(F.startswith(body, F.lit(start)), F.lit(len(start))) for start, _ in TURNS.values()],
            F.length(F.substring_index(body, NAMED, 1)) + len(NAMED))
        content = F.substr(body, opened + 1)
        text = F.array_join(F.transform(F.split(content, between), unescape), "")
        media = F.transform(F.regexp_extract_all(content, F.lit(_any_of(list(MEDIA.values()))), F.lit(0)), lambda mark: F.coalesce(
            *[F.when(mark == F.lit(sign), F.lit(kind)) for kind, sign in MEDIA.items()]))
        return F.struct(role.alias("role"), text.alias("text"), media.alias("media"))

    return let(bodies, lambda b: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), read))


def trained_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


# The conversation that the contract adds.
PROBE_ID, PROBE = -1, "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    told = format_conversations(given.unionByName(probe).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts")))
    read = told.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), trained_text(F.col("segments")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


_SQL_ENDS = " ".join(f"WHEN '{name}' THEN {len(start) + len(end)}" for name, (start, end) in TURNS.items())
_SQL_CONTROL = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS)

OP11_SQL = rf"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE}'),
sized AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '{_SQL_CONTROL}')) + CASE role {_SQL_ENDS}
        ELSE {len(OTHER + NAMED + OTHER_END)} + length(role) + len(regexp_extract_all(role, '{_SQL_CONTROL}')) END AS chars
    FROM rows),
told AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = '{TRAINED}'), '') AS loss, sum(chars)::BIGINT + {len(BEGIN)} AS formatted_chars
    FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM told
"""
