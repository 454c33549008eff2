"""Text expressions: all return Columns and run inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia import params as P


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, phrases: list[str]) -> Column:
    """One alternation instead of a chain of tests, so that generated methods stay small enough to be compiled.

    It is tried only where a phrase's first character stands.
    """
    escape = lambda p: re.sub(r"([.*+?()\[\]{}|^$&\\-])", r"\\\1", p)
    return text.rlike("(?=[" + "".join(escape(c) for c in sorted({p[0] for p in phrases})) + "])(?:" + "|".join(map(escape, phrases)) + ")")


def trim_edges(text: Column) -> Column:
    """``strip`` without a pattern: blanks, tabs and line ends at both ends go."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def fold(text: Column) -> Column:
    """Collapse runs of blanks to one and trim."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column) -> Column:
    """Trim blanks and line ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def non_empty(text: Column) -> Column:
    """NULL for an empty string."""
    return F.nullif(text, F.lit(""))


def group(text: Column, pattern: str, idx: int) -> Column:
    """A regex group, NULL where the pattern does not occur."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, idx))


def find_all(text: Column, pattern: str, idx: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(idx))


def citation_markers(text: Column) -> Column:
    return find_all(text, P.CITATION)


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 60)


def lines_of(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def excerpt(text: Column, limit: int = 320) -> Column:
    """Body text without heading and bracket lines, one line, cut at ``limit``."""
    body = F.filter(lines_of(text), lambda ln: ~F.ltrim(ln).rlike(r"^[#\[]"))
    flat = fold(F.array_join(body, "\n"))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def body_without_headings(text: Column) -> Column:
    return F.trim(F.array_join(F.filter(lines_of(text), lambda ln: ~F.ltrim(ln).startswith("#")), "\n"))


def reflow(lines: Column) -> Column:
    """Join wrapped lines, repair a hyphen at the break, fold blanks, cut into sentences."""
    joined = F.regexp_replace(F.array_join(lines, " "), r"(\w)-\s+(\w)", "$1$2")
    joined = F.trim(F.regexp_replace(joined, r"\s{2,}", " "))
    parts = find_all(joined, r"([^.!?]+[.!?]+(?:\s|$)|[^.!?]+$)")
    # A text of nothing but end marks is one sentence.
    whole = F.when((F.size(parts) == 0) & (joined != ""), F.array(joined)).otherwise(parts)
    return F.filter(F.transform(whole, lambda s: F.trim(s)), lambda s: s != "")


def sentence_key(sentence: Column) -> Column:
    kept = F.regexp_replace(F.lower(sentence), "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def cleaned_words(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", " ")
    return F.filter(F.split(spaced, r"\s+"), lambda w: w != "")


def _stems(part: Column) -> Column:
    plural = (F.length(part) > 4) & part.endswith("s") & ~part.endswith("ss")
    gerund = (F.length(part) > 5) & part.endswith("ing")
    cut = lambda n: part.substr(F.lit(1), F.length(part) - n)
    return (
        F.when(plural, F.array(part, cut(1)))
        .when(gerund, F.array(part, cut(3)))
        .otherwise(F.array(part))
    )


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Search tokens: identifiers whole and in parts, other words with their stems added."""
    stop = P.STOP_WORDS if stop_words is None else stop_words

    def keep(part: Column) -> Column:
        return (F.length(part) >= 2) & ~part.isin(stop)

    def expand(word: Column) -> Column:
        ident = word.rlike("^[a-z]{2,3}-[0-9]{2,3}$")
        number = F.split_part(word, F.lit("-"), F.lit(2))
        return (
            F.when(ident, F.array(word, F.split_part(word, F.lit("-"), F.lit(1)), number,
                                  number.cast("int").cast("string")))
            .when(word.contains("-"),
                  F.flatten(F.transform(F.filter(F.split(word, "-"), keep), _stems)))
            .when(keep(word), _stems(word))
            .otherwise(F.array().cast("array<string>"))
        )

    return F.flatten(F.transform(cleaned_words(text), expand))


def linearise_row(columns: list[str], sep: str = " · ") -> Column:
    """``name: value`` for every non-blank cell."""
    cells = [F.when(F.trim(F.col(c)) != "", F.concat(F.lit(f"{c.strip()}: "), F.trim(F.col(c)))) for c in columns]
    return F.concat_ws(sep, *cells)


def numbered_row(number: Column, columns: list[str]) -> Column:
    """``Row n — name: value; name: value`` with blanks kept."""
    cells = [F.concat(F.lit(f"{c}: "), F.coalesce(F.trim(F.col(c)), F.lit(""))) for c in columns]
    return F.concat(F.lit("Row "), number.cast("string"), F.lit(" — "), F.concat_ws("; ", *cells))


def pack(pieces: Column, limit: int, overlap: int, joiner: str, word_edge: bool = False) -> Column:
    """Greedy packing of ordered pieces into windows of at most ``limit`` characters.

    A piece longer than the limit stays whole. Each new window opens with the last
    ``overlap`` characters of the one before; with ``word_edge`` the overlap starts
    after its first blank.
    """
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))
    gap = len(joiner)

    def step(acc: Column, piece: Column) -> Column:
        buf = acc["buf"]
        full = (F.length(buf) > 0) & (F.length(buf) + F.length(piece) + gap > limit)
        tail = F.right(buf, F.lit(overlap)) if overlap else F.lit("")
        if word_edge:
            edge = F.instr(tail, " ")
            carried = F.when(edge == 0, F.lit("")).otherwise(
                F.concat(tail.substr(edge + 1, F.length(tail)), F.lit(joiner)))
            grown = F.concat(buf, piece, F.lit(joiner))
            fresh = F.concat(carried, piece, F.lit(joiner))
        else:
            grown = F.when(F.length(buf) > 0, F.concat(buf, F.lit(joiner), piece)).otherwise(piece)
            fresh = F.concat(tail, F.lit(joiner), piece) if overlap else piece
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(strip(buf)))).otherwise(acc["done"]).alias("done"),
            F.when(full, fresh).otherwise(grown).alias("buf"),
        )

    def finish(acc: Column) -> Column:
        last = strip(acc["buf"])
        return F.when(last != "", F.concat(acc["done"], F.array(last))).otherwise(acc["done"])

    return F.aggregate(pieces, state, step, finish)


def pack_paragraphs(text: Column, limit: int = P.WINDOW_CHARS, overlap: int = P.WINDOW_OVERLAP,
                    paragraph: str = "\n\n") -> Column:
    """Windows on paragraph bounds; a text within the limit is one window."""
    paragraphs = F.filter(F.split(text, paragraph), lambda p: p.rlike(r"\S"))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(pack(paragraphs, limit, overlap, paragraph))


def pack_sentences(sentences: Column, limit: int = P.BODY_CHARS, overlap: int = P.BODY_OVERLAP) -> Column:
    return pack(sentences, limit, overlap, " ", word_edge=True)


def date_present(day: Column, text: Column) -> Column:
    """Does the text carry an ISO day in that form, slashed, or as day and month name beside the year?"""
    parsed = F.try_to_date(day, "yyyy-MM-dd")
    number = F.dayofmonth(parsed).cast("string")
    year = F.substring(day, 1, 4)
    month = F.concat(F.lit("(?:"), F.date_format(parsed, "MMMM"), F.lit("|"), F.date_format(parsed, "MMM"), F.lit(")"))
    near = F.concat(F.lit(r"(?i)\b"), number, F.lit(r"\s+"), month, F.lit(r"\b|\b"), month, F.lit(r"\s+"), number, F.lit(r"\b"))
    slashed = F.concat(F.lit(r"\b"), F.regexp_replace(day, "-", "[-/]"), F.lit(r"\b"))
    iso = day.rlike(rf"^{P.ISO_DATE}$") & parsed.isNotNull()
    return F.coalesce(
        F.contains(text, day)
        | (iso & F.contains(text, year) & F.regexp_like(text, near))
        | (iso & F.regexp_like(text, slashed)),
        F.lit(False),
    )
