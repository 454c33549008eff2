"""Hoisting of sentences that many segments share.

Segments are ``segment_id, record_type, record_id, sentences``. A key that occurs in
most segments is counted with partial sums per task, and the join back to the
sentences is left to AQE, which splits a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia import params as P
from evidentia.functions.bounds import top_n, unroll
from evidentia.functions.text import sentence_key


def sentence_rows(segments: DataFrame) -> DataFrame:
    rows = unroll(segments, ["segment_id", "record_type", "record_id"], "sentences", "sentence", "pos")
    return rows.withColumn("key", sentence_key(F.col("sentence")))


def shared_keys(segments: DataFrame, min_chars: int = P.BOILERPLATE_KEY, min_segments: int = P.BOILERPLATE_SEGMENTS) -> DataFrame:
    """(key, n_segments). Repeats inside a segment are folded in its own row, so no distinct shuffle is needed."""
    keys = F.array_distinct(F.transform("sentences", sentence_key))
    once = unroll(segments, [], F.filter(keys, lambda k: F.length(k) >= min_chars), "key")
    return once.groupBy("key").agg(F.count("*").alias("n_segments")).where(F.col("n_segments") >= min_segments)


def mark_shared(segments: DataFrame, **limits) -> DataFrame:
    """Sentence rows with ``removed``: shared and not the opening sentence."""
    shared = shared_keys(segments, **limits)
    rows = sentence_rows(segments).join(shared, "key", "left")
    return rows.withColumn("removed", (F.col("pos") > 0) & F.col("n_segments").isNotNull())


def clean_segments(marked: DataFrame) -> DataFrame:
    """Segments with the kept sentences in order; grouped per segment, which was one row before."""
    kept = F.array_sort(F.collect_list(F.when(~F.col("removed"), F.struct("pos", "sentence"))))
    return marked.groupBy("segment_id").agg(
        F.transform(kept, lambda s: s["sentence"]).alias("sentences"), F.count_if("removed").alias("removed"))


def shared_sentences(marked: DataFrame) -> DataFrame:
    """Each hoisted sentence once per record type, at the segment and place where it first appeared."""
    at = F.struct("segment_id", "pos")
    rows = marked.where("removed").groupBy("record_type", "key").agg(
        F.min(at).alias("first"), F.min_by("sentence", at).alias("sentence"), F.max("n_segments").alias("n_segments"))
    return rows.select("record_type", "key", "sentence", "n_segments",
                       F.col("first.segment_id").alias("first_segment"), F.col("first.pos").alias("first_pos"))


def applies_to(marked: DataFrame) -> DataFrame:
    """(record_type, record_id) pairs a shared block applies to, as rows: the list has no bound."""
    return marked.where(F.col("removed") & F.col("record_id").isNotNull()).select("record_type", "record_id").distinct()


def shared_headers(pairs: DataFrame, named: int = 6) -> DataFrame:
    """Header per record type: how many records share the text, and the first six by ID."""
    totals = pairs.groupBy("record_type").agg(F.count("*").alias("n"))
    first = top_n(pairs, ["record_type"], [F.asc("record_id")], named)
    lists = first.groupBy("record_type").agg(F.array_join(F.array_sort(F.collect_list("record_id")), ", ").alias("ids"))
    more = F.when(F.col("n") > named, F.lit(", …")).otherwise(F.lit(""))
    label = F.concat(F.lit("Shared protocol — "), F.translate("record_type", "_", " "), F.lit(" records"))
    return totals.join(lists, "record_type").select(
        "record_type", F.col("n").alias("n_records"),
        F.concat(label, F.lit("\nThis text is shared verbatim across "), F.col("n").cast("string"), F.lit(" records ("), "ids", more,
                 F.lit("). It is stored once to keep individual records distinctive.")).alias("header"))


def shared_chunks(marked: DataFrame) -> DataFrame:
    """Shared text as chunks: the sentences that first appeared in one segment, under the header of their type."""
    blocks = shared_sentences(marked).groupBy("record_type", "first_segment").agg(
        F.expr("listagg(sentence, ' ') within group (order by first_pos)").alias("body"), F.count("*").alias("n_sentences"))
    headers = shared_headers(applies_to(marked))
    return blocks.join(headers, "record_type").select(
        F.concat(F.lit("shared-"), "record_type", F.lit("-"), F.col("first_segment").cast("string")).alias("chunk_id"),
        "record_type", "n_sentences", F.concat("header", F.lit("\n"), "body").alias("content"))


def chunking_statistics(segments: DataFrame, marked: DataFrame) -> Column:
    """Segments, sentences, hoisted sentences and shared sentences as one row."""
    return marked.agg(
        F.count_distinct("segment_id").alias("segments"), F.count("*").alias("sentences"),
        F.count_if("removed").alias("hoisted"), F.count_distinct(F.when(F.col("removed"), F.col("key"))).alias("shared"))
