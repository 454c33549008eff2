"""Training-data pipeline over ``documents``: quality, near-duplicates, repeated passages, benchmark leaks, token IDs.

Each stage works on all rows the one before it kept and returns the columns of ``documents``; the last one returns the
tokens. ``run`` writes each stage to the cluster's shared folder and reads it back, so a lost executor costs one stage.

Defined results: NULL and empty texts fail the quality rules; rows without a ``doc_id`` that pass them are kept by the
near-duplicate stage, which cannot name them; an empty table gives an empty result; further columns of the input, whatever
their names, are carried through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import stage, table
from evidentia.llm.decontaminate import drop_contaminated
from evidentia.llm.pieces import encode_documents
from evidentia.llm.quality import keep_good
from evidentia.llm.simhash import one_row_of_each
from evidentia.llm.similar import one_of_similar
from evidentia.llm.suffixes import cut_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and read like the ones labelled good."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest ID.

    First SimHash, as in op10: fingerprints within its radius link documents. Among those left, the ones that have 0.8 of
    their five-word shingles in common, most of which lie beyond that radius.
    """
    return one_of_similar(stage(one_row_of_each(docs), "simhash"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand in an earlier place of the corpus."""
    return cut_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token IDs of every document, and whether they decode to its text."""
    return encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: The stages hash, sort suffixes and merge pieces, which SQL cannot state; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
