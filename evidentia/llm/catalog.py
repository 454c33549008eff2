"""Queries of this package and their DuckDB checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from evidentia.llm import chat, chunks, decontaminate, licences, markup, periods, phrases, pieces, quality, revisits, simhash, suffixes, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array": suffixes.op1_suffix_array,
    "op2_revisit_resolution": revisits.op2_revisit_resolution,
    "op3_url_filters": urls.op3_url_filters,
    "op4_substring_dedup": chunks.op4_substring_dedup,
    "op5_html_extraction": markup.op5_html_extraction,
    "op6_license_scan": licences.op6_license_scan,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_simhash": simhash.op10_simhash,
    "op11_chat_format": chat.op11_chat_format,
    "op12_collocations": phrases.op12_collocations,
    "op13_periodic_runs": periods.op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}
CHECKS: dict[str, str] = {
    "op1_suffix_array": suffixes.OP1_SQL,
    "op2_revisit_resolution": revisits.OP2_SQL,
    "op3_url_filters": urls.OP3_SQL,
    "op11_chat_format": chat.OP11_SQL,
    "op12_collocations": phrases.OP12_SQL,
}
