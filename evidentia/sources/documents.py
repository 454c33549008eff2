"""Readers: whole documents, CSV rows, pages and encoded payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.bounds import unroll
from evidentia import params as P
from evidentia.functions import text as X
from evidentia.functions.labels import lookup
from evidentia.functions.scan import number_rows


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; bytes that are not UTF-8 are replaced."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.col("path").alias("doc_id"), name.alias("doc_name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, doubled quotes inside quoted fields, every column as text."""
    return spark.read.csv(path, header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def csv_texts(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """One self-describing text per row, blank cells and blank rows left out."""
    return rows.select(*keys, X.linearise_row(columns).alias("text")).where("text <> ''")


def csv_pages(rows: DataFrame, key: str, order: str, columns: list[str], per_page: int = P.CSV_ROWS_PER_PAGE) -> DataFrame:
    """Numbered rows with blanks kept, and the page of 25 that each belongs to."""
    numbered = number_rows(rows, key, order, "row_no")
    return numbered.select(
        key, "row_no", F.ceil(F.col("row_no") / per_page).cast("bigint").alias("page"), X.numbered_row(F.col("row_no"), columns).alias("text"))


def text_pages(docs: DataFrame, keys: list[str], paragraph: str = "\n{2,}", joiner: str = "\n\n", limit: int = P.PAGE_CHARS) -> DataFrame:
    """Plain text cut into pages on paragraph bounds."""
    paragraphs = F.split(F.col("text"), paragraph)
    pages = X.pack(paragraphs, limit + len(joiner), 0, joiner)
    return unroll(docs, [*keys], F.when(F.size(pages) > 0, pages).otherwise(F.array("text")), "text", "page").withColumn(
        "page", F.col("page") + 1)


def decode_payload(payload: Column) -> Column:
    """Text of a base64 payload; NULL where it does not decode."""
    return F.make_valid_utf8(F.try_to_binary(payload, F.lit("base64")).cast("string"))


def decoded(rows: DataFrame, payload: str) -> DataFrame:
    out = rows.withColumn("text", decode_payload(F.col(payload)))
    return out.withColumn("status", F.when(F.col("text").isNull(), F.lit("failed")).otherwise(F.lit("decoded")))


def content_kind(name: Column, content_type: Column) -> Column:
    """Kind by declared type, then by extension; NULL when neither is supported."""
    extension = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1)))
    return F.coalesce(lookup(content_type, P.CONTENT_KINDS), lookup(extension, P.EXTENSION_KINDS))
