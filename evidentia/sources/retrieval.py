"""The stored retrieval index: postings, term statistics and vectors, built once and searched by any number of questions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia import params as P
from evidentia.operators import dense, lexical


@dataclass(frozen=True)
class RetrievalIndex:
    """Tables of an index.

    ``postings`` (chunk_id, term, tf, len, label) unfolds rows of a chunk each, which are bucketed by chunk, so the scores of a
    chunk are summed up where its postings lie and only each task's best rows move; ``counts`` (term, df, total_len) has a row
    with an empty term for the corpus itself; ``vectors`` has chunk_id, vector and label. ``table`` is the catalog's name for the
    postings, which ``close_index`` drops. An index of one arm alone lacks the tables of the other.
    """

    postings: DataFrame | None
    counts: DataFrame | None
    vectors: DataFrame | None
    table: str = ""


def _postings_table(spark: SparkSession, path: str, kind: str, buckets: int, facets: list[str]) -> str:
    """Name of a table over the postings below ``path``; only a table tells Spark how its files are bucketed."""
    name = f"evidentia_postings_{uuid.uuid4().hex[:12]}"
    columns = "".join(f", {c} STRING" for c in ["label", *facets])
    location = f"{path}/postings".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} (chunk_id {kind}, len INT, terms ARRAY<STRING>, tfs ARRAY<BIGINT>{columns}) USING parquet "
        f"CLUSTERED BY (chunk_id) INTO {buckets} BUCKETS LOCATION '{location}'")
    return name


def close_index(index: RetrievalIndex) -> None:
    """Forget the table that an index put into the catalog; its files stay."""
    if index.table:
        index.counts.sparkSession.sql(f"DROP TABLE IF EXISTS {index.table}")


def _named(chunks: DataFrame, label: str | None, facets: list[str]) -> DataFrame:
    given = [F.col(c).cast("string").alias(c) for c in facets]
    return chunks.select("chunk_id", "text", (F.col(label) if label else F.lit(None).cast("string")).alias("label"), *given)


def build_lexical(chunks: DataFrame, path: str, label: str | None = None, buckets: int | None = None, facets: list[str] | None = None) -> RetrievalIndex:
    """The tables of ``build_index`` that lexical search reads."""
    facets = facets or []
    spark = chunks.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    name = _postings_table(spark, path, kind, n, facets)
    rows = lexical.counted(_named(chunks, label, facets), {c: c for c in ["label", *facets]})
    rows.repartition(n, "chunk_id").select("chunk_id", "len", "terms", "tfs", "label", *facets).write.insertInto(name)
    spark.catalog.refreshTable(name)
    postings = lexical.unfolded(spark.table(name))
    lexical.term_counts(postings).write.parquet(f"{path}/counts")
    spark.createDataFrame([(n, kind, facets)], "buckets int, kind string, facets array<string>").coalesce(1).write.parquet(f"{path}/layout")
    return RetrievalIndex(postings, spark.read.parquet(f"{path}/counts"), None, name)


def build_dense(chunks: DataFrame, path: str, label: str | None = None, facets: list[str] | None = None) -> RetrievalIndex:
    """The table of ``build_index`` that dense search reads."""
    facets = facets or []
    dense.embed(_named(chunks, label, facets)).select("chunk_id", "vector", "label", *facets).write.parquet(f"{path}/vectors")
    return RetrievalIndex(None, None, chunks.sparkSession.read.parquet(f"{path}/vectors"))


def build_index(chunks: DataFrame, path: str, label: str | None = None, buckets: int | None = None, facets: list[str] | None = None) -> RetrievalIndex:
    """Tokenise and embed ``chunks(chunk_id, text[, label])`` once and write the tables of an index below ``path``.

    ``chunk_id`` is a key. ``buckets`` should give buckets of a few hundred MB; the default is the session's number of shuffle
    partitions. ``facets`` are further columns of a chunk that questions may filter by (``params.FILTERS``).
    """
    words = build_lexical(chunks, path, label, buckets, facets)
    return replace(words, vectors=build_dense(chunks, path, label, facets).vectors)


def open_index(spark: SparkSession, path: str) -> RetrievalIndex:
    """An index that another session has built."""
    buckets, kind, facets = spark.read.parquet(f"{path}/layout").first()
    name = _postings_table(spark, path, kind, buckets, facets)
    return RetrievalIndex(lexical.unfolded(spark.table(name)), spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/vectors"), name)


def _filters(queries: DataFrame, filtered: bool) -> list[str]:
    return [c for c in P.FILTERS if filtered and c in queries.columns]


def search_lexical(index: RetrievalIndex, queries: DataFrame, k: int, filtered: bool = False) -> DataFrame:
    """Best ``k`` chunks per question by BM25, from the stored postings and statistics."""
    asked = lexical.query_terms(queries.select("query_id", "question", *_filters(queries, filtered)))
    scored = lexical.bm25(index.postings, asked, counts=index.counts)
    return lexical.best(scored, k)


def search_dense(index: RetrievalIndex, queries: DataFrame, k: int, filtered: bool = False) -> DataFrame:
    """Best ``k`` chunks per question by cosine, from the stored vectors; only questions are embedded."""
    asked = dense.embed(queries.select("query_id", "question", *_filters(queries, filtered)), "question").drop("question")
    return dense.nearest(index.vectors, asked, k, label="label")
