"""Small tables with the cases that every operator must stand."""

from pyspark.sql import functions as F

LONG = "word " * 40_000


def documents(spark, rows, extra=()):
    """``rows`` of ID and text, with further columns that bear names operators use inside."""
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    df = df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")})
    return df.withColumns({name: F.lit(1) for name in extra}).repartition(3)


def odd(rows):
    """Rows with a NULL text, an empty one, one of white space, NULL IDs and a repeated row beside the given ones."""
    return [*rows, (9001, None), (9002, ""), (9003, " \t\n"), (None, "text without an id"), (None, None), *rows[:1]]


CLASHING = (
    "core", "place", "fp", "quality", "__hashes", "__pairs", "__parts", "__ratios", "__words", "__matches", "__cuts", "__id", "cuts",
    "high", "low", "start", "part", "cell", "component_id", "licences", "n_words", "word", "count", "ids")
