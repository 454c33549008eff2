"""Size checks and ranking shapes shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Count a side before hinting its broadcast; a larger one is left to AQE's shuffle joins."""
    return df.limit(max_rows + 1).count() <= max_rows


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """Best ``n`` rows per key. The rank filter lets Spark cut each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_n(df, keys, order, 1, "__first").drop("__first")


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a scan that has fewer splits than the session has cores; larger inputs pass unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def unroll(df: DataFrame, keep: list, array: Column | str, value: str, pos: str | None = None) -> DataFrame:
    """One row per array element, with its place if asked for.

    A plain explode makes the optimizer test the array's size in a filter below it,
    which repeats the array expression; the outer form with a filter on the place
    evaluates it once.
    """
    place = pos or "__pos"
    rows = df.select(*keep, F.posexplode_outer(array).alias(place, value)).where(F.col(place).isNotNull())
    return rows if pos else rows.drop(place)


def spread_by(df: DataFrame, *keys: str, least: int = 0) -> DataFrame:
    """Place derived rows that are small but costly to work on, in ``least`` tasks or more; AQE judges by bytes and would put them into few."""
    spark = df.sparkSession
    wide = max(least, 2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(wide, *keys)
