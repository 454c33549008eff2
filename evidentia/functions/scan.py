"""Ordered carry-forward that does not put a whole document into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BLOCK = "__block"


def place_blocks(df: DataFrame, key: str, order: str, block_rows: int = 65536) -> DataFrame:
    """Place rows by key and block of the order column. Costly per-row marks belong after this shuffle."""
    return df.withColumn(BLOCK, F.floor(F.col(order) / block_rows)).repartition(key, BLOCK)


def carry_forward(df: DataFrame, key: str, order: str, columns: list[str], block_rows: int = 65536) -> DataFrame:
    """Fill each column with its last non-NULL value at or before the row, per key.

    Rows are scanned in blocks of the order column. Each block is summarised to one
    row (its last values), the summaries are scanned per key, and the carry joins
    back, so a key holding a large share of all rows is spread over many tasks. Rows
    that ``place_blocks`` has placed are not shuffled again.
    """
    blocked = df if BLOCK in df.columns else df.withColumn(BLOCK, F.floor(F.col(order) / block_rows))
    inside = Window.partitionBy(key, BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.select("*", *[F.last(c, ignorenulls=True).over(inside).alias(f"__l_{c}") for c in columns])
    ends = blocked.groupBy(key, BLOCK).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__e_{c}") for c in columns])
    before = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, BLOCK, *[F.last(f"__e_{c}", ignorenulls=True).over(before).alias(f"__c_{c}") for c in columns])
    joined = local.join(carried, [key, BLOCK], "left")
    plain = [c for c in df.columns if c not in columns and c != BLOCK]
    return joined.select(*plain, *[F.coalesce(f"__l_{c}", f"__c_{c}").alias(c) for c in columns])


def row_blocks(df: DataFrame, order: str, blocks: int | None = None) -> Column:
    """Block number of each row: ranges of ``order`` that hold about equally many rows, however sparse its values are.

    The bounds are quantiles over all rows, one number a block; computed once, so every use of the column agrees.
    """
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else None
    bounds = df.agg(F.percentile_approx(order, shares, 10_000)).first()[0] if n > 1 else None
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b < F.col(order)))


def number_rows(df: DataFrame, key: str, order: str, out: str = "n", blocks: int | None = None) -> DataFrame:
    """1-based row number per key along an ordered column, block by block (see ``row_blocks``)."""
    block = "__block"
    blocked = df.withColumn(block, row_blocks(df, order, blocks))
    inside = Window.partitionBy(key, block).orderBy(order)
    local = blocked.withColumn("__n", F.row_number().over(inside))
    ends = blocked.groupBy(key, block).agg(F.count("*").alias("__size"))
    before = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(key, block, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    joined = local.join(offsets, [key, block])
    return joined.select(*df.columns, (F.col("__n") + F.col("__offset")).alias(out))


def previous_value(df: DataFrame, key: str, order: str, column: str, out: str, blocks: int | None = None) -> DataFrame:
    """Value of ``column`` in the row before, per key, block by block (see ``row_blocks``).

    Rows that share a place stand in the order of ``column``, so the result does not depend on how rows are read.
    """
    block = "__block"
    blocked = df.withColumn(block, row_blocks(df, order, blocks))
    inside = Window.partitionBy(key, block).orderBy(order, column)
    local = blocked.withColumn("__lag", F.lag(column).over(inside)).withColumn("__n", F.row_number().over(inside))
    ends = blocked.groupBy(key, block).agg(F.max_by(F.col(column), F.struct(order, column)).alias("__end"))
    before = F.lag("__end").over(Window.partitionBy(key).orderBy(block))
    heads = ends.select(key, block, before.alias("__carry"))
    joined = local.join(heads, [key, block])
    value = F.when(F.col("__n") == 1, F.col("__carry")).otherwise(F.col("__lag"))
    return joined.select(*df.columns, value.alias(out))
