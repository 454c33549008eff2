"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import stage


def _directed(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _star(edges: DataFrame) -> DataFrame:
    """One round: every larger neighbour is hung on the smallest one, then every node on the smallest below it.

    Minima are summed up per task before they move and are joined back, so a node with very many neighbours is neither
    collected nor handled by one task.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _directed(small.union(least.select("u", F.col("m").alias("v"))))


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of ``edges(u, v)`` but the roots.

    Rounds go on until nothing changes; their number grows with the logarithm of the longest path. Each round is
    written to the shared folder, and only a count and a checksum reach the driver.
    """
    now, before = stage(_directed(edges), "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now, before = stage(_star(now), "edges"), mark
