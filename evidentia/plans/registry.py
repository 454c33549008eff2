"""Query registry: a Spark plan and, where SQL can state it, its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.plans.inputs import check_sql, load

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
_CHECKS: dict[str, str] = {}
SHARED: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Widen integers and floats so both engines report the same types."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register ``fn(t)``; ``t(table)`` loads a driver table or a rendered input."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(lambda table: load(spark, sf_dir, table)))
        if sql is not None:
            _CHECKS[name] = sql
        return fn

    return add


def shared(name: str, sql: str) -> None:
    """A CTE that several checks use."""
    SHARED[name] = sql


def checks() -> dict[str, str]:
    return {k: check_sql(v, SHARED) for k, v in _CHECKS.items()}
