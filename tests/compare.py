"""Run registered queries beside their DuckDB checks. Usage: python tests/compare.py SF [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from evidentia.plans.inputs import TABLES  # noqa: E402

DATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def difference(spark, con, name: str, plan, sql: str, sf: str) -> str | None:
    """None when equal, else a short description."""
    df = plan(spark, f"{DATA}/sf{sf}")
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    idx = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in idx) for r in res.fetchall()]
    a, b = Counter(got), Counter(want)
    if a == b:
        return None if got else "both empty"
    x, y = list((a - b).elements()), list((b - a).elements())
    return f"rows {len(got)} vs {len(want)}; only spark {len(x)}: {sorted(x)[:2]}; only check {len(y)}: {sorted(y)[:2]} cols {cols}"


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("evidentia-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    from evidentia.plans import catalog

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark, con, sqls = session(), connect(sf), catalog.checks()
    bad = 0
    for name, plan in catalog.QUERIES.items():
        if wanted and not any(name == w or name.startswith(w + "_") or name.startswith(w) and w.endswith("_") for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                out = difference(spark, con, name, plan, sqls[name], sf)
            else:
                out = None if plan(spark, f"{DATA}/sf{sf}").count() else "no rows"
        except Exception as e:  # report and go on
            out = f"{type(e).__name__}: {str(e)[:700]}"
        bad += out is not None
        print(f"{'ok  ' if out is None else 'FAIL'} {name} {time.time() - start:.1f}s {'' if name in sqls else '(rows only) '}{out or ''}", flush=True)
    print("failures:", bad)
