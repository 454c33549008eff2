"""URL filters: host suffixes and path prefixes looked up by short hash prefixes, then confirmed by full digests.

A rule is a host and a path; it fits the host and all its subdomains if the path of the URL starts with the rule's.
Each distinct URL is expanded into the expressions a rule could equal: only host suffixes with as many labels, and path
prefixes as long, as some rule has. The expressions are joined to the rules on the first ``PREFIX`` hex digits of their
digests, candidates are confirmed by the whole digest, and the longest rule wins (of two equally long ones the one that
blocks). Verdicts are joined back by URL, so a URL that a third of all rows share is judged once.

Defined results: a NULL URL or one without ``://`` has an empty host and path, no rule and the default verdict; rows that
repeat are judged alike; an empty rule table leaves the default verdict everywhere; rules with a NULL part are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.bounds import is_small
from evidentia.llm.common import fresh, lower_ascii, table

PREFIX = 8
DEFAULT = "allow"
#: host, path, verdict
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
LOCATION = "(?s)^.*?://([^/?#]*)([^?#]*)"


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, LOCATION, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, LOCATION, 2), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Every host suffix of one of the label counts, joined to every path prefix of one of the lengths."""
    parts = F.split(host, "\\.")
    count = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<int>")
    suffixes = F.transform(
        F.filter(count(labels), lambda n: n <= F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.transform(
        F.filter(count(lengths), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def match_rules(urls: DataFrame, rules: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """Rule and verdict of each distinct ``url`` that some rule fits."""
    known = rules.dropna(subset=["host", "path", "verdict"]).select(
        F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict"),
        F.size(F.split("host", "\\.")).alias("labels"), F.length("path").alias("length"))
    # The shapes of rules are few however many rules there are: labels of a host times lengths of a path.
    shapes = known.agg(F.sort_array(F.collect_set("labels")), F.sort_array(F.collect_set("length"))).first()
    lookup = known.groupBy("rule").agg(F.max("rule_verdict").alias("rule_verdict")).select(
        "rule", "rule_verdict", _digest(F.col("rule")).alias("digest")).withColumn("short", F.left("digest", F.lit(prefix)))
    distinct = urls.where(F.col("url").isNotNull()).select("url").distinct()
    opened = distinct.select("url", F.explode(expressions(url_host(F.col("url")), url_path(F.col("url")), *shapes)).alias("expression"))
    hashed = opened.select("url", _digest(F.col("expression")).alias("full")).withColumn("short", F.left("full", F.lit(prefix)))
    near = hashed.join(F.broadcast(lookup) if is_small(lookup) else lookup, "short")
    order = F.struct(F.length("rule").alias("n"), F.col("rule_verdict").alias("v"), F.col("rule").alias("r"))
    best = near.where(F.col("full") == F.col("digest")).groupBy("url").agg(F.max(order).alias("best"))
    return best.select("url", F.col("best.r").alias("rule"), F.col("best.v").alias("rule_verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> tuple[DataFrame, str]:
    """Every row of ``pages`` with a struct column of host, path, rule and verdict; also the name of that column."""
    result, rule, verdict, key = fresh(pages, "filtered", "__rule", "__verdict", "__url")
    best = match_rules(pages, rules).select(F.col("url").alias(key), F.col("rule").alias(rule), F.col("rule_verdict").alias(verdict))
    joined = pages.join(best, pages["url"] == best[key], "left")
    judged = joined.withColumn(result, F.struct(
        url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.col(rule).alias("rule"),
        F.coalesce(F.col(verdict), F.lit(default)).alias("verdict")))
    return judged.drop(rule, verdict, key), result


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged, result = filter_urls(pages, default_rules(spark))
    return judged.select("page_id", *[f"{result}.{c}" for c in ("host", "path", "rule", "verdict")])


def _values() -> str:
    return ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)


OP3_SQL = rf"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_values()}),
parts AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN split_part(regexp_replace(substr(url, instr(url, '://') + 3), '[?#](.|\n)*$', ''), '/', 1) ELSE '' END AS raw_host,
        CASE WHEN contains(url, '://') THEN regexp_replace(substr(url, instr(url, '://') + 3), '[?#](.|\n)*$', '') ELSE '' END AS rest
    FROM pages),
located AS (
    SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(raw_host) + 1) AS path FROM parts),
keyed AS (SELECT *, row_number() OVER () AS k FROM located),
fits AS (
    SELECT k, rule_host || rule_path AS rule, rule_verdict,
        row_number() OVER (PARTITION BY k ORDER BY length(rule_host || rule_path) DESC, rule_verdict DESC) AS place
    FROM keyed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, '{DEFAULT}') AS verdict
FROM keyed LEFT JOIN (SELECT * FROM fits WHERE place = 1) f USING (k)
"""
