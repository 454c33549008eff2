"""WARC revisits: a 304 capture is resolved to the latest earlier full response of its canonical URL.

Captures are ordered by URL and time and cut into blocks of equal row counts by range partitioning, so a URL that holds a
third of all captures spans many blocks. Inside a block the last full response is carried forward by a window; one row
per URL and block carries it on to the next blocks. No capture is joined to more than one response.

The response found is checked against the capture's validators: entity tags decide if both have one (compared weakly),
else the modification dates if both have one, else the payload digests. If they agree, the capture's header fields
replace those of the response, but for the fields that describe a body or a connection, which a 304 must not change.

Defined results: a capture without URL or time, or without an earlier response, is ``unmatched``; a response at the same
time is not earlier; of two responses at one time the one with the larger ``record_id`` is the later; validators that
differ make it ``changed``, none to compare make it ``unchecked``, and neither has merged headers; names of header fields
are lower-cased, of fields that then share a name the one spelled last in order counts; rows that repeat are resolved each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm.common import lower_ascii, stage, table

#: Header fields of a 304 that do not replace those of the stored response.
KEPT_FIELDS = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
]
TRACKING = "^(utm_|fbclid=|gclid=|ref=)"
FULL = ["record_id", "etag", "last_modified", "digest", "headers"]


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without trailing slashes, sorted query without tracking."""
    bare = F.regexp_replace(url, "(?s)#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(lower_ascii(F.regexp_extract(rest, "^[^/?]*", 0)), "^www\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "(?s)^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "(?s)\\?(.*)$", 1)
    fields = F.array_sort(F.filter(F.split(query, "&"), lambda f: (f != "") & ~f.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(""))


def _named(headers: Column) -> Column:
    """Header fields with names in lower case; of fields that share one the last in order of spelling stays."""
    fields = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value")))
    return F.filter(fields, lambda e, i: ~F.exists(F.slice(fields, i + 2, F.size(fields)), lambda x: x["name"] == e["name"]))


def merged_headers(stored: Column, update: Column) -> Column:
    """Fields of the stored response, replaced and completed by the fields a 304 may change."""
    changes = F.filter(_named(F.coalesce(update, F.create_map().cast("map<string,string>"))), lambda e: ~e["name"].isin(KEPT_FIELDS))
    kept = F.filter(_named(F.coalesce(stored, F.create_map().cast("map<string,string>"))), lambda e: ~F.exists(changes, lambda x: x["name"] == e["name"]))
    return F.map_from_entries(F.array_sort(F.concat(kept, changes)))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def _verdict(full: Column) -> Column:
    both = lambda c: F.col(c).isNotNull() & full[c].isNotNull()
    agree = (
        F.when(both("etag"), _weak(F.col("etag")) == _weak(full["etag"]))
        .when(both("last_modified"), F.col("last_modified") == full["last_modified"])
        .when(both("digest"), F.col("digest") == full["digest"]))
    return F.when(full.isNull(), "unmatched").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("changed")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """One row per revisit of ``captures(record_id, url, time, kind, etag, last_modified, digest, headers)``.

    ``kind`` is ``response`` or ``revisit``. The result has the canonical URL, the response found, the verdict and, if
    resolved, the merged header fields.
    """
    keyed = captures.select(*FULL, "time", "kind", canonical_url(F.col("url")).alias("key"))
    apart = F.col("key").isNull() | F.col("time").isNull()
    # A response at the time of a revisit is not earlier, so revisits come first.
    order = ["time", "is_full", "record_id"]
    full = F.when(F.col("kind") == "response", F.struct(*FULL))
    ranged = keyed.where(~apart).withColumn("is_full", (F.col("kind") == "response").cast("int")).withColumn("full", full)
    placed = stage(ranged.repartitionByRange("key", *order).withColumn("block", F.spark_partition_id()), "captures")
    inside = Window.partitionBy("key", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("near", F.last("full", ignorenulls=True).over(inside)).where(F.col("kind") == "revisit")
    ends = placed.where(F.col("full").isNotNull()).groupBy("key", "block").agg(F.max_by("full", F.struct(*order)).alias("full"))
    spans = placed.select("key", "block").distinct()
    known = spans.join(ends, ["key", "block"], "left")
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = known.select("key", "block", F.last("full", ignorenulls=True).over(before).alias("far")).where(F.col("far").isNotNull())
    found = local.join(carried, ["key", "block"], "left").withColumn("hit", F.coalesce("near", "far"))
    rest = keyed.where(apart & (F.col("kind") == "revisit")).withColumn("hit", F.lit(None).cast(placed.schema["full"].dataType))
    columns = ["record_id", "key", "time", "etag", "last_modified", "digest", "headers", "hit"]
    judged = found.select(*columns).union(rest.select(*columns)).withColumn("verdict", _verdict(F.col("hit")))
    merged = F.when(F.col("verdict") == "resolved", merged_headers(F.col("hit.headers"), F.col("headers")))
    return judged.select("record_id", F.col("key").alias("canonical_url"), "time", F.col("hit.record_id").alias("response_id"), "verdict", merged.alias("headers"))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Captures that a crawl of ``pages`` could have made: full responses and later, changed and too early revisits."""
    tag = F.concat(F.lit('"'), F.left(F.md5("html"), F.lit(12)), F.lit('"'))
    start = F.lit(1_700_000_000) + F.col("page_id") * 60
    again = F.concat(F.lit('"again-'), F.col("page_id").cast("string"), F.lit('"'))
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")

    def capture(n, kind, delay, url, etag, modified, digest, **headers):
        fields = [x for name, value in headers.items() for x in (F.lit(name.replace("_", "-")), value)]
        return F.struct(
            (F.col("page_id") * 10 + n).alias("record_id"), url.alias("url"), (start + delay).alias("time"), F.lit(kind).alias("kind"), etag.alias("etag"),
            modified.alias("last_modified"), digest.alias("digest"), F.create_map(*fields).cast("map<string,string>").alias("headers"))

    url = F.col("url")
    first = text(start - 86_400)
    made = F.array(
        capture(0, "response", 0, url, tag, first, F.md5("html"), Content_Type=F.lit("text/html"), ETag=tag, Cache_Control=F.lit("max-age=60")),
        capture(1, "revisit", 3_600, F.concat(url, F.lit("#top")), F.concat(F.lit("W/"), tag), none, none, ETag=F.concat(F.lit("W/"), tag), Cache_Control=F.lit("max-age=600"), Content_Length=F.lit("0")),
        capture(2, "revisit", 7_200, url, F.lit('"stale"'), first, none, ETag=F.lit('"stale"')),
        capture(3, "revisit", -3_600, url, tag, none, none, ETag=tag),
        capture(4, "revisit", 14_400, url, none, first, none, Date=text(start + 14_400)),
        capture(5, "revisit", 18_000, url, none, none, F.md5("html"), Content_Type=F.lit("message/http"), Age=F.lit("7")),
        capture(6, "revisit", 21_600, url, none, none, none))
    third = capture(7, "response", 10_800, url, again, text(start), F.md5(again), Content_Type=F.lit("text/html"), ETag=again)
    every = F.when(F.col("page_id") % 3 == 0, F.concat(made, F.array(third))).otherwise(made)
    return pages.select(F.explode(every).alias("c")).select("c.*")


def op2_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = resolve_revisits(captures_of_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    fields = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return resolved.withColumn("headers", F.array_join(F.array_sort(fields), "; "))


OP2_SQL = r"""
WITH base AS (
    SELECT page_id, url, md5(html) AS hash, '"' || left(md5(html), 12) || '"' AS tag, '"again-' || page_id || '"' AS again, 1700000000 + page_id * 60 AS start FROM pages),
captures AS (
    SELECT page_id * 10 AS record_id, url, start AS time, 'response' AS kind, tag AS etag, CAST(start - 86400 AS VARCHAR) AS last_modified, hash AS digest,
        MAP {'content-type': 'text/html', 'etag': tag, 'cache-control': 'max-age=60'} AS headers FROM base
    UNION ALL SELECT page_id * 10 + 1, url || '#top', start + 3600, 'revisit', 'W/' || tag, NULL, NULL, MAP {'etag': 'W/' || tag, 'cache-control': 'max-age=600'} FROM base
    UNION ALL SELECT page_id * 10 + 2, url, start + 7200, 'revisit', '"stale"', CAST(start - 86400 AS VARCHAR), NULL, MAP {'etag': '"stale"'} FROM base
    UNION ALL SELECT page_id * 10 + 3, url, start - 3600, 'revisit', tag, NULL, NULL, MAP {'etag': tag} FROM base
    UNION ALL SELECT page_id * 10 + 4, url, start + 14400, 'revisit', NULL, CAST(start - 86400 AS VARCHAR), NULL, MAP {'date': CAST(start + 14400 AS VARCHAR)} FROM base
    UNION ALL SELECT page_id * 10 + 5, url, start + 18000, 'revisit', NULL, NULL, hash, MAP {'age': '7'} FROM base
    UNION ALL SELECT page_id * 10 + 6, url, start + 21600, 'revisit', NULL, NULL, NULL, MAP {} FROM base
    UNION ALL SELECT page_id * 10 + 7, url, start + 10800, 'response', again, CAST(start AS VARCHAR), md5(again), MAP {'content-type': 'text/html', 'etag': again} FROM base WHERE page_id % 3 = 0),
parts AS (SELECT *, regexp_replace(regexp_replace(url, '#(.|\n)*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM captures),
split AS (
    SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') AS host,
        regexp_replace(substr(split_part(rest, '?', 1), length(regexp_extract(rest, '^[^/?]*')) + 1), '/+$', '') AS path,
        list_sort(list_filter(string_split(CASE WHEN contains(rest, '?') THEN substr(rest, instr(rest, '?') + 1) ELSE '' END, '&'),
            lambda f: f <> '' AND NOT regexp_matches(f, '^(utm_|fbclid=|gclid=|ref=)'))) AS fields FROM parts),
keyed AS (SELECT *, host || path || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END AS key FROM split),
ranked AS (
    SELECT r.record_id, r.key, r.time, r.etag, r.last_modified, r.digest, r.headers, f.record_id AS f_id, f.etag AS f_etag, f.last_modified AS f_modified, f.digest AS f_digest, f.headers AS f_headers,
        row_number() OVER (PARTITION BY r.record_id ORDER BY f.time DESC NULLS LAST, f.record_id DESC) AS place
    FROM keyed r LEFT JOIN (SELECT * FROM keyed WHERE kind = 'response') f ON f.key = r.key AND f.time < r.time
    WHERE r.kind = 'revisit'),
judged AS (
    SELECT *, CASE WHEN f_id IS NULL THEN 'unmatched'
        WHEN etag IS NOT NULL AND f_etag IS NOT NULL THEN CASE WHEN replace(etag, 'W/', '') = replace(f_etag, 'W/', '') THEN 'resolved' ELSE 'changed' END
        WHEN last_modified IS NOT NULL AND f_modified IS NOT NULL THEN CASE WHEN last_modified = f_modified THEN 'resolved' ELSE 'changed' END
        WHEN digest IS NOT NULL AND f_digest IS NOT NULL THEN CASE WHEN digest = f_digest THEN 'resolved' ELSE 'changed' END
        ELSE 'unchecked' END AS verdict
    FROM ranked WHERE place = 1)
SELECT record_id, key AS canonical_url, time, f_id AS response_id, verdict,
    CASE WHEN verdict = 'resolved' THEN array_to_string(list_sort(list_concat(
        list_transform(map_entries(headers), lambda e: e.key || ': ' || e.value),
        list_transform(list_filter(map_entries(f_headers), lambda e: NOT list_contains(map_keys(headers), e.key)), lambda e: e.key || ': ' || e.value))), '; ') END AS headers
FROM judged
"""
