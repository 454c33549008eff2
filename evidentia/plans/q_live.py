"""Registered queries: the live index, and documents that arrive while they are searched."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from evidentia.functions.durable import work_folder
from evidentia.plans import sqltext as S
from evidentia.plans.q_retrieval import benchmark
from evidentia.plans.q_streams import drain, stream_of
from evidentia.plans.registry import query
from evidentia.sources import frames as FR
from evidentia.sources import retrieval as R
from evidentia.sources import segments as SG
from evidentia.streaming import ingest as IN
from evidentia.streaming import lifecycle as LC
from evidentia.streaming import trace as TR

_LIVE: dict[tuple, str] = {}


def live(t) -> str:
    """A live index with a history: stale texts replaced, strangers added and removed; in the end it holds the documents.

    Built once per application and data folder.
    """
    units = t("doc_chunks")
    spark = units.sparkSession
    key = spark.sparkContext.applicationId, tuple(sorted(units.inputFiles()))
    if key not in _LIVE:
        path = work_folder(spark, "live")
        rows = units.select("chunk_id", F.col("chunk_id").alias("doc_id"), "text", "record_type")
        strangers = t("benchmark").select((-1 - F.col("item_id")).alias("chunk_id"), (-1 - F.col("item_id")).alias("doc_id"), "text", F.lit("policy").alias("record_type"))
        first, stale = F.col("doc_id") % 3 != 0, F.col("doc_id") % 5 == 0
        SG.create(spark, path, "bigint")
        early = rows.where(first).withColumn("text", F.when(stale, F.reverse("text")).otherwise(F.col("text")))
        SG.publish(path, early.unionByName(strangers), label="record_type")
        SG.publish(path, rows.where(~first | stale), label="record_type")
        SG.remove(path, strangers)
        _LIVE[key] = path
    return _LIVE[key]


@query("r1_live_index", """
    SELECT * FROM (SELECT query_id, chunk_id, score, n_matched, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM d_bm25)
    WHERE rank <= 10""")
def r1_live(t):
    return R.search_lexical(SG.load(t("documents").sparkSession, live(t)), benchmark(t), 10)


@query("r3_live_index", "SELECT query_id, chunk_id, score, rank FROM d_dense WHERE rank <= 10")
def r3_live(t):
    return R.search_dense(SG.load(t("documents").sparkSession, live(t)), benchmark(t), 10)


@query("g2_live_statistics", "SELECT term, df FROM d_df UNION ALL SELECT '', n FROM d_stats")
def g2_live(t):
    return SG.load(t("documents").sparkSession, live(t)).counts.select("term", "df")


@query("s10_versions", """
    SELECT 0 AS version, 0 AS documents UNION ALL
    SELECT 1, (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0) + (SELECT count(*) FROM benchmark) UNION ALL
    SELECT 2, (SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark) UNION ALL
    SELECT 3, count(*) FROM documents""")
def s10_versions(t):
    """Each committed version still reads as it was."""
    spark, path = t("documents").sparkSession, live(t)
    out = None
    for version in SG.versions(spark, path)[:4]:
        seen = SG.live_documents(spark, path, SG.snapshot(spark, path, version))
        row = seen.agg(F.lit(version).alias("version"), F.count("*").alias("documents"))
        out = row if out is None else out.unionByName(row)
    return out


@query("s10_merged_index", """
    SELECT * FROM (SELECT query_id, chunk_id, score, n_matched, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM d_bm25)
    WHERE rank <= 10""")
def s10_merged(t):
    """The segments of the live index rewritten as one, which holds no dead chunk."""
    spark, path = t("documents").sparkSession, live(t)
    seen = SG.snapshot(spark, path)
    merged = SG.merge(spark, path, seen.ids, seen) if len(seen.segments) > 1 else seen
    return R.search_lexical(SG.load(spark, path, merged), benchmark(t), 10)


@query("x1_search_ingested", f"""
    WITH tok AS (SELECT doc_id, {S.toks('text')} AS toks FROM documents WHERE trim(text) <> ''),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM tok) GROUP BY ALL),
    stats AS (SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM tok),
    df AS (SELECT term, ln(1 + ((SELECT n FROM stats) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term),
    scored AS (
      SELECT query_id, doc_id, round(sum(idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avg_len)))), 6) AS score
      FROM q_tok JOIN tf USING (term) JOIN df USING (term) JOIN tok USING (doc_id), stats GROUP BY ALL)
    SELECT * FROM (SELECT query_id, CAST(doc_id AS VARCHAR) AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM scored)
    WHERE rank <= 10""")
def x1_search(t):
    """Encoded documents stream in, and what has arrived is searched."""
    docs = t("documents")
    spark = docs.sparkSession
    index, status = work_folder(spark, "live"), work_folder(spark, "status")
    SG.create(spark, index)
    stream = stream_of(docs).select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("payload"))
    IN.run_live(stream, work_folder(spark, "ingest-checkpoint"), index, status, IN.whole_documents)
    return R.search_lexical(SG.load(spark, index), benchmark(t), 10).drop("n_matched")


_EVENTS = {"signup": "uploaded", "view": "started", "purchase": "completed", "error": "errored", "click": "deleted"}
_SQL_EVENT = " ".join(f"WHEN '{kind}' THEN '{event}'" for kind, event in _EVENTS.items())
_SQL_STEP = " ".join(f"WHEN s1 = '{status}' AND event = '{event}' THEN '{following}'" for (status, event), following in LC.STEPS.items())
_SQL_LIMIT = f"INTERVAL {LC.STUCK_AFTER // timedelta(hours=1)} HOUR"
_TIMED = "('pending', 'indexing')"


@query("x1_lifecycle", f"""
    WITH RECURSIVE e AS (
      SELECT user_id AS doc_id, ts AS moment, CASE event_type {_SQL_EVENT} END AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (
      SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, 'absent' AS status, CAST(NULL AS TIMESTAMP) AS since, CAST(NULL AS TIMESTAMP) AS failed_at, 'absent' AS s1,
        CAST(NULL AS VARCHAR) AS event, CAST(NULL AS TIMESTAMP) AS moment FROM e
      UNION ALL
      SELECT doc_id, n, after AS status, CASE WHEN after <> s1 THEN moment WHEN stuck THEN since + {_SQL_LIMIT} ELSE since END AS since,
        CASE WHEN stuck THEN since + {_SQL_LIMIT} END AS failed_at, s1, event, moment
      FROM (SELECT *, CASE {_SQL_STEP} ELSE s1 END AS after FROM (
        SELECT *, CASE WHEN stuck THEN 'failed' ELSE status END AS s1 FROM (
          SELECT e.doc_id, e.n, e.moment, e.event, r.status, r.since, r.status IN {_TIMED} AND r.since + {_SQL_LIMIT} < e.moment AS stuck
          FROM r JOIN e ON e.doc_id = r.doc_id AND e.n = r.n + 1)))),
    changes AS (
      SELECT doc_id, failed_at AS moment, 'timer' AS event, 'failed' AS status FROM r WHERE failed_at IS NOT NULL
      UNION ALL SELECT doc_id, moment, event, CASE status WHEN 'absent' THEN 'deleted' ELSE status END FROM r WHERE n > 0 AND status <> s1
      UNION ALL SELECT doc_id, moment, event, 'refused' FROM r WHERE s1 = 'indexing' AND event = 'deleted'
      UNION ALL SELECT doc_id, since + {_SQL_LIMIT}, 'timer', 'failed' FROM r
        WHERE n = (SELECT max(n) FROM e WHERE e.doc_id = r.doc_id) AND status IN {_TIMED} AND since + {_SQL_LIMIT} <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events))
    SELECT doc_id, strftime(moment, '%Y-%m-%d %H:%M:%S.%f') AS moment, event, status FROM changes""")
def x1_lifecycle(t):
    """Every change of status of documents whose events stream in, the timers of stuck ones included."""
    events = t("events")
    kinds = F.coalesce(*[F.when(F.col("event_type") == kind, F.lit(event)) for kind, event in _EVENTS.items()])
    stream = stream_of(events).select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("sequence"), F.col("ts").alias("at"), kinds.alias("event"))
    with LC.rocksdb_state(events.sparkSession):
        changes = drain(LC.lifecycle(stream), "lifecycle")
    return changes.select("doc_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("moment"), "event", "status")


# ---- frames in files, reports beside their steps ------------------------------
_FRAMES = "SELECT sequence_number, step_type, run_id, CAST(json_extract(payload, '$.k') AS BIGINT) AS k FROM agent_steps WHERE json_valid(payload)"


def frame_file(t) -> str:
    """The trace frames as an event-stream file: a name and two lines of data each."""
    steps = t("agent_steps")
    path = work_folder(steps.sparkSession, "frames")
    head = F.concat(F.lit('data: {"run_id": '), "run_id", F.lit(', "sequence_number": '), "sequence_number", F.lit(","))
    frame = F.concat_ws("\n", F.concat(F.lit("event: "), "step_type"), head, F.concat(F.lit('data: "payload": '), "payload", F.lit("}")))
    steps.select(frame.alias("value")).write.option("lineSep", "\n\n").text(path)
    FR.register(steps.sparkSession)
    return path


def read_frames(frames):
    data = F.try_parse_json("data")
    field = lambda path: F.try_variant_get(data, path, "bigint")
    return frames.where(data.isNotNull()).select(
        field("$.sequence_number").alias("sequence_number"), F.col("event").alias("step_type"), field("$.run_id").alias("run_id"), field("$.payload.k").alias("k"))


@query("x2_frame_file", _FRAMES)
def x2_file(t):
    path = frame_file(t)
    return read_frames(t("events").sparkSession.read.format(FR.FORMAT).option("rangeBytes", 1 << 18).load(path))


@query("x2_frame_stream", _FRAMES)
def x2_stream(t):
    path = frame_file(t)
    stream = t("events").sparkSession.readStream.format(FR.FORMAT).option("rangeBytes", 1 << 18).load(path)
    return read_frames(drain(stream, "frames"))


@query("j5_report_stream", """
    SELECT r.event_id AS report_id, r.user_id AS run_id, s.event_id AS sequence_number FROM events r
    LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') s ON s.user_id = r.user_id AND s.ts >= r.ts AND s.ts <= r.ts + INTERVAL 2 HOUR
    WHERE r.event_type = 'purchase'""")
def j5_stream(t):
    """Reports joined to their steps while both stream in, then settled from the stored rows."""
    events = t("events")

    def reports(rows):
        return rows.where("event_type = 'purchase'").select(F.col("event_id").alias("report_id"), F.col("user_id").alias("run_id"), F.col("ts").alias("created_at"))

    def steps(rows):
        return rows.where("event_type = 'view'").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("sequence_number"), F.col("ts").alias("step_at"))

    streamed = drain(TR.with_steps_stream(reports(stream_of(events)), steps(stream_of(events))), "reports")
    return TR.settled(streamed, reports(events), steps(events)).select("report_id", "run_id", "sequence_number")
