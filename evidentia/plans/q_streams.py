"""Registered queries: streams, trace frames and index tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions.durable import work_folder
from evidentia.plans.registry import query
from evidentia.sources import index as IX
from evidentia.streaming import ingest as IN
from evidentia.streaming import trace as TR


def stream_of(table):
    """All files of a table as a stream: those of its folder, or the one file beside others that it consists of."""
    folder, _, name = table.inputFiles()[0].rpartition("/")
    reader = table.sparkSession.readStream.schema(table.schema)
    return (reader if folder.endswith(".parquet") else reader.option("pathGlobFilter", name)).parquet(folder)


def drain(stream, name: str, mode: str = "append"):
    """Run a stream over all present data and read back what it wrote."""
    spark = stream.sparkSession
    out, checkpoint = work_folder(spark, name), work_folder(spark, f"{name}-checkpoint")
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("x1_incremental_ingest", """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 7 = 0 OR trim(text) = '' THEN 'failed' ELSE 'indexed' END AS status FROM documents""")
def x1(t):
    docs = t("documents")
    spark = docs.sparkSession
    payload = F.when(F.col("doc_id") % 7 == 0, F.lit("%%not base64%%")).otherwise(F.base64(F.encode("text", "UTF-8")))
    stream = stream_of(docs).select("doc_id", payload.alias("payload"))
    index, status = work_folder(spark, "index"), work_folder(spark, "status")
    IX.create_index(spark, index)
    IN.run_available(stream, work_folder(spark, "ingest-checkpoint"), index, status)
    return IN.latest_status(spark, status).select("doc_id", "status")


@query("x2_trace_parse", """
    SELECT run_id, sequence_number, step_type, CAST(json_extract(payload, '$.k') AS BIGINT) AS k FROM agent_steps WHERE json_valid(payload) AND step_type IN (
      'query.received', 'query.rewritten', 'query.classified', 'priority.classified', 'map.zone_lit', 'route.decided', 'retrieval.started', 'retrieval.completed',
      'agent.thinking', 'section.filling', 'section.completed', 'section.unavailable', 'agent.completed', 'agent.timed_out', 'conflict.detected', 'validation.running',
      'validation.result', 'synthesis.started', 'answer.streaming', 'answer.completed', 'error')""")
def x2(t):
    rows = TR.parse_frames(t("agent_steps"))
    return rows.select("run_id", "sequence_number", "step_type", F.try_variant_get("data", "$.k", "bigint").alias("k"))


_EVENT_STREAM = "SELECT user_id AS run_id, event_id AS sequence_number FROM events"


@query("x3_idempotent_stream", _EVENT_STREAM)
def x3(t):
    frames = stream_of(t("events")).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("sequence_number"), F.col("ts").alias("created_at"))
    twice = frames.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    return drain(TR.once_within(twice), "trace").select("run_id", "sequence_number")


@query("x3_idempotent_batch", "SELECT run_id, sequence_number, count(*) AS copies FROM (SELECT run_id, sequence_number FROM agent_steps) GROUP BY ALL")
def x3_batch(t):
    frames = t("agent_steps").select("run_id", "sequence_number")
    return TR.once(frames.unionByName(frames)).withColumn("copies", F.lit(1))


@query("x3_out_of_order", """
    SELECT run_id, sequence_number FROM (SELECT run_id, sequence_number, created_at, lag(created_at) OVER (PARTITION BY run_id ORDER BY sequence_number) AS p FROM (
      SELECT run_id, CAST(duration_ms AS BIGINT) * 100000 + sequence_number AS sequence_number, created_at FROM agent_steps)) WHERE created_at < p""")
def x3_order(t):
    rows = t("agent_steps").withColumn("sequence_number", F.col("duration_ms") * 100000 + F.col("sequence_number"))
    return TR.out_of_order(rows).select("run_id", "sequence_number")


@query("x4_run_completion", "SELECT run_id, count(*) AS frames, arg_max(step_type, sequence_number) AS last_step, bool_or(step_type IN ('answer.completed', 'error')) AS completed FROM agent_steps GROUP BY run_id")
def x4(t):
    return TR.completion(t("agent_steps"))


def _sessions_sql(frames: str) -> str:
    return f"""
    WITH f AS ({frames}), g AS (SELECT run_id, created_at, step_type, CASE WHEN created_at >= lag(created_at) OVER (PARTITION BY run_id ORDER BY created_at, sequence_number) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut, sequence_number FROM f),
    s AS (SELECT *, sum(cut) OVER (PARTITION BY run_id ORDER BY created_at, sequence_number ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT run_id, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(created_at) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS frames, bool_or(step_type IN ('answer.completed', 'error')) AS completed FROM s GROUP BY run_id, n"""


def dated(rows):
    return rows.withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss")).withColumn("ended", F.date_format("ended", "yyyy-MM-dd HH:mm:ss"))


@query("x4_run_sessions", _sessions_sql("SELECT * FROM agent_steps"))
def x4_sessions(t):
    return dated(TR.sessions(t("agent_steps")))


@query("x4_session_stream", _sessions_sql("SELECT user_id AS run_id, event_id AS sequence_number, ts AS created_at, event_type AS step_type FROM events"))
def x4_stream(t):
    def frames(events):
        return events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("sequence_number"), F.col("ts").alias("created_at"), F.col("event_type").alias("step_type"))

    closed = drain(TR.sessions(frames(stream_of(t("events")))), "sessions")
    return dated(TR.with_open_sessions(closed, frames(t("events"))))


@query("x5_replay", "SELECT run_id, sequence_number, step_type, row_number() OVER (PARTITION BY run_id ORDER BY sequence_number) AS place FROM agent_steps")
def x5(t):
    return TR.replay(t("agent_steps").select("run_id", "sequence_number", "step_type"))


@query("x6_agent_summary", "SELECT run_id, agent, max(duration_ms) AS elapsed_ms, CAST(count(*) FILTER (step_type = 'agent.timed_out') AS BIGINT) AS timed_out FROM agent_steps GROUP BY ALL")
def x6(t):
    return TR.agent_summary(t("agent_steps"))


# ---- index tables -----------------------------------------------------------
@query("s13_append_history", "SELECT report_id, count(*) AS n_answers, CAST(sum(length(answer)) AS BIGINT) AS chars FROM answers GROUP BY report_id")
def s13(t):
    answers = t("answers")
    path = work_folder(answers.sparkSession, "answers")
    IX.append_history(answers.where("pos < 3"), path)
    IX.append_history(answers.where("pos = 3"), path)
    return answers.sparkSession.read.schema(answers.schema).parquet(path).groupBy("report_id").agg(
        F.count("*").alias("n_answers"), F.sum(F.length("answer")).alias("chars"))
