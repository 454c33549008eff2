"""Trace frames: parsing, idempotence, completion and summaries, in batch and as streams.

A frame is ``run_id, sequence_number, created_at, step_type, agent, duration_ms, payload``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia import params as P
from evidentia.functions.scan import number_rows, previous_value


def parse_frames(frames: DataFrame, known: list[str] | None = None) -> DataFrame:
    """Keep frames of known step types whose payload is well-formed JSON; the payload becomes a VARIANT."""
    parsed = frames.withColumn("data", F.try_parse_json("payload"))
    return parsed.where(F.col("data").isNotNull() & F.col("step_type").isin(known or P.STEP_TYPES))


def once(frames: DataFrame) -> DataFrame:
    """One frame per run and sequence number."""
    return frames.dropDuplicates(["run_id", "sequence_number"])


def once_within(frames: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The same on a stream, with state bounded by the watermark."""
    timed = frames.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", lateness)
    return timed.dropDuplicatesWithinWatermark(["run_id", "sequence_number"])


def out_of_order(frames: DataFrame) -> DataFrame:
    """Frames stamped earlier than the frame before them in their run."""
    seen = previous_value(frames, "run_id", "sequence_number", "created_at", "previous_at")
    return seen.where(F.col("created_at") < F.col("previous_at"))


def completion(frames: DataFrame) -> DataFrame:
    """Per run: frames, last step, and whether a terminal step was seen. Partial aggregates only."""
    return frames.groupBy("run_id").agg(
        F.count("*").alias("frames"), F.max_by("step_type", "sequence_number").alias("last_step"),
        F.bool_or(F.col("step_type").isin(P.TERMINAL_STEPS)).alias("completed"))


def sessions(frames: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Runs cut into sessions by a pause; works on a stream and on a table."""
    timed = frames.withColumn("created_at", F.col("created_at").cast("timestamp"))
    if frames.isStreaming:
        timed = timed.withWatermark("created_at", lateness)
    rows = timed.groupBy("run_id", F.session_window("created_at", gap).alias("w")).agg(
        F.count("*").alias("frames"), F.bool_or(F.col("step_type").isin(P.TERMINAL_STEPS)).alias("completed"))
    return rows.select("run_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "frames", "completed")


def with_open_sessions(closed: DataFrame, frames: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions that a stream has closed, and those still open in ``frames``, the stored frames of the same runs.

    A stream gives a session out once its watermark has passed the end; this batch adds the frames behind each run's
    last closed session, so that no session is missing at a cut-off.
    """
    last = closed.groupBy("run_id").agg(F.max("ended").alias("__ended"))
    behind = frames.join(last, "run_id", "left").where(F.col("__ended").isNull() | (F.col("created_at").cast("timestamp") >= F.col("__ended")))
    return closed.unionByName(sessions(behind.drop("__ended"), gap))


def replay(frames: DataFrame) -> DataFrame:
    """Stored frames with their place in the run."""
    return number_rows(frames, "run_id", "sequence_number", "place")


def agent_summary(frames: DataFrame) -> DataFrame:
    """Per run and agent: longest step and number of timeouts."""
    return frames.groupBy("run_id", "agent").agg(
        F.max("duration_ms").alias("elapsed_ms"), F.count_if(F.col("step_type") == "agent.timed_out").alias("timed_out"))


def with_steps_stream(reports: DataFrame, steps: DataFrame, within: str = "2 hours", lateness: str = "1 hour") -> DataFrame:
    """Reports ``(report_id, run_id, created_at)`` beside the steps ``(run_id, sequence_number, step_at)`` of their run that
    come within a time limit, while both arrive.

    A step meets its report in either order of arrival; a report that no step has joined by the time its limit and the
    lateness are over comes alone, so what is kept of either stream is bounded by time.
    """
    told = reports.select("report_id", "run_id", F.col("created_at").cast("timestamp").alias("created_at")).withWatermark("created_at", lateness)
    done = steps.select(F.col("run_id").alias("step_run"), "sequence_number", F.col("step_at").cast("timestamp").alias("step_at")).withWatermark("step_at", lateness)
    limit = F.expr(f"step_run = run_id AND step_at >= created_at AND step_at <= created_at + INTERVAL {within}")
    return told.join(done, limit, "left").drop("step_run")


def settled(streamed: DataFrame, reports: DataFrame, steps: DataFrame, within: str = "2 hours") -> DataFrame:
    """What the stream has written, completed from the stored reports and steps: steps that came too late for it, and
    reports that it still held open."""
    told = reports.select("report_id", "run_id", F.col("created_at").cast("timestamp").alias("created_at"))
    done = steps.select("run_id", "sequence_number", F.col("step_at").cast("timestamp").alias("step_at"))
    pairs = told.join(done, "run_id").where(F.expr(f"step_at >= created_at AND step_at <= created_at + INTERVAL {within}"))
    met = streamed.where(F.col("sequence_number").isNotNull())
    late = pairs.join(met.select("report_id", "sequence_number"), ["report_id", "sequence_number"], "left_anti").select(streamed.columns)
    both = met.unionByName(late)
    alone = told.join(both.select("report_id").distinct(), "report_id", "left_anti")
    return both.unionByName(alone, allowMissingColumns=True)
