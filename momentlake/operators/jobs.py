"""Jobs as an event log: latest state, durations, stuck jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states of a job.
STATES = ("queued", "running", "ready", "error", "skipped", "needs_transcription", "skipped_no_transcript")
ENDED = STATES[2:]
TIMEOUT_S = 120.0


def latest(events: DataFrame) -> DataFrame:
    """One row for each job from its events (job_id, event_id, ts, status, detail).

    The status is the last one; started_at the first ``running``, finished_at the first
    end state after it, last_heartbeat_at the last event; duration in milliseconds.
    """
    at = lambda *states: F.min(F.when(F.col("status").isin(*states), F.col("ts")))
    last = lambda c: F.max_by(c, F.struct("ts", "event_id"))
    j = events.groupBy("job_id").agg(
        last("status").alias("status"), last("detail").alias("detail"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), at("running").alias("started_at"),
        F.max(F.when(F.col("status").isin(*ENDED), F.col("ts"))).alias("finished_at"), F.max(F.when(F.col("status") == "running", F.col("ts"))).alias("last_heartbeat_at"), F.count("*").alias("n_events"),
    )
    return j.withColumn("duration_ms", F.unix_millis("finished_at") - F.unix_millis("started_at"))


def stuck(jobs: DataFrame, now: Column, timeout_s: float = TIMEOUT_S) -> DataFrame:
    """Running jobs without a heartbeat, or with one more than ``timeout_s`` before ``now``."""
    age = F.unix_micros(now) - F.unix_micros("last_heartbeat_at")
    return jobs.where((F.col("status") == "running") & (F.col("last_heartbeat_at").isNull() | (age > int(timeout_s * 1e6))))


def marked(jobs: DataFrame, now: Column, timeout_s: float = TIMEOUT_S) -> DataFrame:
    """All jobs, stuck ones with status error and a message."""
    late = stuck(jobs, now, timeout_s).select("job_id", F.lit("no heartbeat").alias("error_message"))
    return jobs.join(late, "job_id", "left").withColumn("status", F.when(F.col("error_message").isNotNull(), "error").otherwise(F.col("status")))


def newest(jobs: DataFrame, limit: int) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)
