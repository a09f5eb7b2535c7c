"""Runs and rows: status updates, listings, what a batch added, and how it went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What can become of a source in a run.
OUTCOMES = ("inserted", "skipped_existing", "skipped_duration", "skipped_no_transcript", "failed")


def update_status(rows: DataFrame, changes: DataFrame, key: str, at: str | None = None, now: Column | None = None) -> DataFrame:
    """``rows`` with status and error_message of ``changes`` (key, status, error_message; the last by all columns).

    With ``at`` that column is set to ``now`` where a status changes, as for runs that end.
    """
    last = changes.groupBy(key).agg(F.max(F.struct("status", "error_message")).alias("__new"))
    hit = F.col("__new").isNotNull()
    out = rows.join(last, key, "left")
    out = out.withColumns({"status": F.when(hit, F.col("__new.status")).otherwise(F.col("status")), "error_message": F.when(hit, F.col("__new.error_message")).otherwise(F.col("error_message"))})
    if at is not None:
        out = out.withColumn(at, F.when(hit, F.current_timestamp() if now is None else now).otherwise(F.col(at)))
    return out.select(*rows.columns)


def complete(runs: DataFrame, run_ids: DataFrame, status: str = "completed", error_message: str | None = None, now: Column | None = None) -> DataFrame:
    """Runs of these ids ended: status, error and completed_at."""
    ended = run_ids.select("run_id", F.lit(status).alias("status"), F.lit(error_message).cast("string").alias("error_message"))
    return update_status(runs, ended, "run_id", "completed_at", now)


def children(rows: DataFrame, parent: str, value: str, *order: str) -> DataFrame:
    """The rows of one parent in order, as moments of a video by start or evidence of a moment by modality."""
    return rows.where(F.col(parent) == value).orderBy(*order)


def newest(rows: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Rows from the last created on, ties by key."""
    out = rows.orderBy(F.desc("created_at"), key)
    return out if limit is None else out.limit(limit)


def deltas(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """video_id, and for each table the rows that a batch added to it; rows of a video that had moments before count as rebuilt.

    Tables have video_id, or moment_id that the table of moments tells the video of.
    """

    def counts(tables: dict[str, DataFrame], when: str) -> DataFrame:
        video = tables["moments"].select("moment_id", "video_id")
        rows = None
        for name, df in tables.items():
            own = df.select("video_id") if "video_id" in df.columns else df.select("moment_id").join(video, "moment_id").select("video_id")
            own = own.groupBy("video_id").agg(F.count("*").alias("n")).withColumns({"name": F.lit(name), "when": F.lit(when)})
            rows = own if rows is None else rows.unionByName(own)
        return rows

    names = list(after)
    both = counts(before, "before").unionByName(counts(after, "after"))
    count = lambda name, when: F.sum(F.when((F.col("name") == name) & (F.col("when") == when), F.col("n")).otherwise(0))
    one = both.groupBy("video_id").agg(*(count(n, w).alias(f"{n}_{w}") for n in names for w in ("before", "after")))
    rebuilt = F.col("moments_before") > 0
    new = [F.when(rebuilt, F.col(f"{n}_after")).otherwise(F.col(f"{n}_after") - F.col(f"{n}_before")).alias(f"new_{n}") for n in names]
    return one.select("video_id", rebuilt.alias("rebuilt"), *new)


def run_summary(outcomes: DataFrame, added: DataFrame) -> DataFrame:
    """One row: how many sources were tried, what became of them, the rows added, the sources that failed in order.

    ``outcomes``: source, video_id, outcome; ``added`` as `deltas` gives it.
    """
    told = outcomes.agg(
        F.count("*").alias("attempted"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("outcome") == "failed", F.col("source")))), ",").alias("failed_sources"),
    )
    new = [c for c in added.columns if c.startswith("new_")]
    ours = added.join(outcomes.where("outcome = 'inserted'").select("video_id").distinct(), "video_id", "left_semi")
    return told.crossJoin(ours.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in new)))  # one row each
