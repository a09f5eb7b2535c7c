"""Streams: job timeouts by event time, activity windows, and incremental chunking.

Beyond what the batch operators cover, these run the same rules on unbounded input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from momentlake.operators import chunking
from momentlake.operators.jobs import ENDED, TIMEOUT_S


def stuck_stream(events: DataFrame, timeout_s: float = TIMEOUT_S, late: str = "10 minutes") -> DataFrame:
    """``job_id, last_heartbeat_at, status`` of jobs whose heartbeat is overdue by the watermark.

    ``events``: job_id, event_id, ts, status. State is one row for each running job; an end state
    removes it.
    """
    wait = int(timeout_s * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "last_heartbeat_at": [pd.Timestamp(last, unit="ms")], "status": ["error"]})
            return
        last, ended = (state.get[0] if state.exists else 0), False
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "event_id"])
            at = pdf["ts"].max().value // 1_000_000
            if at >= last:
                last, ended = at, pdf["status"].iloc[-1] in ENDED
        if ended:
            if state.exists:
                state.remove()
            return
        state.update((last,))
        state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))

    keyed = events.select("job_id", "event_id", "ts", "status").withWatermark("ts", late).groupBy("job_id")
    kind = dict((f.name, f.dataType.simpleString()) for f in events.schema.fields)["job_id"]
    return keyed.applyInPandasWithState(step, f"job_id {kind}, last_heartbeat_at timestamp, status string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def activity(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, status, n by tumbling windows; late rows beyond the watermark are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "status").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("window_start"), "status", "n")


def ingest(entries: DataFrame, path: str, checkpoint: str):
    """Write chunks of each batch of complete transcripts, replacing those of the same videos."""

    def batch(df: DataFrame, _: int) -> None:
        chunking.chunks(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(path)

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, path: str) -> DataFrame:
    """Run a stream over what there is now, write what it puts out as Parquet below ``path``, and read that."""
    q = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").option("path", f"{path}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
