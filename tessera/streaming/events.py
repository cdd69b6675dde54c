"""The event log as a stream: idempotent intake, projections and lease timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_log(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of JSON lines as a stream of events."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def append_once(events: DataFrame, delay: str = "7 days", key: str = "idempotency_key", time: str = "created_at") -> DataFrame:
    """The first event of each key; keys are remembered for the delay. Across longer spans the stored log decides:
    eventlog.append_once over the whole of it."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, window: str = "1 hour", delay: str = "1 day", time: str = "created_at") -> DataFrame:
    """window_start, run_id, event_type, events: late events count until the delay is over."""
    return (
        events.withWatermark(time, delay)
        .groupBy(F.window(time, window), "run_id", "event_type")
        .agg(F.count("*").alias("events"))
        .select(F.col("window.start").alias("window_start"), "run_id", "event_type", "events")
    )


LEASE_STATE = "state string, expires_ms long"
LEASE_OUT = "run_id string, task_id string, event string, at_ms long"


def _lease(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        (_, expires) = state.get
        state.remove()
        yield pd.DataFrame({"run_id": [key[0]], "task_id": [key[1]], "event": ["TASK_LEASE_EXPIRED"], "at_ms": [expires]})
        return
    rows = pd.concat(list(batches)).sort_values(["at_ms", "seq"])
    for kind, expires in zip(rows["event_type"].tolist(), rows["expires_ms"].tolist(), strict=True):
        if kind in ("TASK_STARTED", "TASK_LEASE_RENEWED") and not pd.isna(expires):
            state.update((kind, int(expires)))
        elif kind in ("TASK_SUCCEEDED", "TASK_FAILED") and state.exists:
            state.remove()
    if state.exists:
        state.setTimeoutTimestamp(max(state.get[1], state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"run_id": [], "task_id": [], "event": [], "at_ms": []}).astype({"at_ms": "int64"})


def expired_leases(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """LEASE_OUT rows, one for each lease that ran out in event time before its task ended or renewed it.

    events: run_id, task_id, seq, event_type, created_at, lease_expires_at. One small state per running task.
    """
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    timed = events.withWatermark("created_at", delay).select("created_at", "run_id", "task_id", "seq", "event_type", ms("created_at").alias("at_ms"), ms("lease_expires_at").alias("expires_ms"))
    return timed.groupBy("run_id", "task_id").applyInPandasWithState(_lease, LEASE_OUT, LEASE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and end; the next call goes on from where this one ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
