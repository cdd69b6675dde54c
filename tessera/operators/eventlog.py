"""The append-only event log, and tables as projections of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import stable_id


def append_once(log: DataFrame) -> DataFrame:
    """The first event of each idempotency_key, by seq; events without a key all stay."""
    w = Window.partitionBy("idempotency_key").orderBy("seq")
    keyed = log.where("idempotency_key is not null").withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")
    return keyed.unionByName(log.where("idempotency_key is null"))


def key_collisions(log: DataFrame) -> DataFrame:
    """idempotency_key, variants: keys that came with different content (run, type or payload)."""
    content = F.xxhash64(F.coalesce("run_id", F.lit("")), F.coalesce("event_type", F.lit("")), F.coalesce("payload", F.lit("")))
    return log.where("idempotency_key is not null").groupBy("idempotency_key").agg(F.count_distinct(content).alias("variants")).where("variants > 1")


def replay(log: DataFrame, run_id: str | None = None) -> DataFrame:
    """The events in order."""
    return (log if run_id is None else log.where(F.col("run_id") == run_id)).orderBy("seq")


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order: the projection of a table from its log, a latest checkpoint."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in log.columns if c not in keys]), F.struct(*order)).alias("r")).select(*keys, "r.*")


def state_counts(log: DataFrame, keys: list[str]) -> DataFrame:
    """*keys, event_type, events, first_at, last_at."""
    return log.groupBy(*keys, "event_type").agg(F.count("*").alias("events"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def created_runs(requests: DataFrame) -> DataFrame:
    """run_id, target, architecture, created_at, seq: the first request of each run (requests: the same columns); what
    comes again changes nothing. Requests without run_id make no run."""
    first = requests.where("run_id is not null").groupBy("run_id").agg(F.min_by(F.struct("target", "architecture", "created_at", "seq"), "seq").alias("r"))
    return first.select("run_id", "r.*")


def checkpoints(states: DataFrame) -> DataFrame:
    """run_id, checkpoint_id, payload, seq: each state of a run once, by the hash of its content (states: run_id, payload,
    seq); a state that comes back is the checkpoint it was first."""
    made = states.withColumn("checkpoint_id", stable_id("checkpoint", F.col("run_id"), F.col("payload")))
    first = made.groupBy("run_id", "checkpoint_id").agg(F.min_by(F.struct("payload", "seq"), "seq").alias("s"))
    return first.select("run_id", "checkpoint_id", "s.payload", "s.seq")


def latest_checkpoint(made: DataFrame) -> DataFrame:
    """run_id, checkpoint_id, seq of the last checkpoint of each run."""
    return made.groupBy("run_id").agg(F.max_by(F.struct("checkpoint_id", "seq"), F.struct("seq", "checkpoint_id")).alias("c")).select("run_id", "c.*")
