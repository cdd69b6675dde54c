"""Attributes as they were known at the time of an event.

Method: periodic as-known snapshots plus change logs. Time is cut into periods of an entity's key. A snapshot at the start
of a period holds the facts known and valid then; an event takes the snapshot at the start of its period and replays only
the changes between that and itself.

Snapshots keep only facts that can still win: a fact that some later-ranked fact outlives is left out (the rest is a
staircase: the lower the rank, the later the end). They are built in two steps, per period and per epoch of
EPOCH_PERIODS periods, and only for the periods that events ask for, so a hot key spreads over as many tasks as it has
periods and no step joins its facts with its events pair by pair: the replay is one sorted pass with a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.runstore import clean_id, seconds
from .edge_versions import edge_versions

PERIOD_SECONDS = 16 * 86400
EPOCH_PERIODS = 32
FOREVER = 1 << 62


def known_spans(edges: DataFrame) -> DataFrame:
    """run_id, from_id, edge_type, edge_id, known_from, known_to, recorded_at, valid_from (seconds) of each edge.

    An edge answers a question put at t (in valid and in recorded time) just when known_from <= t < known_to: known_from is
    the later of recorded_at and valid_from; known_to is valid_to if nothing supersedes the edge. A superseded edge is open
    until its successor is recorded and ends from then on at the earlier of valid_to and the successor's valid_from, which
    again makes one span. Edges without recorded_at or valid_from are never known and give no row.
    """
    start = F.greatest("recorded_at", "valid_from")
    closed = F.least("valid_to", "next_valid_from")
    end = (
        F.when(~F.col("superseded"), F.col("valid_to"))
        .when(F.col("next_recorded_at").isNull(), F.lit(None))
        .when(closed.isNull(), F.lit(None))
        .when(start < F.col("next_recorded_at"), F.greatest("next_recorded_at", closed))
        .otherwise(closed)
    )
    return (
        edge_versions(edges)
        .where("recorded_at is not null and valid_from is not null")
        .select("run_id", "from_id", "edge_type", "edge_id", start.alias("known_from"), F.coalesce(end, F.lit(FOREVER)).alias("known_to"), "recorded_at", "valid_from")
        .where("known_from < known_to")
    )


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of (key, period, at, kind): facts (kind 0) open at `at`; events (kind 1) ask. Yields answers.

    A heap holds the open facts, best rank first; facts that have ended are dropped when they reach its top.
    """
    heap: list[tuple] = []
    for pdf in batches:
        asked, found = [], []
        for first, kind, at, end, recorded, valid, ident in zip(
            pdf["first"].tolist(), pdf["kind"].tolist(), pdf["at"].tolist(), pdf["known_to"].tolist(), pdf["recorded_at"].tolist(), pdf["valid_from"].tolist(), pdf["id"].tolist(), strict=True
        ):
            if first:
                heap = []
            if kind == 0:
                heapq.heappush(heap, (-recorded, -valid, _Last(ident), end))
                continue
            while heap and heap[0][3] <= at:
                heapq.heappop(heap)
            if heap:
                asked.append(ident)
                found.append(heap[0][2].text)
        yield pd.DataFrame({"event_id": asked, "fact_id": found}, dtype="object")


class _Last:
    """A text that sorts from the greatest to the smallest, by its UTF-8 bytes."""

    __slots__ = ("key", "text")

    def __init__(self, text: str):
        self.text, self.key = text, text.encode("utf-8", "surrogatepass")

    def __lt__(self, other: _Last) -> bool:
        return self.key > other.key

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Last) and self.key == other.key


def as_known(events: DataFrame, facts: DataFrame, keys: list[str], period_seconds: int = PERIOD_SECONDS) -> DataFrame:
    """event_id, fact_id: for each event the best fact of its key that was known and valid at the event's time.

    events: *keys, event_id, at. facts: *keys, fact_id, known_from, known_to, recorded_at, valid_from. Times are whole
    seconds. The greatest (recorded_at, valid_from, fact_id) wins; an event without such a fact gives no row. Events
    without time or with a null in the key give none; repeated events give one row each.
    """
    p = period_seconds
    # known not to be null, or else the optimizer adds other null tests to each branch below, and each shuffles on its own
    part = lambda c, size: F.coalesce(F.floor(c / size).cast("long"), F.lit(0))
    period = lambda c: part(c, p)
    no = F.lit(None).cast("long")
    asked = events.where("at is not null").select(*keys, period(F.col("at")).alias("period"), F.lit(1).alias("kind"), "at", no.alias("known_to"), no.alias("recorded_at"), no.alias("valid_from"), F.col("event_id").alias("id"))
    known = facts.select(*keys, period(F.col("known_from")).alias("period"), F.lit(0).alias("kind"), F.col("known_from").alias("at"), "known_to", "recorded_at", "valid_from", F.col("fact_id").alias("id"))
    not_null = " and ".join(f"{k} is not null" for k in keys)
    log = asked.unionByName(known).where(not_null)

    # the change log of each period, with what its facts leave to later snapshots
    rank = [F.col("recorded_at").desc(), F.col("valid_from").desc(), F.col("id").desc()]
    best_first = Window.partitionBy(*keys, "period").orderBy("kind", *rank)
    whole = best_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    outlived = F.max("known_to").over(best_first.rowsBetween(Window.unboundedPreceding, -1))  # events have none
    log = log.withColumns({"wanted": F.max("kind").over(whole) == 1, "kept": (F.col("kind") == 0) & (F.col("known_to") > F.greatest(F.coalesce(outlived, F.lit(0)), (F.col("period") + 1) * p))})
    fact = ["known_to", "recorded_at", "valid_from", "id"]
    # the test of `at` holds always; with it, and with plain columns in the windows, this branch shuffles the same as the
    # last one, and Spark does it once
    of_period = log.where(F.col("kept") & (F.col("at") < F.col("known_to"))).select(*keys, "period", *fact)

    # the same per epoch
    epoch = part(F.col("period"), EPOCH_PERIODS)
    of_epoch = of_period.withColumn("epoch", epoch).where(F.col("known_to") > (F.col("epoch") + 1) * EPOCH_PERIODS * p)
    by_epoch = Window.partitionBy(*keys, "epoch").orderBy(*rank)
    outlived = F.max("known_to").over(by_epoch.rowsBetween(Window.unboundedPreceding, -1))
    of_epoch = of_epoch.withColumn("outlived", outlived).where("outlived is null or known_to > outlived").select(*keys, "epoch", *fact)

    # snapshots at the start of the periods that events ask for
    wanted = asked.where(not_null).select(*keys, "period").distinct().select(*keys, F.col("period").alias("of"), epoch.alias("of_epoch"))
    opened = [F.col("of").alias("period"), F.lit(0).alias("kind"), (F.col("of") * p).alias("at"), *fact]
    alive = F.col("known_to") > F.col("of") * p
    recent = of_period.withColumn("of_epoch", epoch).join(wanted, [*keys, "of_epoch"]).where((F.col("period") < F.col("of")) & alive).select(*keys, *opened)
    older = of_epoch.join(wanted, keys).where((F.col("epoch") < F.col("of_epoch")) & alive).select(*keys, *opened)
    snapshots = recent.unionByName(older)

    rows = log.where("wanted").select(*keys, "period", "kind", "at", *fact).unionByName(snapshots)
    in_time = Window.partitionBy(*keys, "period").orderBy("at", "kind")
    rows = rows.select((F.row_number().over(in_time) == 1).alias("first"), "kind", "at", *fact)
    kind = facts.schema["fact_id"].dataType.simpleString()
    return rows.fillna({"known_to": 0, "recorded_at": 0, "valid_from": 0}).mapInPandas(_replay, f"event_id {events.schema['event_id'].dataType.simpleString()}, fact_id {kind}")


def traces_as_known(traces: DataFrame, edges: DataFrame) -> DataFrame:
    """trace_id, edge_id: the edge of each trace's anchor and edge type that held, as known, at the trace's as_of.

    Traces without as_of, anchor, edge type or id give no row; a trace delivered twice gives one.
    """
    events = traces.select("run_id", clean_id("anchor_id").alias("from_id"), "edge_type", clean_id("trace_id").alias("event_id"), seconds("as_of").alias("at")).where("event_id is not null")
    facts = known_spans(edges).withColumnRenamed("edge_id", "fact_id")
    return as_known(events, facts, ["run_id", "from_id", "edge_type"]).toDF("trace_id", "edge_id").distinct()
