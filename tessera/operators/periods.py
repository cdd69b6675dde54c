"""Continuous periods and gaps of overlapping, nested and broken-off intervals.

Method: time is cut into exact seconds and those into shards. Each entity has one compressed bitmap per shard it touches,
kept as runs of set seconds; shards that an interval covers from end to end are not listed second by second but as runs
of whole shards in the entity's directory. Bitmaps are united shard by shard, so a hot entity spreads over as many tasks
as it has shards; only one small row per shard (first and last set second) and the directory meet per entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.runstore import iso
from .edge_versions import edge_versions

#: Seconds of one shard (about twelve days): the most runs one bitmap can hold is half of it.
SHARD_SECONDS = 1 << 20
#: The end of an interval that is open.
FOREVER = (1 << 62) // SHARD_SECONDS * SHARD_SECONDS


def edge_periods(edges: DataFrame) -> DataFrame:
    """run_id, from_id, edge_type, lo, hi (seconds, half open; hi is FOREVER where the period is open) of each edge.

    The period runs from valid_from to the earlier of valid_to and the successor's valid_from; edges without valid_from
    or with an empty period give no row.
    """
    return (
        edge_versions(edges)
        .select(
            "run_id", "from_id", "edge_type",
            F.col("valid_from").alias("lo"),
            F.coalesce(F.least("valid_to", "next_valid_from"), F.lit(FOREVER)).alias("hi"),
        )
        .where("lo < hi")
    )


def run_bitmaps(intervals: DataFrame, keys: list[str], shard_seconds: int = SHARD_SECONDS) -> tuple[DataFrame, DataFrame]:
    """The united bitmaps of (*keys, lo, hi) rows.

    Returns containers (*keys, shard, runs array<struct<lo,hi>> in absolute seconds, sorted, disjoint, not touching) and
    the directory (*keys, shard, upto): all shards from shard up to, not including, upto are full.
    """
    w = shard_seconds
    first, last = F.floor(F.col("lo") / w), F.floor((F.col("hi") - 1) / w)
    cut = intervals.where("lo < hi").select(*keys, "lo", "hi", first.alias("first"), last.alias("last"))
    piece = lambda shard, lo, hi: F.struct(shard.cast("long").alias("shard"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    head = piece(F.col("first"), F.col("lo"), F.least("hi", (F.col("first") + 1) * w))
    tail = F.when((F.col("last") > F.col("first")) & (F.col("hi") < FOREVER), piece(F.col("last"), F.col("last") * w, F.col("hi")))
    pieces = cut.select(*keys, F.explode(F.filter(F.array(head, tail), lambda p: p.isNotNull())).alias("p")).select(*keys, "p.*")
    by_shard = Window.partitionBy(*keys, "shard").orderBy("lo", "hi")
    before = F.max("hi").over(by_shard.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        pieces.withColumn("starts", F.when(before >= F.col("lo"), 0).otherwise(1))
        .withColumn("run", F.sum("starts").over(by_shard.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "shard", "run")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    containers = runs.groupBy(*keys, "shard").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    upto = F.when(F.col("hi") >= FOREVER, FOREVER // w).otherwise(F.col("last"))
    directory = (
        cut.where(upto > F.col("first") + 1)
        .groupBy(*keys, (F.col("first") + 1).cast("long").alias("shard"))
        .agg(F.max(upto).cast("long").alias("upto"))
    )
    return containers, directory


def _spans(containers: DataFrame, directory: DataFrame, keys: list[str], w: int) -> DataFrame:
    """Per entity, in order of time: each shard's first and last set second and each directory run, with `before` (the
    latest set second so far) and `full` (the shard lies in a run of full shards)."""
    rows = containers.select(
        *keys, "shard", F.lit(1).alias("kind"), F.col("runs")[0]["lo"].alias("lo"), F.element_at("runs", -1)["hi"].alias("hi"), F.lit(None).cast("long").alias("upto")
    ).unionByName(directory.select(*keys, "shard", F.lit(0).alias("kind"), (F.col("shard") * w).alias("lo"), F.when(F.col("upto") >= FOREVER // w, FOREVER).otherwise(F.col("upto") * w).alias("hi"), "upto"))
    order = Window.partitionBy(*keys).orderBy("shard", "kind")
    return rows.withColumns({
        "before": F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "full": F.coalesce(F.max("upto").over(order.rowsBetween(Window.unboundedPreceding, 0)) > F.col("shard"), F.lit(False)),
    })




def _outside_full(containers: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """The containers whose shard isn't covered as a whole by a directory run."""
    # lo < hi holds always; with it this reads the same columns as the other branch, and Spark shuffles once for both
    full = spans.where("kind = 1 and full and lo < hi").select(*[F.col(k).alias(f"f_{k}") for k in keys], F.col("shard").alias("f_shard"))
    on = F.col("shard") == F.col("f_shard")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"f_{k}"))
    return containers.join(full, on, "left_anti")


def gaps(intervals: DataFrame, keys: list[str], shard_seconds: int = SHARD_SECONDS) -> DataFrame:
    """*keys, lo, hi: each clear run between two set runs of an entity.

    Touching intervals leave no gap; before the first and after the last period nothing is a gap. Null keys are a key
    like any other. Empty input gives no rows; repeated intervals change nothing.
    """
    containers, directory = run_bitmaps(intervals, keys, shard_seconds)
    spans = _spans(containers, directory, keys, shard_seconds)
    between = spans.where("before is not null and lo > before and (kind = 0 or not full)").select(*keys, F.col("before").alias("lo"), F.col("lo").alias("hi"))
    broken = containers.where(F.size("runs") > 1).select(*keys, "shard", "runs")
    clear = lambda i: F.struct(F.get("runs", i - 1)["hi"].alias("lo"), F.get("runs", i)["lo"].alias("hi"))
    inner = _outside_full(broken, spans, keys).select(*keys, F.inline(F.transform(F.sequence(F.lit(1), F.size("runs") - 1), clear)))
    return between.unionByName(inner)


def periods(intervals: DataFrame, keys: list[str], shard_seconds: int = SHARD_SECONDS) -> DataFrame:
    """*keys, lo, hi: the continuous periods of each entity, overlaps merged; hi is null where the period is open.

    Set runs inside a shard are periods as they stand; only runs that touch a border of their shard, and the directory,
    are stitched per entity (at most two rows per shard, and one of the directory).
    """
    w = shard_seconds
    containers, directory = run_bitmaps(intervals, keys, w)
    spans = _spans(containers, directory, keys, w)
    runs = _outside_full(containers, spans, keys).select(*keys, "shard", F.inline("runs"))
    at_border = (F.col("lo") == F.col("shard") * w) | (F.col("hi") == (F.col("shard") + 1) * w)
    upto = F.when(F.col("upto") >= FOREVER // w, FOREVER).otherwise(F.col("upto") * w)
    stitch = runs.where(at_border).select(*keys, "lo", "hi").unionByName(directory.select(*keys, (F.col("shard") * w).alias("lo"), upto.alias("hi")))
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    stitched = (
        stitch.withColumn("starts", F.when(before >= F.col("lo"), 0).otherwise(1))
        .withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "run")
        .agg(F.min("lo").alias("lo"), F.nullif(F.max("hi"), F.lit(FOREVER)).alias("hi"))
        .drop("run")
    )
    return stitched.unionByName(runs.where(~at_border).select(*keys, "lo", "hi"))


EDGE_KEY = ["run_id", "from_id", "edge_type"]


def edge_gaps(edges: DataFrame) -> DataFrame:
    """run_id, from_id, edge_type, gap_from, gap_to (text) of the temporal graph."""
    return gaps(edge_periods(edges), EDGE_KEY).select(*EDGE_KEY, iso(F.col("lo")).alias("gap_from"), iso(F.col("hi")).alias("gap_to"))


def edge_continuous_periods(edges: DataFrame) -> DataFrame:
    """run_id, from_id, edge_type, period_from, period_to (text; null where open) of the temporal graph."""
    return periods(edge_periods(edges), EDGE_KEY).select(*EDGE_KEY, iso(F.col("lo")).alias("period_from"), iso(F.col("hi")).alias("period_to"))
