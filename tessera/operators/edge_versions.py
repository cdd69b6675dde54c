"""Edges of the temporal graph, one row each, with what their successor says of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.runstore import clean_id, seconds


def edge_versions(edges: DataFrame) -> DataFrame:
    """One row per edge of a run, joined with the edge that supersedes it.

    Columns: run_id, edge_id, from_id, edge_type, valid_from, valid_to, recorded_at (seconds), superseded (boolean),
    next_recorded_at and next_valid_from (seconds, of the successor).

    Repeated deliveries are one edge with the earliest recorded_at. An edge that names itself is not its own successor.
    Of several successors the one recorded first counts (then the earliest valid_from; null times come last). Rows
    without run_id or edge_id are dropped: they name no edge. Any further columns are ignored.

    One shuffle on (run_id, edge_id): the edges and the notes "X is superseded by me" meet in one sorted window, so
    there is no join and no map-side sort.
    """
    own = edges.select(
        "run_id",
        clean_id("edge_id").alias("edge_id"),
        clean_id("from_id").alias("from_id"),
        "edge_type",
        seconds("valid_from").alias("valid_from"),
        seconds("valid_to").alias("valid_to"),
        seconds("recorded_at").alias("recorded_at"),
        clean_id("supersedes_edge_id").alias("target"),
    ).where("run_id is not null and edge_id is not null")
    none = F.lit(None)
    rows = own.select(*[c for c in own.columns if c != "target"], F.lit(0).alias("note")).unionByName(
        own.where("target is not null and target <> edge_id").select(
            "run_id",
            F.col("target").alias("edge_id"),
            none.cast("string").alias("from_id"),
            none.cast("string").alias("edge_type"),
            "valid_from",
            none.cast("long").alias("valid_to"),
            "recorded_at",
            F.lit(1).alias("note"),
        )
    )
    w = Window.partitionBy("run_id", "edge_id").orderBy("note", F.col("recorded_at").asc_nulls_last(), F.col("valid_from").asc_nulls_last())
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_note = F.col("note") == 1
    # the first note in window order is the successor that was recorded first
    successor = F.first(F.when(is_note, F.struct("recorded_at", "valid_from")), ignorenulls=True).over(whole)
    return (
        rows.withColumn("nth", F.row_number().over(w))
        .withColumn("successor", successor)
        .where("nth = 1 and note = 0")
        .select(
            "run_id", "edge_id", "from_id", "edge_type", "valid_from", "valid_to", "recorded_at",
            F.col("successor").isNotNull().alias("superseded"),
            F.col("successor.recorded_at").alias("next_recorded_at"),
            F.col("successor.valid_from").alias("next_valid_from"),
        )
    )
