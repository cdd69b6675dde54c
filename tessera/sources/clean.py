"""The run-store tables with ids cleaned and repeated deliveries taken as one row of the earliest time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runstore import clean_id, table

#: Per table: key columns, arrival time, and columns that hold ids.
RULES = {
    "tasks": (("run_id", "task_id"), "registered_at", ("task_id",)),
    "source_episodes": (("run_id", "episode_id"), "retrieved_at", ("episode_id", "supersedes_episode_id")),
    "graph_nodes": (("run_id", "node_id"), "created_at", ("node_id",)),
    "graph_edges": (("run_id", "edge_id"), "recorded_at", ("edge_id", "from_id", "to_id", "source_episode_id", "supersedes_edge_id")),
    "retrieval_traces": (("trace_id",), "created_at", ("trace_id", "anchor_id")),
    "fusion_proposals": (("proposal_id",), "created_at", ("proposal_id", "left_id", "right_id", "canonical_id")),
    "claim_verifications": (("decision_id",), "created_at", ("decision_id", "claim_id")),
    "task_dependencies": (("run_id", "task_id", "depends_on"), "registered_at", ("task_id", "depends_on")),
}


def once(df: DataFrame, keys: tuple[str, ...], arrival: str) -> DataFrame:
    """One row per key: the first to arrive (rows without arrival time last)."""
    w = Window.partitionBy(*keys).orderBy(F.col(arrival).asc_nulls_last())
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def cleaned(spark: SparkSession, sf_dir: str, name: str, where: Column | None = None) -> DataFrame:
    """The rows of a table, each once. where: a condition on columns in which deliveries of a row agree (any but ids and the
    arrival time); it reaches the scan, before rows are brought together."""
    keys, arrival, ids = RULES[name]
    df = table(spark, sf_dir, name)
    if where is not None:
        df = df.where(where)
    return once(df.withColumns({c: clean_id(c) for c in ids}), keys, arrival)


def cleaned_sql(name: str, columns: list[str]) -> str:
    """The same as a SQL query (DuckDB) of the named columns."""
    keys, arrival, ids = RULES[name]
    text = lambda c: f"nullif(lower(trim({c}, ' \t\r\n')), '') as {c}" if c in ids else c
    inner = sorted({*columns, *keys, arrival})
    return f"(select {', '.join(columns)} from (select {', '.join(text(c) for c in inner)} from {name}) qualify row_number() over (partition by {', '.join(keys)} order by {arrival} nulls last) = 1)"
