"""Queries of the core's general problems over the run-store tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import as_known, hierarchy, orphans, periods
from ..sources.runstore import table
from . import sql

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that wait for themselves."""
    return hierarchy.tasks_in_cycles(table(spark, d, "task_dependencies"))


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth and root of every task."""
    return hierarchy.task_paths(table(spark, d, "task_dependencies"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All tasks below each task."""
    return hierarchy.task_descendants(table(spark, d, "task_dependencies"))


def p1_back_edges(spark: SparkSession, d: str) -> DataFrame:
    """The links that close cycles."""
    return hierarchy.back_edges(table(spark, d, "task_dependencies"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The edge each trace should have seen."""
    return as_known.traces_as_known(table(spark, d, "retrieval_traces"), table(spark, d, "graph_edges"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between the periods of each subject and edge type."""
    return periods.edge_gaps(table(spark, d, "graph_edges"))


def p3_periods(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods of each subject and edge type."""
    return periods.edge_continuous_periods(table(spark, d, "graph_edges"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    references = orphans.run_store_deliveries(t("task_dependencies"), t("graph_edges"), t("claim_verifications"))
    return orphans.orphans(references, orphans.run_store_parents(t("tasks"), t("source_episodes"), t("graph_nodes")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """References without a record."""
    return _orphans(spark, d).select("table_name", "run_id", "row_id", "ref_id").distinct()


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """References without a record, per table, run, month and reason."""
    return orphans.orphan_counts(_orphans(spark, d))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p1_back_edges, p2_found, p3_found, p3_periods, p5_found, p5_counts)}
SQL: dict[str, str] = {
    "p1_found": sql.P1_FOUND,
    "p1_descendants": sql.P1_DESCENDANTS,
    "p1_hierarchy": sql.P1_HIERARCHY,
    "p1_back_edges": sql.P1_BACK_EDGES,
    "p2_found": sql.P2_FOUND,
    "p3_found": sql.P3_FOUND,
    "p3_periods": sql.P3_PERIODS,
    "p5_found": sql.P5_FOUND,
    "p5_counts": sql.P5_COUNTS,
}
