"""Queries of the training-data problems, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.runstore import table
from . import consolidation, entity_match, leakage, packing, quality, sql

Query = Callable[[SparkSession, str], DataFrame]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of every group of linked nodes."""
    return consolidation.consolidate(table(spark, d, "fusion_proposals"))


def p4_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Size of every group."""
    return consolidation.group_sizes(p4_found(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of nodes that describe the same thing."""
    return entity_match.matches(table(spark, d, "graph_nodes")).select("left_node_id", "right_node_id").distinct()


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs with their type and confidence."""
    return entity_match.matches(table(spark, d, "graph_nodes"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have to be divided, per budget."""
    return packing.divided(packing.pack(table(spark, d, "documents"), table(spark, d, "token_budgets")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document and piece."""
    return packing.pack(table(spark, d, "documents"), table(spark, d, "token_budgets"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and unused share of each budget."""
    return packing.fill(p7_containers(spark, d), table(spark, d, "token_budgets"))


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    """What the containers of each budget hold, and how many hold too much."""
    return packing.totals(p7_containers(spark, d), table(spark, d, "token_budgets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the test items they give away."""
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked stretch with its place in the passage and in the original text."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents per leaked item, and its longest stretch."""
    return leakage.item_report(p8_spans(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are no prose."""
    return quality.not_prose(table(spark, d, "documents"))


def p9_published(spark: SparkSession, d: str) -> DataFrame:
    """The statistics that the published rules are stated for."""
    return quality.published_stats(table(spark, d, "documents"))


def p9_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics, label and failed rules of every document."""
    return quality.quality(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p4_found, p4_sizes, p6_found, p6_matches, p7_found, p7_containers, p7_fill, p7_totals, p8_found, p8_spans, p8_items, p9_found, p9_published, p9_stats)}
SQL: dict[str, str] = {"p4_found": sql.P4_FOUND, "p4_sizes": sql.P4_SIZES, "p7_found": sql.P7_FOUND, "p7_totals": sql.P7_TOTALS, "p9_published": sql.P9_PUBLISHED}
