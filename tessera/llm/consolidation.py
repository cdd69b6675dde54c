"""Consolidating pairwise matches into groups, over any number of pairs.

Method: minimum labels travel along the links, pointer jumping shortens their way, and every round is checkpointed until
no label changes (see operators.components).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..sources.runstore import clean_id

#: Decisions that accept a proposal.
ACCEPTED = ("auto_merge", "review-approved")


def accepted_links(proposals: DataFrame) -> DataFrame:
    """run_id, left_id, right_id of the proposals that are accepted and not taken back, ids cleaned, repeats once.

    canonical_id is a local choice and plays no part. Null ids link nothing.
    """
    taken = proposals.where(F.col("decision").isin(*ACCEPTED) & F.col("reversed_at").isNull())
    return taken.select("run_id", clean_id("left_id").alias("left_id"), clean_id("right_id").alias("right_id"))


def consolidate(proposals: DataFrame) -> DataFrame:
    """run_id, group_id, member_id: the members of every group of two or more nodes; group_id is the smallest member."""
    groups = connected_components(accepted_links(proposals), ["run_id"], "left_id", "right_id")
    return groups.select("run_id", F.col("component").alias("group_id"), F.col("member").alias("member_id"))


def group_sizes(groups: DataFrame) -> DataFrame:
    """run_id, group_id, members: the size of each group."""
    return groups.groupBy("run_id", "group_id").agg(F.count("*").alias("members"))
