"""Searches over the graph: neighbourhoods, shortest paths, communities and levels.

Each level of a search is one join of its frontier with the links, and an anti-join with what is already known; levels are
checkpointed, and every search has a bound of hops or ends when nothing new appears.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import hierarchy
from .components import connected_components


def both_ways(edges: DataFrame) -> DataFrame:
    """run_id, node_id, edge_id, next_id: each edge from either end."""
    e = edges.where("from_id is not null and to_id is not null")
    return e.select("run_id", F.col("from_id").alias("node_id"), "edge_id", F.col("to_id").alias("next_id")).unionByName(e.select("run_id", F.col("to_id").alias("node_id"), "edge_id", F.col("from_id").alias("next_id")))


def expand(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """run_id, node_id, hop: the nodes within so many hops of the seeds (run_id, node_id), in either direction."""
    links = both_ways(edges).select("run_id", "node_id", "next_id").distinct()
    known = frontier = seeds.select("run_id", "node_id").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        reached = frontier.join(links, ["run_id", "node_id"]).select("run_id", F.col("next_id").alias("node_id")).distinct()
        frontier = cut(reached.join(known, ["run_id", "node_id"], "left_anti").withColumn("hop", F.lit(hop)))
        known = known.unionByName(frontier)
    return known


def expansion_edges(edges: DataFrame, expanded: DataFrame, hops: int) -> DataFrame:
    """run_id, edge_id, hop: the edges at nodes that were expanded (those nearer than the last hop), with the least hop."""
    near = expanded.where(F.col("hop") < hops)
    return both_ways(edges).join(near, ["run_id", "node_id"]).groupBy("run_id", "edge_id").agg((F.min("hop") + 1).alias("hop"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 3) -> DataFrame:
    """run_id, start_id, end_id, hops, path: one shortest path for each pair (run_id, start_id, end_id) within max_hops.

    path alternates nodes and edges. Of several shortest paths, the one is taken whose steps (next node, then edge) are
    smallest from the start on: what a search finds that visits neighbours in order. A pair of equal ends has a path of one
    node; pairs beyond max_hops have no row.
    """
    links = both_ways(edges).select("run_id", F.col("node_id").alias("at"), F.struct(F.col("next_id").alias("node"), F.col("edge_id").alias("edge")).alias("step"))
    pairs = cut(pairs.select("run_id", "start_id", "end_id").distinct())
    step_type = "array<struct<node:string,edge:string>>"
    known = pairs.select("run_id", "start_id").distinct().withColumns({"at": F.col("start_id"), "steps": F.array().cast(step_type)})
    frontier = known = cut(known)
    for _ in range(max_hops):
        stepped = frontier.join(links, ["run_id", "at"]).select("run_id", "start_id", F.col("step.node").alias("at"), F.concat("steps", F.array("step")).alias("steps"))
        best = stepped.groupBy("run_id", "start_id", "at").agg(F.min("steps").alias("steps"))
        frontier = cut(best.join(known, ["run_id", "start_id", "at"], "left_anti"))
        known = known.unionByName(frontier)
    found = pairs.join(known.withColumnRenamed("at", "end_id"), ["run_id", "start_id", "end_id"])
    path = F.concat(F.array("start_id"), F.flatten(F.transform("steps", lambda s: F.array(s["edge"], s["node"]))))
    return found.select("run_id", "start_id", "end_id", F.size("steps").alias("hops"), path.alias("path"))


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, community_id, members: connected components with their size; nodes without edges are their own."""
    label = connected_components(edges, ["run_id"], "from_id", "to_id")
    named = nodes.select("run_id", "node_id").distinct().join(label.withColumnRenamed("member", "node_id"), ["run_id", "node_id"], "left")
    return named.groupBy("run_id", F.coalesce("component", "node_id").alias("community_id")).agg(F.count("*").alias("members"))


def _levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for run, links in hierarchy.component_groups(batches):
        parents: dict[str, int] = {}
        below: dict[str, list[str]] = {}
        for child, parent in links:
            parents.setdefault(child, 0)
            if parent is not None:
                parents[child] += 1
                parents.setdefault(parent, 0)
                below.setdefault(parent, []).append(child)
        level: dict[str, int | None] = dict.fromkeys(parents)
        frontier, at = [n for n, waits in parents.items() if not waits], 0
        while frontier:
            nxt = []
            for node in frontier:
                level[node] = at
                for child in below.get(node, ()):
                    parents[child] -= 1
                    if not parents[child]:
                        nxt.append(child)
            frontier, at = nxt, at + 1
        yield pd.DataFrame({"run_id": run, "task_id": list(level), "level": pd.array(list(level.values()), dtype="Int32")})


def topological_levels(nodes: DataFrame, links: DataFrame, component_links: int = hierarchy.COMPONENT_LINKS) -> DataFrame:
    """run_id, task_id, level: 0 without parents, else one more than the highest parent; null on or below a cycle.

    nodes: run_id, task_id; links: run_id, task_id, depends_on. Parents that aren't among the nodes don't count. Components
    are walked one by one; those of more than component_links links are peeled level by level by the whole cluster.
    """
    there = nodes.select("run_id", "task_id").where("task_id is not null").distinct()
    real = links.select("run_id", "task_id", "depends_on").distinct().join(there, ["run_id", "task_id"], "left_semi").join(there.withColumnRenamed("task_id", "depends_on"), ["run_id", "depends_on"], "left_semi")
    named = real.select("run_id", F.col("task_id").alias("child"), F.col("depends_on").alias("parent"))
    small, large = hierarchy.co_located(named.unionByName(there.select("run_id", F.col("task_id").alias("child"), F.lit(None).cast("string").alias("parent"))), component_links)
    found = small.mapInPandas(_levels, "run_id string, task_id string, level int")
    if large is None:
        return found
    left = cut(large.where("parent is not null").select("run_id", F.col("child").alias("task_id"), F.col("parent").alias("depends_on")))
    waiting = cut(large.select("run_id", F.col("child").alias("task_id")).distinct())
    level = 0
    while True:
        free = cut(waiting.join(left, ["run_id", "task_id"], "left_anti"))
        if free.isEmpty():
            return found.unionByName(waiting.withColumn("level", F.lit(None).cast("int")))
        found = found.unionByName(free.withColumn("level", F.lit(level)))
        waiting = cut(waiting.join(free, ["run_id", "task_id"], "left_anti"))
        left = cut(left.join(free.withColumnRenamed("task_id", "depends_on"), ["run_id", "depends_on"], "left_anti"))
        level += 1
