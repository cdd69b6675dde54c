"""Parent-child links to whole hierarchies: path, depth, root and descendants of every node, and the cycles.

Method: connected components co-locate what belongs together; a depth-first search with node colouring finds the cycles
of each component and a search by levels its paths, streaming through sorted partitions. The components of a run that one
task can hold are found in that task; those of larger runs by minimum labels and pointer jumping over the cluster, and of
these only components of more than `component_links` links never enter one task: they are worked on by the whole cluster
(`cyclic_groups`, and level-wise paths). Paths and back edges are defined without the order of a search, so all ways give
the same results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.runstore import clean_id
from .components import connected_components

#: The most links that one task walks at once (some 150 MB in Python).
COMPONENT_LINKS = 200_000
#: Elements of paths that a task holds before it hands them on.
PATH_ELEMENTS = 200_000
#: The most large runs whose names are sent to all tasks.
MOST_BROADCAST_RUNS = 100_000
WHITE, GREY, BLACK = 0, 1, 2


def links_of(dependencies: DataFrame) -> DataFrame:
    """run_id, child, parent (null: none given) of task_dependencies, ids cleaned."""
    return dependencies.select("run_id", clean_id("task_id").alias("child"), clean_id("depends_on").alias("parent")).where("run_id is not null and child is not null")


def walk(children: dict[str, list[str]], nodes: list[str]) -> dict[str, str]:
    """Depth-first search with node colouring: the nodes on cycles, each with the greatest node of its strongly connected
    group (a node that only names itself is a group of its own)."""
    colour = dict.fromkeys(nodes, WHITE)
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    open_nodes: list[str] = []
    is_open: set[str] = set()
    cyclic: dict[str, str] = {}
    for start in nodes:
        if colour[start] != WHITE:
            continue
        stack = [(start, iter(children.get(start, ())))]
        colour[start], order[start], low[start] = GREY, len(order), len(order)
        open_nodes.append(start)
        is_open.add(start)
        while stack:
            node, rest = stack[-1]
            for child in rest:
                if colour[child] == WHITE:
                    colour[child], order[child], low[child] = GREY, len(order), len(order)
                    open_nodes.append(child)
                    is_open.add(child)
                    stack.append((child, iter(children.get(child, ()))))
                    break
                if child == node:
                    cyclic[node] = node
                if child in is_open:
                    low[node] = min(low[node], order[child])
            else:
                stack.pop()
                colour[node] = BLACK
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[node])
                if low[node] == order[node]:
                    group = []
                    while True:
                        other = open_nodes.pop()
                        is_open.discard(other)
                        group.append(other)
                        if other == node:
                            break
                    if len(group) > 1:
                        cyclic.update(dict.fromkeys(group, max(group)))
    return cyclic


def levels(children: dict[str, list[str]], roots: list[str], cyclic: Iterable[str]) -> tuple[dict[str, str | None], dict[str, int]]:
    """Search by levels: via (the node before each on its path; None at a start) and depth of every node, in the order of
    (start, depth, path). From all roots at once, each node gets the smallest of its shortest paths; then the nodes on
    cycles that are left start one by one, from the smallest."""
    via: dict[str, str | None] = {}
    depth: dict[str, int] = {}
    for starts in [roots, *([x] for x in sorted(cyclic))]:
        todo = [x for x in starts if x not in via]
        for x in todo:
            via[x], depth[x] = None, 0
        # a level in the order of its paths leaves the next one in that order: the first to find a node is its smallest way
        while todo:
            fresh = []
            for node in todo:
                for child in children.get(node, ()):
                    if child not in via:
                        via[child], depth[child] = node, depth[node] + 1
                        fresh.append(child)
            todo = fresh
    return via, depth


def _split(links: list[tuple[str, str | None]]) -> Iterator[list[tuple[str, str | None]]]:
    """The links of each connected component, repeats once."""
    up: dict[str, str] = {}

    def root(x: str) -> str:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for child, parent in links:
        a = root(child)
        if parent is not None and (b := root(parent)) != a:
            up[max(a, b)] = min(a, b)
    parts: dict[str, list[tuple[str, str | None]]] = {}
    for link in dict.fromkeys(links):
        parts.setdefault(root(link[0]), []).append(link)
    yield from parts.values()


def component_groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[tuple[str, str | None]]]]:
    """run_id and links of each connected component, from batches sorted by run_id and component; where no component is
    named, the run's links are split here."""

    def told(key: tuple[str, str | None], links: list) -> Iterator[tuple[str, list]]:
        for part in _split(links) if key[1] is None else [list(dict.fromkeys(links))]:
            yield key[0], part

    key, links = None, []
    for pdf in batches:
        for run, component, child, parent in zip(pdf["run_id"].tolist(), pdf["component"].tolist(), pdf["child"].tolist(), pdf["parent"].tolist(), strict=True):
            if (run, component) != key:
                if key:
                    yield from told(key, links)
                key, links = (run, component), []
            links.append((child, parent))
    if key:
        yield from told(key, links)


def _children(links: list[tuple[str, str | None]]) -> tuple[dict[str, list[str]], list[str], list[str]]:
    children: dict[str, list[str]] = {}
    nodes, has_parent = set(), set()
    for child, parent in links:
        nodes.add(child)
        if parent is not None:
            nodes.add(parent)
            has_parent.add(child)
            children.setdefault(parent, []).append(child)
    for own in children.values():
        own.sort()
    return children, sorted(nodes - has_parent), sorted(nodes)


def _cycles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for run, links in component_groups(batches):
        children, _, nodes = _children(links)
        cyclic = walk(children, nodes)
        if cyclic:
            yield pd.DataFrame({"run_id": run, "task_id": sorted(cyclic)})


def _back_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for run, links in component_groups(batches):
        children, roots, nodes = _children(links)
        group = walk(children, nodes)
        if not group:
            continue
        via, _ = levels(children, roots, group)
        place = {node: i for i, node in enumerate(via)}  # a group has one start, so this is the order of (depth, path)
        back = [(a, b) for a in sorted(group) for b in children.get(a, ()) if group.get(b) == group[a] and place[b] <= place[a]]
        if back:
            yield pd.DataFrame({"run_id": run, "from_id": [a for a, _ in back], "to_id": [b for _, b in back]})


def _paths(batches: Iterator[pd.DataFrame], most: int = PATH_ELEMENTS) -> Iterator[pd.DataFrame]:
    for run, links in component_groups(batches):
        children, roots, nodes = _children(links)
        cyclic = walk(children, nodes)
        via, depth = levels(children, roots, cyclic)
        rows: list[tuple] = []
        elements = 0
        for node in via:
            path, up = [node], via[node]
            while up is not None:
                path.append(up)
                up = via[up]
            path.reverse()
            rows.append((run, node, path[0], depth[node], path, node in cyclic))
            elements += len(path) + 10
            if elements >= most:
                yield pd.DataFrame(rows, columns=PATH_COLUMNS)
                rows, elements = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=PATH_COLUMNS)


def _descendants(batches: Iterator[pd.DataFrame], most: int = 50_000) -> Iterator[pd.DataFrame]:
    for run, links in component_groups(batches):
        children, _, nodes = _children(links)
        rows: list[tuple] = []
        for node in nodes:
            seen, todo = set(), list(children.get(node, ()))
            while todo:
                below = todo.pop()
                if below not in seen:
                    seen.add(below)
                    todo.extend(children.get(below, ()))
            rows.extend((run, node, below) for below in sorted(seen))
            if len(rows) >= most:
                yield pd.DataFrame(rows, columns=["run_id", "task_id", "descendant_id"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["run_id", "task_id", "descendant_id"])


PATH_COLUMNS = ["run_id", "task_id", "root_id", "depth", "path", "in_cycle"]
PATH_SCHEMA = "run_id string, task_id string, root_id string, depth int, path array<string>, in_cycle boolean"


def co_located(links: DataFrame, component_links: int) -> tuple[DataFrame, DataFrame | None]:
    """links with their component (null for all of a run that one task can hold), each component's sorted together; and
    the links of components too large for a task (None if there are none)."""
    links = links.select("run_id", "child", "parent")
    together = lambda df: df.repartition("run_id", "component").sortWithinPartitions("run_id", "component")
    none = F.lit(None).cast("string").alias("component")
    runs = cut(links.groupBy("run_id").agg(F.count("*").alias("links")).where(F.col("links") > component_links).select("run_id"))
    many = runs.count()
    if not many:
        return together(links.select("run_id", none, "child", "parent")), None
    runs = F.broadcast(runs) if many <= MOST_BROADCAST_RUNS else runs
    whole = links.join(runs, "run_id", "left_anti").select("run_id", none, "child", "parent")
    rest = links.join(runs, "run_id", "left_semi").distinct()
    label = connected_components(rest.where("parent is not null and parent <> child"), ["run_id"], "child", "parent")
    named = rest.join(label.withColumnRenamed("member", "child"), ["run_id", "child"], "left").withColumn("component", F.coalesce("component", "child"))
    named = cut(named.select("run_id", "component", "child", "parent"))
    large = cut(named.groupBy("run_id", "component").agg(F.count("*").alias("links")).where(F.col("links") > component_links).select("run_id", "component"))
    small = whole.unionByName(named.join(large, ["run_id", "component"], "left_anti"))
    return together(small), None if large.isEmpty() else named.join(large, ["run_id", "component"], "left_semi")


def _contract_chains(left: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Replace each chain of nodes with one parent and one child by a link between its ends, by pointer jumping.

    The remaining links (a chain that leads back to where it began leaves a link of a node with itself); run_id, node, top,
    bottom of the nodes left out; run_id, task_id, group_id of cycles that are nothing but a chain. None if no node has one
    parent and one child."""
    ends = left.select("run_id", F.col("child").alias("node"), F.col("parent").alias("above"), F.lit(None).cast("string").alias("below"))
    ends = ends.unionByName(left.select("run_id", F.col("parent").alias("node"), F.lit(None).cast("string").alias("above"), F.col("child").alias("below")))
    degree = ends.groupBy("run_id", "node").agg(F.count("above").alias("up"), F.count("below").alias("down"), F.max("above").alias("above"), F.max("below").alias("below"))
    chain = cut(degree.where("up = 1 and down = 1").select("run_id", "node", "above", "below"))
    size = chain.count()
    if not size:
        return None
    inner = chain.select("run_id", F.col("node").alias("above"))
    pointer = cut(chain.join(inner, ["run_id", "above"], "left_semi").select("run_id", "node", F.col("above").alias("to"), F.greatest("node", "above").alias("most"), F.lit(True).alias("moved")))
    span = 1
    while span <= size and not pointer.where("moved").isEmpty():
        further = pointer.select("run_id", F.col("node").alias("to"), F.col("to").alias("further"), F.col("most").alias("further_most"))
        jumped = pointer.join(further, ["run_id", "to"], "left")
        pointer = cut(jumped.select("run_id", "node", F.coalesce("further", "to").alias("to"), F.greatest("most", "further_most").alias("most"), F.col("further").isNotNull().alias("moved")))
        span *= 2
    # what still moves after more steps than there are nodes goes round in a circle
    circles = pointer.where("moved").select("run_id", F.col("node").alias("task_id"), F.col("most").alias("group_id"))
    head = chain.join(pointer.select("run_id", "node", "to", "moved"), ["run_id", "node"], "left").where("moved is null or not moved").select("run_id", "node", "above", "below", F.coalesce("to", "node").alias("head"))
    head = cut(head)
    top = head.where("node = head").select("run_id", "head", F.col("above").alias("top"))
    is_chain = chain.select("run_id", F.col("node").alias("below"))
    bottom = head.join(is_chain, ["run_id", "below"], "left_anti").select("run_id", "head", F.col("below").alias("bottom"))
    spans = cut(top.join(bottom, ["run_id", "head"]))
    left_out = head.select("run_id", "node", "head").join(spans, ["run_id", "head"]).select("run_id", "node", "top", "bottom")
    gone = chain.select("run_id", "node")
    kept = left.join(gone.withColumnRenamed("node", "child"), ["run_id", "child"], "left_anti").join(gone.withColumnRenamed("node", "parent"), ["run_id", "parent"], "left_anti")
    links = kept.unionByName(spans.select("run_id", F.col("bottom").alias("child"), F.col("top").alias("parent"))).distinct()
    return cut(links), cut(left_out), cut(circles)


def _strip(left: DataFrame) -> DataFrame:
    """The links whose child has a child and whose parent has a parent: all others are on no cycle."""
    kept = left.join(left.select("run_id", F.col("child").alias("parent")).distinct(), ["run_id", "parent"], "left_semi")
    return cut(kept.join(kept.select("run_id", F.col("parent").alias("child")).distinct(), ["run_id", "child"], "left_semi"))


def cyclic_groups(links: DataFrame) -> DataFrame:
    """run_id, task_id, group_id (the greatest node of its strongly connected group) of the nodes on cycles of (run_id,
    child, parent), by the whole cluster, for any component size.

    Nodes without a remaining parent or child are stripped and chains contracted by pointer jumping, in turn, so trees and
    chains take a logarithm of rounds; of the rest, the greatest label that reaches each node colours it, and going back
    from where a colour began gives one strongly connected group per colour and round. Nodes of contracted chains are in
    the group of their ends, if that is one.
    """
    as_own = lambda df: df.select("run_id", F.col("child").alias("task_id"), F.col("child").alias("group_id"))
    found = [as_own(links.where("child = parent")).distinct()]
    left = cut(links.where("parent is not null and child <> parent").select("run_id", "child", "parent").distinct())
    chains: list[DataFrame] = []
    while True:
        size, before = left.count(), -1
        while size and size != before:
            left = _strip(left)
            rest = left.count()
            contracted = _contract_chains(left) if 2 * rest > size else None  # as long as stripping halves them, it is quicker
            if contracted:
                left, chain, circles = contracted
                chains.append(chain)
                found += [circles, as_own(left.where("child = parent"))]
                left = cut(left.where("child <> parent"))
            before, size = size, left.count()
        if not size:
            break
        colour = cut(left.select("run_id", F.explode(F.array("child", "parent")).alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            sent = left.join(colour.withColumnRenamed("node", "parent"), ["run_id", "parent"]).groupBy("run_id", F.col("child").alias("node")).agg(F.max("colour").alias("sent"))
            colour = cut(colour.join(sent, ["run_id", "node"], "left").select("run_id", "node", F.greatest("colour", "sent").alias("colour"), F.coalesce(F.col("sent") > F.col("colour"), F.lit(False)).alias("moved")))
            if colour.where("moved").isEmpty():
                break
            colour = colour.drop("moved")
        colour = colour.drop("moved")
        same = cut(
            left.join(colour.select("run_id", F.col("node").alias("child"), "colour"), ["run_id", "child"])
            .join(colour.select("run_id", F.col("node").alias("parent"), F.col("colour").alias("other")), ["run_id", "parent"])
            .where("colour = other")
            .select("run_id", "child", "parent", "colour")
        )
        group = cut(colour.where("node = colour").select("run_id", "node"))
        fresh = group
        while True:
            more = same.join(fresh.withColumnRenamed("node", "child"), ["run_id", "child"]).select("run_id", F.col("parent").alias("node")).distinct()
            fresh = cut(more.join(group, ["run_id", "node"], "left_anti"))
            if fresh.isEmpty():
                break
            group = cut(group.unionByName(fresh))
        in_group = group.withColumnRenamed("node", "child")
        cyclic = cut(same.join(in_group, ["run_id", "child"], "left_semi").join(group.withColumnRenamed("node", "parent"), ["run_id", "parent"], "left_semi"))
        found.append(cyclic.select("run_id", F.col("child").alias("task_id"), F.col("colour").alias("group_id")).distinct())
        left = cut(left.join(in_group, ["run_id", "child"], "left_anti").join(group.withColumnRenamed("node", "parent"), ["run_id", "parent"], "left_anti"))
    out = reduce(DataFrame.unionByName, found)
    # a node that also names itself, or begins and ends a chain, is in its larger group: the colour is the greatest node of it
    out = cut(out.groupBy("run_id", "task_id").agg(F.max("group_id").alias("group_id")))
    for chain in reversed(chains):
        end = lambda name: out.select("run_id", F.col("task_id").alias(name), F.col("group_id").alias(f"{name}_group"))  # noqa: B023, E731
        inside = chain.join(end("top"), ["run_id", "top"]).join(end("bottom"), ["run_id", "bottom"]).where("top_group = bottom_group")
        inside = cut(inside.select("run_id", F.col("node").alias("task_id"), F.col("top_group").alias("larger")))
        # a node that ends a chain which leads back to it has a group already: that group is part of the larger one
        joined = inside.join(out, ["run_id", "task_id"]).select("run_id", "group_id", "larger").distinct()
        renamed = out.join(joined, ["run_id", "group_id"], "left").select("run_id", "task_id", F.coalesce("larger", "group_id").alias("group_id"))
        out = cut(renamed.unionByName(inside.withColumnRenamed("larger", "group_id")).distinct())
    # only now are all members of a group known
    greatest = out.groupBy("run_id", "group_id").agg(F.max("task_id").alias("greatest"))
    return out.join(greatest, ["run_id", "group_id"]).select("run_id", "task_id", F.col("greatest").alias("group_id"))


def cyclic_nodes(links: DataFrame) -> DataFrame:
    """run_id, task_id of the nodes on cycles, like cyclic_groups."""
    return cyclic_groups(links).select("run_id", "task_id")


def tasks_in_cycles(dependencies: DataFrame, component_links: int = COMPONENT_LINKS) -> DataFrame:
    """run_id, task_id: the tasks from which following depends_on leads back to the same task. Tasks that only lead into
    a cycle or out of one are none; a task that names itself is one. Null, empty and blank parents are no references."""
    small, large = co_located(links_of(dependencies), component_links)
    found = small.mapInPandas(_cycles, "run_id string, task_id string")
    return found if large is None else found.unionByName(cyclic_nodes(large))


def _level_paths(links: DataFrame, cyclic: DataFrame) -> DataFrame:
    """PATH_SCHEMA rows of links too many for one task: level by level, each node found over its smallest path. Nodes
    that no root reaches start at the nodes on cycles, those one by one from the smallest. cyclic: run_id, task_id."""
    nodes = cut(links.select("run_id", F.explode(F.array("child", "parent")).alias("task_id")).where("task_id is not null").distinct())
    real = cut(links.where("parent is not null").select("run_id", F.col("parent").alias("task_id"), F.col("child").alias("next")).distinct())
    done: DataFrame | None = None
    starts = cut(nodes.join(real.select("run_id", F.col("next").alias("task_id")), ["run_id", "task_id"], "left_anti"))
    while True:
        fresh = starts.select("run_id", "task_id", F.array("task_id").alias("path"))
        while not fresh.isEmpty():
            done = cut(fresh if done is None else done.unionByName(fresh))
            step = fresh.join(real, ["run_id", "task_id"]).select("run_id", F.col("next").alias("task_id"), F.concat("path", F.array("next")).alias("path"))
            fresh = cut(step.groupBy("run_id", "task_id").agg(F.min("path").alias("path")).join(done.select("run_id", "task_id"), ["run_id", "task_id"], "left_anti"))
        left = nodes if done is None else nodes.join(done.select("run_id", "task_id"), ["run_id", "task_id"], "left_anti")
        starts = cut(left.join(cyclic, ["run_id", "task_id"], "left_semi").groupBy("run_id").agg(F.min("task_id").alias("task_id")))
        if starts.isEmpty():
            break
    flagged = done.join(cyclic.withColumn("in_cycle", F.lit(True)), ["run_id", "task_id"], "left")
    return flagged.select("run_id", "task_id", F.col("path")[0].alias("root_id"), (F.size("path") - 1).alias("depth"), "path", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))


def task_paths(dependencies: DataFrame, component_links: int = COMPONENT_LINKS) -> DataFrame:
    """run_id, task_id, root_id, depth, path, in_cycle of every task.

    The path is the shortest one from a root, and of those the smallest; a task with two parents thus has one path. Cycles
    that no root reaches start at their smallest task (if one leads to another: at the smallest not yet reached).
    """
    small, large = co_located(links_of(dependencies), component_links)
    found = small.mapInPandas(_paths, PATH_SCHEMA)
    return found if large is None else found.unionByName(_level_paths(large, cut(cyclic_nodes(large))))


def task_descendants(dependencies: DataFrame, component_links: int = COMPONENT_LINKS) -> DataFrame:
    """run_id, task_id, descendant_id: all tasks below each task (a task on a cycle is below itself)."""
    small, large = co_located(links_of(dependencies), component_links)
    found = small.mapInPandas(_descendants, "run_id string, task_id string, descendant_id string")
    if large is None:
        return found
    real = cut(large.where("parent is not null").select("run_id", F.col("parent").alias("task_id"), F.col("child").alias("descendant_id")).distinct())
    done = fresh = real
    while True:  # each round joins what is new with all that is known, so it reaches twice as far
        step = done.select("run_id", F.col("task_id").alias("descendant_id"), F.col("descendant_id").alias("next"))
        more = fresh.join(step, ["run_id", "descendant_id"]).select("run_id", "task_id", F.col("next").alias("descendant_id")).distinct()
        fresh = cut(more.join(done, ["run_id", "task_id", "descendant_id"], "left_anti"))
        if fresh.isEmpty():
            return found.unionByName(done)
        done = cut(done.unionByName(fresh))


def back_edges(dependencies: DataFrame, component_links: int = COMPONENT_LINKS) -> DataFrame:
    """run_id, from_id, to_id: the links that close a cycle: those within a strongly connected group that lead to a task
    not later in the order of (depth, path) of `task_paths`. Every cycle has one; without them no cycle is left."""
    small, large = co_located(links_of(dependencies), component_links)
    found = small.mapInPandas(_back_edges, "run_id string, from_id string, to_id string")
    if large is None:
        return found
    group = cut(cyclic_groups(large))
    path = _level_paths(large, group.select("run_id", "task_id")).where("in_cycle").select("run_id", "task_id", F.struct("depth", "path").alias("place"))
    placed = cut(group.join(path, ["run_id", "task_id"]))
    end = lambda name: placed.select("run_id", F.col("task_id").alias(name), "group_id", F.col("place").alias(f"{name}_place"))
    inner = large.select("run_id", "child", "parent").join(end("child"), ["run_id", "child"]).join(end("parent"), ["run_id", "group_id", "parent"])
    return found.unionByName(inner.where("child_place <= parent_place").select("run_id", F.col("parent").alias("from_id"), F.col("child").alias("to_id")).distinct())
