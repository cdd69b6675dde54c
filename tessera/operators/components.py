"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Pointer jumps between two tests whether anything still changes.
JUMPS = 3


def _root_all(parent: DataFrame, keys: list[str]) -> DataFrame:
    """Follow (*keys, node, up) pointers to their roots by pointer jumping; roots themselves have no row."""
    while True:
        for _ in range(JUMPS):
            above = parent.select(*keys, F.col("node").alias("up"), F.col("up").alias("above"))
            parent = parent.join(above, [*keys, "up"], "left").select(*keys, "node", F.coalesce("above", "up").alias("up"), F.col("above").isNotNull().alias("moved"))
        parent = cut(parent)
        if parent.where("moved").isEmpty():
            return parent.select(*keys, "node", "up")
        parent = parent.select(*keys, "node", "up")


def connected_components(links: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """*keys, member, component: every node that has a link to another one, with the smallest node of its component.

    links are undirected and may repeat, in either direction. Links with a null end or key, and links of a node with
    itself, count for nothing. Components never leave their key (a run, say).

    Each round, every node hooks to the smallest of its neighbours that is smaller than itself (a grouped minimum, so hubs
    are pre-aggregated before the shuffle), pointer jumping turns the hooks into stars, and links between stars remain for
    the next round; the round's tables are checkpointed. It ends when no link remains, after O(log n) rounds, whatever the
    shape: stars need one round, chains log(n) jumps.
    """
    a, b = F.col(left), F.col(right)
    link = links.select(*keys, F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), a.isNotNull().alias("_l"), b.isNotNull().alias("_r"))
    link = link.where("_l and _r and hi > lo" + "".join(f" and `{k}` is not null" for k in keys)).select(*keys, "hi", "lo").distinct()
    link = cut(link)
    label: DataFrame | None = None
    while True:
        hooks = link.groupBy(*keys, F.col("hi").alias("node")).agg(F.min("lo").alias("up"))
        root = _root_all(hooks, keys)
        if label is None:
            nodes = link.select(*keys, F.explode(F.array("hi", "lo")).alias("member")).distinct()
            label = nodes.join(root.withColumnRenamed("node", "member"), [*keys, "member"], "left").select(*keys, "member", F.coalesce("up", "member").alias("component"))
        else:
            label = label.join(root.withColumnRenamed("node", "component"), [*keys, "component"], "left").select(*keys, "member", F.coalesce("up", "component").alias("component"))
        up = lambda c: root.select(*keys, F.col("node").alias(c), F.col("up").alias(f"{c}_up"))
        moved = link.join(up("hi"), [*keys, "hi"], "left").join(up("lo"), [*keys, "lo"], "left")
        ends = moved.select(*keys, F.coalesce("hi_up", "hi").alias("a"), F.coalesce("lo_up", "lo").alias("b"))
        link = cut(ends.where("a <> b").select(*keys, F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
        label = cut(label)
        if link.isEmpty():
            return label
