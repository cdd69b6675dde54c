"""The bitemporal graph: identity, integrity, slices, supersession and conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import loose_id, stable_id
from ..sources.runstore import seconds

#: Edge types of the causal subgraph.
CAUSAL = ("CAUSES", "TRIGGERS", "PRECEDES", "ENABLES")


def node_ids(nodes: DataFrame) -> DataFrame:
    """nodes with stable_id derived from type and semantic key (columns node_type, semantic_key), whatever the run."""
    return nodes.withColumn("stable_id", stable_id("node", F.col("node_type"), F.col("semantic_key")))


def edge_ids(edges: DataFrame) -> DataFrame:
    """edges with stable_id over what makes an edge: run, type, ends, validity, source and provenance."""
    parts = ["run_id", "edge_type", "from_id", "to_id", "valid_from", "valid_to", "source_episode_id", "provenance_json"]
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") if c.startswith("valid_") else F.col(c)
    return edges.withColumn("stable_id", stable_id("edge", *[text(c) for c in parts]))


def record_ids(records: DataFrame, prefix: str, *parts: str) -> DataFrame:
    """records with the shorter id of the older format, over parts in lower case with single blanks."""
    return records.withColumn("stable_id", loose_id(prefix, *[F.col(p) for p in parts]))


def node_conflicts(nodes: DataFrame) -> DataFrame:
    """node_id, versions: node ids that come with different data."""
    return nodes.groupBy("node_id").agg(F.count_distinct("data_json").cast("long").alias("versions")).where("versions > 1")


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, edge_id, problem: edges whose ends are missing (missing_from, missing_to) or that end before they begin."""
    there = nodes.select("run_id", F.col("node_id").alias("end_id")).distinct()
    parts = [
        edges.withColumnRenamed(end, "end_id").join(there, ["run_id", "end_id"], "left_anti").select("run_id", "edge_id", F.lit(f"missing_{end[:-3]}").alias("problem"))
        for end in ("from_id", "to_id")
    ]
    parts.append(edges.where("valid_to <= valid_from").select("run_id", "edge_id", F.lit("empty_validity").alias("problem")))
    return reduce(DataFrame.unionByName, parts)


def valid_at(at: Column) -> Column:
    """Whether an edge is valid at a time (half open)."""
    return (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))


def as_of(edges: DataFrame, at: Column, recorded_by: Column | None = None, edge_type: str | None = None, from_id: str | None = None) -> DataFrame:
    """The edges valid at a time (half open), recorded by another if one is given. status plays no part."""
    hit = valid_at(at)
    if recorded_by is not None:
        hit = hit & (F.col("recorded_at") <= recorded_by)
    if edge_type is not None:
        hit = hit & (F.col("edge_type") == edge_type)
    if from_id is not None:
        hit = hit & (F.col("from_id") == from_id)
    return edges.where(hit)


def active(edges: DataFrame, at: Column | None = None, causal_only: bool = False) -> DataFrame:
    """Edges for retrieval: valid at a time, or all of them, superseded ones included, if none is given."""
    out = edges if at is None else as_of(edges, at)
    return out.where(F.col("edge_type").isin(*CAUSAL)) if causal_only else out


def supersession(edges: DataFrame) -> DataFrame:
    """edges with next_edge_id and closed_at, derived from the order of valid_from within (run, from, type): an edge is
    closed by the one after it. Ties are broken by edge_id; edges without valid_from are left out."""
    w = Window.partitionBy("run_id", "from_id", "edge_type").orderBy("valid_from", "edge_id")
    return edges.where("valid_from is not null").withColumns({"next_edge_id": F.lead("edge_id").over(w), "closed_at": F.lead("valid_from").over(w)})


#: Seconds of a shard of time in which endpoints are counted on their own.
SHARD_SECONDS = 16 * 86400


def overlap_counts(spans: DataFrame, keys: list[str], shard_seconds: int = SHARD_SECONDS) -> DataFrame:
    """*keys, id, overlaps: how many other spans of its key each span (*keys, id, lo, hi; hi null: open) overlaps.

    Counted from endpoints, never from pairs: a span overlaps all that begin before it ends, but those that end before it
    begins. Endpoints are counted shard by shard, so a hot key spreads over its shards; only shard totals meet per key.
    """
    point = lambda t, kind: F.struct(t.alias("t"), F.lit(kind).alias("kind"))
    spans = spans.where("lo is not null and (hi is null or lo < hi)")
    ends = F.filter(F.array(point(F.col("lo"), 1), F.when(F.col("hi").isNotNull(), point(F.col("hi"), 0))), lambda p: p.isNotNull())
    points = spans.select(*keys, "id", F.explode(ends).alias("p")).select(*keys, "id", "p.t", "p.kind", F.floor(F.col("p.t") / shard_seconds).alias("shard"))
    totals = points.groupBy(*keys, "shard").agg(F.sum("kind").alias("starts"), F.sum(1 - F.col("kind")).alias("ends"))
    of_key = Window.partitionBy(*keys)
    before = of_key.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "shard", F.coalesce(F.sum("starts").over(before), F.lit(0)).alias("starts_before"), F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("ends_before"), F.sum("starts").over(of_key).alias("all_starts"))
    # at one time ends come first: spans are half open
    so_far = Window.partitionBy(*keys, "shard").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = points.withColumns({"starts": F.sum("kind").over(so_far), "ends": F.sum(1 - F.col("kind")).over(so_far)}).join(offsets, [*keys, "shard"])
    # at an end, all starts counted so far lie before it; at a start, all ends counted so far lie at or before it
    per = counted.groupBy(*keys, "id").agg(
        F.max(F.when(F.col("kind") == 0, F.col("starts") + F.col("starts_before"))).alias("begun"),
        F.max(F.when(F.col("kind") == 1, F.col("ends") + F.col("ends_before"))).alias("ended"),
        F.max("all_starts").alias("all_starts"),
    )
    return per.select(*keys, "id", (F.coalesce("begun", "all_starts") - F.col("ended") - 1).alias("overlaps"))


def conflict_counts(edges: DataFrame, shard_seconds: int = SHARD_SECONDS) -> DataFrame:
    """run_id, from_id, edge_type, edge_id, conflicts: with how many edges of its subject and type that lead elsewhere an
    edge's validity overlaps; edges without conflicts give no row. status plays no part."""
    keys = ["run_id", "from_id", "edge_type"]
    spans = edges.select(*keys, "to_id", F.col("edge_id").alias("id"), seconds("valid_from").alias("lo"), seconds("valid_to").alias("hi"))
    all_of_key = overlap_counts(spans, keys, shard_seconds)
    same = overlap_counts(spans, [*keys, "to_id"], shard_seconds).drop("to_id").withColumnRenamed("overlaps", "same")
    return all_of_key.join(same, [*keys, "id"]).select(*keys, F.col("id").alias("edge_id"), (F.col("overlaps") - F.col("same")).alias("conflicts")).where("conflicts > 0")


def conflict_pairs(edges: DataFrame, bucket_seconds: int = SHARD_SECONDS) -> DataFrame:
    """run_id, from_id, edge_type, left_edge_id, right_edge_id: the conflicting pairs themselves, for chosen subjects.

    Edges meet in buckets of time and a pair counts in the bucket where the later one begins, so it comes out once. Open
    ends reach to the last bucket of their subject. The result is as large as the conflicts are many: conflict_counts says
    how many before.
    """
    keys = ["run_id", "from_id", "edge_type"]
    spans = edges.where("valid_from is not null and (valid_to is null or valid_from < valid_to)").select(*keys, "to_id", "edge_id", seconds("valid_from").alias("lo"), seconds("valid_to").alias("hi"))
    bucket = lambda c: F.floor(c / bucket_seconds)
    last = spans.groupBy(*keys).agg(F.max(bucket(F.col("lo"))).alias("last"))
    spans = spans.join(last, keys)
    older = spans.withColumn("bucket", F.explode(F.sequence(bucket(F.col("lo")), F.least("last", F.coalesce(bucket(F.col("hi") - 1), F.col("last"))))))
    newer = spans.select(*keys, F.col("to_id").alias("to_2"), F.col("edge_id").alias("id_2"), F.col("lo").alias("lo_2"), bucket(F.col("lo")).alias("bucket"))
    began = (F.col("lo") < F.col("lo_2")) | ((F.col("lo") == F.col("lo_2")) & (F.col("edge_id") < F.col("id_2")))
    hit = older.join(newer, [*keys, "bucket"]).where(began & (F.col("hi").isNull() | (F.col("hi") > F.col("lo_2"))) & (F.col("to_id") != F.col("to_2")))
    return hit.select(*keys, F.least("edge_id", "id_2").alias("left_edge_id"), F.greatest("edge_id", "id_2").alias("right_edge_id"))


#: Node types, edge types with the node types they may lead from and to, and claim statuses of the record format.
NODE_TYPES = ["ResearchQuestion", "Hypothesis", "Claim", "EvidenceSpan", "Source", "Entity", "Event", "Method", "Dataset", "Finding", "ResearchGap"]
STATUSES = ["candidate", "verified", "contested", "rejected", "superseded", "unknown"]
ENDPOINTS = {
    "ASSERTED_BY": (["Claim"], ["Source"]),
    "SUPPORTS": (["EvidenceSpan"], ["Claim"]),
    "CONTRADICTS": (["EvidenceSpan"], ["Claim"]),
    "QUALIFIES": (["EvidenceSpan", "Claim"], ["Claim"]),
    "DERIVED_FROM": (["Finding", "Claim"], ["Claim", "Dataset", "Method"]),
    "ABOUT": (["Claim", "EvidenceSpan"], ["Entity", "Event"]),
    "SAME_AS": (["Entity"], ["Entity"]),
    "SUPERSEDES": (["Claim", "Source"], ["Claim", "Source"]),
    "ANSWERS": (["Finding", "Claim"], ["ResearchQuestion"]),
    "CITES": (["Source"], ["Source"]),
}


def lint(records: DataFrame) -> DataFrame:
    """id, rule, severity of every violation in graph records.

    records: record_type, id, node_type, status, data (JSON text), edge_type, from_id, to_id, provenance (JSON text).
    Rules: missing_id, duplicate_id, bad_record_type, bad_node_type, bad_status, bad_data, bad_edge_type, no_provenance,
    missing_from, missing_to, bad_endpoints, verified_without_support, contested_without_both, candidate_without_support
    (the only warning).
    """
    named = records.where("id is not null and id <> ''")
    error = lambda df, rule, severity="error": df.select("id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
    is_object = lambda c: F.coalesce(F.trim(F.col(c)).startswith("{"), F.lit(False))
    node, edge = named.where("record_type = 'node'"), named.where("record_type = 'edge'")
    known = node.select(F.col("id").alias("node_id"), "node_type", "status").dropDuplicates(["node_id"])
    end = lambda c: known.select(F.col("node_id").alias(c), F.col("node_type").alias(f"{c}_type"))
    ends = edge.join(end("from_id"), "from_id", "left").join(end("to_id"), "to_id", "left")
    both = ends.where("from_id_type is not null and to_id_type is not null")
    fits = reduce(Column.__or__, [(F.col("edge_type") == e) & F.col("from_id_type").isin(*a) & F.col("to_id_type").isin(*b) for e, (a, b) in ENDPOINTS.items()])
    evidence = edge.groupBy(F.col("to_id").alias("node_id")).agg(F.count_if(F.col("edge_type") == "SUPPORTS").alias("s"), F.count_if(F.col("edge_type") == "CONTRADICTS").alias("c"))
    claims = known.where("node_type = 'Claim'").join(evidence, "node_id", "left").select(F.col("node_id").alias("id"), "status", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("c", F.lit(0)).alias("c"))
    return reduce(DataFrame.unionByName, [
        error(records.where("id is null or id = ''"), "missing_id"),
        error(named.groupBy("id").count().where("count > 1"), "duplicate_id"),
        error(named.where("record_type is null or record_type not in ('node', 'edge')"), "bad_record_type"),
        error(node.where(~F.coalesce(F.col("node_type").isin(*NODE_TYPES), F.lit(False))), "bad_node_type"),
        error(node.where(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))), "bad_status"),
        error(node.where(~is_object("data")), "bad_data"),
        error(edge.where(~F.coalesce(F.col("edge_type").isin(*ENDPOINTS), F.lit(False))), "bad_edge_type"),
        error(edge.where(~is_object("provenance") | F.coalesce(F.regexp_replace("provenance", r"\s", "") == "{}", F.lit(False))), "no_provenance"),
        error(ends.where("from_id_type is null"), "missing_from"),
        error(ends.where("from_id_type is not null and to_id_type is null"), "missing_to"),
        error(both.where(F.col("edge_type").isin(*ENDPOINTS) & ~fits), "bad_endpoints"),
        error(claims.where("status = 'verified' and s = 0"), "verified_without_support"),
        error(claims.where("status = 'contested' and (s = 0 or c = 0)"), "contested_without_both"),
        error(claims.where("status = 'candidate' and s = 0"), "candidate_without_support", "warning"),
    ])


def lint_metrics(records: DataFrame) -> DataFrame:
    """records, nodes, edges, claims, verified_claims, contested_claims of graph records (see lint): one row."""
    node, claim = F.col("record_type") == "node", (F.col("record_type") == "node") & (F.col("node_type") == "Claim")
    return records.agg(F.count("*").alias("records"), F.count_if(node).alias("nodes"), F.count_if(F.col("record_type") == "edge").alias("edges"), F.count_if(claim).alias("claims"), F.count_if(claim & (F.col("status") == "verified")).alias("verified_claims"), F.count_if(claim & (F.col("status") == "contested")).alias("contested_claims"))
