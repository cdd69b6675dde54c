"""Hybrid retrieval: the class of a question chooses the plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.text import classify_question, token_estimate
from ..session import cut
from .components import connected_components
from .lexical import bm25_scores, ranked, reciprocal_rank_fusion
from .temporal_graph import active
from .traverse import communities, expand, expansion_edges, shortest_paths
from .verify import unsupported_claims

LIMIT, MAX_HOPS, SEEDS = 12, 3, 3
TWO_HOPS = ("comparative", "causal-event")
AROUND = ("entity-local", "direct", "comparative", "temporal", "causal-event")


def question_class(spark, question: str, entities: int = 0) -> str:
    return spark.range(1).select(classify_question(F.lit(question), F.lit(entities)).alias("c")).first()["c"]


def retrieve(nodes: DataFrame, edges: DataFrame, question: str, entity_ids: tuple[str, ...] = (), at: Column | None = None, limit: int = LIMIT, max_hops: int = MAX_HOPS) -> dict:
    """The plan for one question over all runs: query_class, methods, at, and the frames nodes (run_id, node_id, place),
    edges (run_id, edge_id, place), paths (run_id, place, start_id, end_id, hops, path) and missing (run_id, place, note).

    Ranks are taken in the order (hop, node_id) around the seeds, edges in that of (hop, edge_id). Without entities the
    three best nodes of each run by BM25 are the seeds.
    """
    spark = nodes.sparkSession
    entity_ids = tuple(dict.fromkeys(entity_ids))
    kind = question_class(spark, question, len(entity_ids))
    methods = ["lexical"]
    notes: list[DataFrame] = []
    runs = nodes.select("run_id").distinct()
    noted = lambda df, place, note: df.select("run_id", place.cast("int").alias("place"), note.alias("note"))
    texts = nodes.select("run_id", F.col("node_id").alias("id"), F.concat_ws(" ", "node_type", "data_json").alias("text"))
    scored = bm25_scores(texts, question, group="run_id")
    lexical = ranked(scored, ["run_id"], F.col("score").desc(), "id").where(F.col("rank") <= max(limit, 20))
    if entity_ids:
        order = F.create_map(*[F.lit(x) for i, e in enumerate(entity_ids) for x in (e, i)])
        seeds = nodes.where(F.col("node_id").isin(*entity_ids)).select("run_id", "node_id", (order[F.col("node_id")] + 1).alias("rank"))
    else:
        seeds = lexical.where(F.col("rank") <= SEEDS).select("run_id", F.col("id").alias("node_id"), "rank")
    current = active(edges, at, causal_only=False)
    ranking = lexical.select("run_id", "id", "rank")
    first: DataFrame | None = None
    last: DataFrame | None = None
    edge_rows: DataFrame | None = None
    paths: DataFrame | None = None
    if kind in AROUND:
        methods.append("graph-neighborhood")
        hops = 2 if kind in TWO_HOPS else 1
        chosen = active(current, causal_only=kind == "causal-event")
        near = expand(chosen, seeds, hops)
        around = ranked(near, ["run_id"], "hop", "node_id").select("run_id", F.col("node_id").alias("id"), "rank")
        fused = reciprocal_rank_fusion([ranking, around], ["run_id"])
        ranking = ranked(fused, ["run_id"], F.col("score").desc(), "id")
        edge_rows = expansion_edges(chosen, near, hops)
    if kind == "multi-hop-path":
        methods.append("path")
        nxt = seeds.select("run_id", F.col("node_id").alias("end_id"), (F.col("rank") - 1).alias("rank"))
        pairs = seeds.withColumnRenamed("node_id", "start_id").join(nxt, ["run_id", "rank"])
        found = shortest_paths(current, pairs, max_hops).join(pairs, ["run_id", "start_id", "end_id"])
        paths = cut(ranked(found.withColumnRenamed("rank", "nth"), ["run_id"], "nth").withColumnRenamed("rank", "place"))
        steps = paths.select("run_id", "nth", F.posexplode("path").alias("at", "id"))
        # one fusion per path, in the order of the seeds
        for i in range(1, max(len(entity_ids) or SEEDS, 2)):
            on_path = steps.where((F.col("nth") == i) & (F.col("at") % 2 == 0)).select("run_id", "id", (F.floor(F.col("at") / 2) + 1).cast("int").alias("rank"))
            ranking = cut(ranked(reciprocal_rank_fusion([ranking, on_path], ["run_id"]), ["run_id"], F.col("score").desc(), "id").select("run_id", "id", "rank"))
        edge_rows = steps.where("at % 2 = 1").groupBy("run_id", F.col("id").alias("edge_id")).agg(F.min(F.struct("nth", "at")).alias("hop"))
        few = runs.join(seeds.groupBy("run_id").count().where("count > 1"), "run_id", "left_anti")
        notes.append(noted(few, F.lit(0), F.lit("Two linked entities are required for path retrieval.")))
        apart = pairs.join(paths, ["run_id", "start_id", "end_id"], "left_anti")
        notes.append(noted(apart, F.col("rank"), F.concat(F.lit("No path found between "), "start_id", F.lit(" and "), "end_id", F.lit(f" within {max_hops} hops."))))
    if kind == "temporal":
        methods.append("temporal-filter")
        if at is None:
            notes.append(noted(runs, F.lit(0), F.lit("No as_of timestamp was supplied; current graph validity was used.")))
    if kind == "global-theme":
        methods.append("community")
        largest = ranked(communities(nodes, current), ["run_id"], F.col("members").desc(), "community_id").where(F.col("rank") <= limit).select("run_id", "community_id", F.col("rank").alias("community"))
        members = connected_components(current, ["run_id"], "from_id", "to_id").select("run_id", F.col("component").alias("community_id"), F.col("member").alias("id"))
        last = ranked(members.join(largest, ["run_id", "community_id"]), ["run_id", "community_id"], "id").where("rank <= 3").select("run_id", "id", (F.col("community") * 3 + F.col("rank")).alias("rank"))
    if kind == "evidence-gap":
        methods.append("gap-scan")
        first = ranked(unsupported_claims(nodes, edges), ["run_id"], "node_id").select("run_id", F.col("node_id").alias("id"), "rank")
    stages = [(0, first), (1, ranking), (2, last)]
    merged = reduce(DataFrame.unionByName, [df.select("run_id", "id", F.struct(F.lit(n).alias("stage"), F.col("rank").cast("int").alias("rank")).alias("place")) for n, df in stages if df is not None])
    merged = merged.groupBy("run_id", "id").agg(F.min("place").alias("place"))
    out_nodes = ranked(merged, ["run_id"], "place", "id").where(F.col("rank") <= limit).select("run_id", F.col("id").alias("node_id"), F.col("rank").alias("place"))
    out_edges = None
    if edge_rows is not None:
        out_edges = ranked(edge_rows, ["run_id"], "hop", "edge_id").where(F.col("rank") <= max(3 * limit, 20)).select("run_id", "edge_id", F.col("rank").alias("place"))
    missing = reduce(DataFrame.unionByName, notes) if notes else noted(runs, F.lit(0), F.lit("")).limit(0)
    return {"query_class": kind, "methods": methods, "at": at, "missing": missing, "nodes": out_nodes, "edges": out_edges, "paths": paths}


def source_episodes_of(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """run_id, source_episode_id: the sources of the chosen edges."""
    return edges.where("source_episode_id is not null").join(chosen.select("run_id", "edge_id"), ["run_id", "edge_id"], "left_semi").select("run_id", "source_episode_id").distinct()


def serialize(found: dict, nodes: DataFrame, edges: DataFrame, episodes: DataFrame) -> DataFrame:
    """run_id, context, token_estimate: the found nodes, edges, sources and paths of each run as lines of text."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = lambda n, place, text: F.struct(F.lit(n).alias("part"), place.alias("place"), text.alias("line"))
    parts = [found["nodes"].join(nodes, ["run_id", "node_id"]).select("run_id", line(0, F.lpad(F.col("place").cast("string"), 6, "0"), F.concat(F.lit("NODE "), "node_id", F.lit(" ["), "node_type", F.lit("] "), F.coalesce("data_json", F.lit("")))).alias("l"))]
    if found["edges"] is not None:
        text = F.concat(F.lit("EDGE "), "edge_id", F.lit(" ("), "from_id", F.lit(")-["), "edge_type", F.lit(" valid="), F.coalesce(stamp("valid_from"), F.lit("none")), F.lit(".."), F.coalesce(stamp("valid_to"), F.lit("open")), F.lit(" source="), F.coalesce("source_episode_id", F.lit("none")), F.lit("]->("), "to_id", F.lit(")"))
        parts.append(found["edges"].join(edges, ["run_id", "edge_id"]).select("run_id", line(1, F.lpad(F.col("place").cast("string"), 6, "0"), text).alias("l")))
        used = source_episodes_of(edges, found["edges"]).withColumnRenamed("source_episode_id", "episode_id")
        text = F.concat(F.lit("SOURCE "), "episode_id", F.lit(" locator="), F.coalesce("locator", F.lit("")), F.lit(" hash="), F.coalesce("content_hash", F.lit("")), F.lit(" risk="), F.coalesce("injection_risk", F.lit("")))
        parts.append(used.join(episodes, ["run_id", "episode_id"]).select("run_id", line(2, F.col("episode_id"), text).alias("l")))
    if found["paths"] is not None:
        parts.append(found["paths"].select("run_id", line(3, F.lpad(F.col("place").cast("string"), 6, "0"), F.concat(F.lit("PATH "), F.col("place").cast("string"), F.lit(" "), F.array_join("path", " -> "))).alias("l")))
    # at most limit nodes, 3 * limit edges and their sources per run
    per = reduce(DataFrame.unionByName, parts).groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]), "\n").alias("context"))
    return per.withColumn("token_estimate", token_estimate(F.col("context")))


def traces(found: dict, question: str, contexts: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, trace_id, query_text, query_class, methods, node_ids, edge_ids, paths, source_episode_ids, missing_links,
    token_estimate, as_of: what to keep of a retrieval, one row per run with nodes (each list is bounded by the plan's
    limits). The id covers question, nodes, edges and time, so the same question at another time is another trace."""
    in_order = lambda df, name, column: df.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", column))), lambda x: x[column]).alias(name))
    out = in_order(found["nodes"], "node_ids", "node_id").join(contexts.select("run_id", "token_estimate"), "run_id")
    lists = {"edge_ids": "array<string>", "paths": "array<array<string>>", "source_episode_ids": "array<string>", "missing_links": "array<string>"}
    given = {"missing_links": in_order(found["missing"], "missing_links", "note")}
    if found["edges"] is not None:
        given["edge_ids"] = in_order(found["edges"], "edge_ids", "edge_id")
        given["source_episode_ids"] = source_episodes_of(edges, found["edges"]).groupBy("run_id").agg(F.sort_array(F.collect_list("source_episode_id")).alias("source_episode_ids"))
    if found["paths"] is not None:
        given["paths"] = in_order(found["paths"], "paths", "path")
    for name, kind in lists.items():
        out = out.join(given[name], "run_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind))) if name in given else out.withColumn(name, F.array().cast(kind))
    listed = lambda c: F.when(F.size(c) > 0, F.concat(F.lit('["'), F.array_join(c, '", "'), F.lit('"]'))).otherwise("[]")
    as_of = F.lit(None).cast("string") if found["at"] is None else F.date_format(found["at"], "yyyy-MM-dd'T'HH:mm:ss'Z'")
    trace_id = stable_id("trace", F.col("run_id"), F.lit(question), F.lit(found["query_class"]), listed("node_ids"), listed("edge_ids"), F.coalesce(as_of, F.lit("")))
    named = out.select("*", trace_id.alias("trace_id"), F.lit(question).alias("query_text"), F.lit(found["query_class"]).alias("query_class"), F.array(*[F.lit(m) for m in found["methods"]]).alias("methods"), as_of.alias("as_of"))
    return named.select("run_id", "trace_id", "query_text", "query_class", "methods", "node_ids", *lists, "token_estimate", "as_of")
