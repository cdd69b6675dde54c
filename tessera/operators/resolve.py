"""Entity resolution inside a run: blocking, scores, decisions and reversible merges."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .traverse import both_ways

#: Weights of the score, thresholds of the decision, attributes that must not differ.
WEIGHTS = {"name": 0.15, "aliases": 0.15, "identifiers": 0.60, "attributes": 0.05, "neighborhood": 0.05}
AUTO_MERGE, REVIEW = 0.90, 0.65
CRITICAL = ("jurisdiction", "birth_date", "registration_number", "model")
#: The same of the older score.
OLD_WEIGHTS = {"name": 0.25, "aliases": 0.20, "identifiers": 0.30, "attributes": 0.10, "neighborhood": 0.15}
#: Why a pair was decided as it was.
RATIONALES = {
    "conflict": "Rejected because hard identity conflicts were detected: ",
    "auto_merge": "Auto-merge allowed because stable identifiers agree and the aggregate score exceeds the high-confidence threshold.",
    "review": "Ambiguous match requires independent review; no stable-identifier basis for automatic fusion.",
    "reject": "Insufficient identity evidence to merge safely.",
}
#: A block of more members than this is cut into chunks that meet in pairs of chunks, each a task of its own.
CHUNK = 512


def plain(text: str) -> str:
    """ASCII letters and digits in lower case, single blanks, accents off."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(re.sub("[^a-zA-Z0-9]+", " ", text).lower().split())


@F.pandas_udf(StringType())
def plain_udf(texts: pd.Series) -> pd.Series:
    return texts.map(plain, na_action="ignore")


def similarity(a: str, b: str) -> float:
    """Ratcliff and Obershelp's ratio of the plain texts."""
    return SequenceMatcher(None, plain(a), plain(b)).ratio()


@F.pandas_udf(DoubleType())
def similarity_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([similarity(a or "", b or "") for a, b in zip(left, right, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def best_similarity_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    """The best similarity between any two of two lists of names; 0 if one is empty."""
    return pd.Series([max((similarity(x or "", y or "") for x in a for y in b), default=0.0) for a, b in zip(left, right, strict=True)], dtype="float64")


def features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, node_id, node_type, name, aliases, identifiers, attributes (maps), neighbors of each node, from data_json.

    A node without a name has its label for one. Data that isn't JSON gives empty features.
    """
    data = F.from_json("data_json", "name string, label string, aliases array<string>, identifiers map<string,string>, attributes map<string,string>")
    empty_map = F.create_map().cast("map<string,string>")
    empty = F.array().cast("array<string>")
    near = both_ways(edges).groupBy("run_id", "node_id").agg(F.collect_set("next_id").alias("neighbors"))
    read = nodes.select("run_id", "node_id", "node_type", F.explode(F.array(data)).alias("d"))
    read = read.select("run_id", "node_id", "node_type", F.coalesce("d.name", "d.label", F.lit("")).alias("name"), F.coalesce("d.aliases", empty).alias("aliases"), F.coalesce("d.identifiers", empty_map).alias("identifiers"), F.coalesce("d.attributes", empty_map).alias("attributes"))
    return read.join(near, ["run_id", "node_id"], "left").withColumn("neighbors", F.coalesce("neighbors", empty))


def block_keys(feats: DataFrame) -> DataFrame:
    """run_id, node_id, key: each identifier, and the first word of the name and of each alias, with the node type."""
    ids = feats.select("run_id", "node_id", "node_type", F.explode("identifiers").alias("k", "v")).where("v <> ''")
    ids = ids.select("run_id", "node_id", F.concat_ws(":", "node_type", F.lit("id"), "k", plain_udf("v")).alias("key"))
    first = lambda c: F.split(plain_udf(c), " ")[0]
    names = feats.select("run_id", "node_id", "node_type", first("name").alias("w")).where("w <> ''").select("run_id", "node_id", F.concat_ws(":", "node_type", F.lit("name"), "w").alias("key"))
    aliases = feats.select("run_id", "node_id", "node_type", F.explode("aliases").alias("a")).select("run_id", "node_id", "node_type", first("a").alias("w")).where("w <> ''")
    return ids.unionByName(names).unionByName(aliases.select("run_id", "node_id", F.concat_ws(":", "node_type", F.lit("alias"), "w").alias("key"))).distinct()


def candidate_pairs(keys: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """run_id, left_id, right_id: nodes that share a block key, smaller id first, once.

    Blocks are numbered and cut into chunks; a pair meets in the task of its two chunks, so a large block spreads.
    """
    w = Window.partitionBy("run_id", "key").orderBy("node_id")
    placed = keys.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / chunk).cast("int"))
    chunks = placed.groupBy("run_id", "key").agg((F.max("chunk") + 1).alias("chunks"), F.count("*").alias("members")).where("members > 1").drop("members")
    placed = placed.join(chunks, ["run_id", "key"])
    left = placed.select("run_id", "key", F.col("node_id").alias("left_id"), F.col("chunk").alias("c1"), F.explode(F.sequence(F.col("chunk"), F.col("chunks") - 1)).alias("c2"))
    right = placed.select("run_id", "key", F.col("node_id").alias("right_id"), F.col("chunk").alias("c2"), F.explode(F.sequence(F.lit(0), F.col("chunk"))).alias("c1"))
    return left.join(right, ["run_id", "key", "c1", "c2"]).where("left_id < right_id").select("run_id", "left_id", "right_id").distinct()


def conflicts(left: Column, right: Column, prefix: str, only: tuple[str, ...] | None = None) -> Column:
    """prefix:key for each key of both maps whose values differ, sorted."""
    keys = F.array_intersect(F.map_keys(left), F.map_keys(right))
    if only:
        keys = F.array_intersect(keys, F.array(*[F.lit(k) for k in only]))
    return F.transform(F.array_sort(F.filter(keys, lambda k: left[k] != right[k])), lambda k: F.concat(F.lit(f"{prefix}:"), k))


def jaccard(left: Column, right: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(left, right)).cast("double"), F.size(F.array_union(left, right))), F.lit(empty))


def exact_parts(feats: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with the features of both sides (structs l, r) and the parts of the score that need no string similarity:
    identifiers, attributes, neighborhood, hard_conflicts."""
    side = lambda name: feats.select("run_id", F.col("node_id").alias(f"{name}_id"), F.struct("node_type", "name", "aliases", "identifiers", "attributes", "neighbors").alias(name[0]))
    both = pairs.join(side("left"), ["run_id", "left_id"]).join(side("right"), ["run_id", "right_id"])
    same = lambda a, b: F.filter(F.array_intersect(F.map_keys(a), F.map_keys(b)), lambda k: a[k] == b[k])
    shared = F.size(F.array_intersect(F.map_keys("l.attributes"), F.map_keys("r.attributes")))
    i, j, a, b = F.col("l.identifiers"), F.col("r.identifiers"), F.col("l.attributes"), F.col("r.attributes")
    return both.withColumns({
        "identifiers": F.when(F.size(same(i, j)) > 0, 1.0).otherwise(0.0),
        "attributes": F.coalesce(F.try_divide(F.size(same(a, b)).cast("double"), shared), F.lit(0.0)),
        "neighborhood": jaccard(F.col("l.neighbors"), F.col("r.neighbors")),
        "hard_conflicts": F.concat(F.when(F.col("l.node_type") != F.col("r.node_type"), F.array(F.lit("entity_type"))).otherwise(F.array().cast("array<string>")), conflicts(i, j, "identifier"), conflicts(a, b, "attribute", CRITICAL)),
    })


def proposals(feats: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """run_id, left_id, right_id, name, aliases, identifiers, attributes, neighborhood, hard_conflicts, total, decision,
    canonical_id, rationale of each candidate pair."""
    parts = exact_parts(feats, candidate_pairs(block_keys(feats)) if pairs is None else pairs)
    names = lambda s: F.concat(F.array(f"{s}.name"), F.col(f"{s}.aliases"))
    scored = parts.withColumns({"name": similarity_udf("l.name", "r.name"), "aliases": best_similarity_udf(names("l"), names("r"))})
    clash = F.size("hard_conflicts") > 0
    total = F.when(clash, 0.0).otherwise(F.round(sum(F.col(c) * w for c, w in WEIGHTS.items()), 6))
    scored = scored.withColumn("total", total)
    decision = F.when(clash, "reject").when((F.col("identifiers") == 1) & (F.col("total") >= AUTO_MERGE), "auto_merge").when(F.col("total") >= REVIEW, "review").otherwise("reject")
    has = lambda s: F.size(f"{s}.identifiers") > 0
    canonical = F.when(has("l") & ~has("r"), F.col("left_id")).when(has("r") & ~has("l"), F.col("right_id")).otherwise(F.least("left_id", "right_id"))
    rationale = F.when(clash, F.concat(F.lit(RATIONALES["conflict"]), F.array_join("hard_conflicts", ", "))).when(F.col("decision") == "auto_merge", RATIONALES["auto_merge"]).when(F.col("decision") == "review", RATIONALES["review"]).otherwise(RATIONALES["reject"])
    out = scored.withColumns({"decision": decision, "canonical_id": canonical}).withColumn("rationale", rationale)
    return out.select("run_id", "left_id", "right_id", *WEIGHTS, "hard_conflicts", "total", "decision", "canonical_id", "rationale")


def old_scores(feats: DataFrame, pairs: DataFrame) -> DataFrame:
    """run_id, left_id, right_id, total, decision by the older score: no conflicts, bands without identifier."""
    parts = exact_parts(feats, pairs)
    names = lambda s: F.concat(F.array(f"{s}.name"), F.col(f"{s}.aliases"))
    scored = parts.withColumns({"name": similarity_udf("l.name", "r.name"), "aliases": best_similarity_udf(names("l"), names("r")), "neighborhood": jaccard(F.col("l.neighbors"), F.col("r.neighbors"), 1.0)})
    scored = scored.withColumn("total", F.when(F.col("l.node_type") != F.col("r.node_type"), 0.0).otherwise(F.round(sum(F.col(c) * w for c, w in OLD_WEIGHTS.items()), 6)))
    return scored.select("run_id", "left_id", "right_id", "total", F.when(F.col("total") >= AUTO_MERGE, "auto_merge").when(F.col("total") >= REVIEW, "review").otherwise("reject").alias("decision"))


def canonical_projection(decisions: DataFrame) -> DataFrame:
    """run_id, member_id, canonical_id: what each member stands for now, one hop.

    decisions: run_id, proposal_id, left_id, right_id, canonical_id, decision, created_at, reversed_at. Only accepted ones
    count; a reversed one counts for neither of its members; the latest of the rest wins. Members whose decisions were all
    reversed stand for themselves.
    """
    taken = decisions.where(F.col("decision").isin("auto_merge", "review-approved"))
    rows = taken.select("run_id", F.explode(F.array("left_id", "right_id")).alias("member_id"), F.coalesce("canonical_id", F.least("left_id", "right_id")).alias("canonical_id"), "created_at", "proposal_id", F.col("reversed_at").isNull().alias("active")).where("member_id is not null")
    latest = F.max_by(F.when(F.col("active"), F.col("canonical_id")), F.when(F.col("active"), F.struct("created_at", "proposal_id")))
    return rows.groupBy("run_id", "member_id").agg(latest.alias("latest")).select("run_id", "member_id", F.coalesce("latest", "member_id").alias("canonical_id"))
