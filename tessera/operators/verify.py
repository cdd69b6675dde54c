"""Claims against their evidence, for all claims at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.text import numbers, words
from .temporal_graph import as_of

EVIDENCE = ("SUPPORTS", "CONTRADICTS", "QUALIFIES")
MIN_LEXICAL, REVIEW_BELOW, MIN_GROUPS = 0.20, 0.45, 1
#: The issues, in order.
ISSUES = (
    "No supporting evidence edge exists.",
    "One or more claim numbers are absent from the supporting evidence spans.",
    "Deterministic lexical entailment signal is below threshold.",
    "Independent-source requirement is not met.",
    "Supporting evidence includes quarantined source content.",
)


def _text(data: Column, other: str) -> Column:
    of = lambda key: F.nullif(F.get_json_object(data, f"$.{key}"), F.lit(""))
    return F.coalesce(of("text"), of(other), F.lit(""))


def evidence_packets(nodes: DataFrame, edges: DataFrame, episodes: DataFrame, at: Column | None = None) -> DataFrame:
    """One row per evidence edge of a claim: run_id, claim_id, edge_id, edge_type, source_episode_id, evidence_text,
    independence_group, injection_risk. Edges of missing nodes and episodes stay, with nulls."""
    kept = (edges if at is None else as_of(edges, at)).where(F.col("edge_type").isin(*EVIDENCE))
    text = nodes.select("run_id", F.col("node_id").alias("from_id"), _text(F.col("data_json"), "value").alias("evidence_text"))
    source = episodes.select("run_id", F.col("episode_id").alias("source_episode_id"), "independence_group", "injection_risk")
    claims = nodes.where("node_type = 'Claim'").select("run_id", F.col("node_id").alias("to_id"))
    packet = kept.join(claims, ["run_id", "to_id"], "left_semi").join(text, ["run_id", "from_id"], "left").join(source, ["run_id", "source_episode_id"], "left")
    return packet.select("run_id", F.col("to_id").alias("claim_id"), "edge_id", "edge_type", "source_episode_id", "evidence_text", "independence_group", "injection_risk")


def verify_claims(nodes: DataFrame, edges: DataFrame, episodes: DataFrame, at: Column | None = None, min_lexical: float = MIN_LEXICAL, min_groups: int = MIN_GROUPS) -> DataFrame:
    """run_id, claim_id, status, support_edge_ids, contradiction_edge_ids, source_episode_ids, independence_groups,
    lexical_entailment, numerical_consistency, issues, requires_model_review, decision_id of every claim.

    lexical_entailment is the share of the claim's words in its supporting texts; a claim's numbers must all occur there.
    Words and numbers are compared row by row of evidence and united per claim, so texts are never collected: an evidence
    row leaves only those of the claim's words and numbers that it has. Claims without text have no words: 0.
    """
    claims = nodes.where("node_type = 'Claim'").select("run_id", F.col("node_id").alias("claim_id"), _text(F.col("data_json"), "claim").alias("text"))
    claims = claims.select("run_id", "claim_id", words(F.col("text")).alias("claim_words"), numbers(F.col("text")).alias("claim_numbers"))
    packet = evidence_packets(nodes, edges, episodes, at)
    support = F.col("edge_type") == "SUPPORTS"
    met = packet.join(claims, ["run_id", "claim_id"])
    met = met.select(
        "run_id", "claim_id", "edge_id", "edge_type", "source_episode_id", "independence_group", "injection_risk",
        F.when(support, F.array_intersect("claim_words", words(F.col("evidence_text")))).alias("words_met"),
        F.when(support, F.array_intersect("claim_numbers", numbers(F.col("evidence_text")))).alias("numbers_met"),
    )
    ids = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("edge_id"))))
    per = met.groupBy("run_id", "claim_id").agg(
        ids(support).alias("support_edge_ids"),
        ids(F.col("edge_type") == "CONTRADICTS").alias("contradiction_edge_ids"),
        F.array_sort(F.collect_set("edge_id")).alias("all_edge_ids"),
        F.array_sort(F.collect_set("source_episode_id")).alias("source_episode_ids"),
        F.array_sort(F.collect_set("independence_group")).alias("independence_groups"),
        F.array_distinct(F.flatten(F.collect_set("words_met"))).alias("words_met"),
        F.array_distinct(F.flatten(F.collect_set("numbers_met"))).alias("numbers_met"),
        F.max(F.coalesce(F.col("injection_risk") == "quarantine", F.lit(False))).alias("quarantined"),
    )
    empty = F.array().cast("array<string>")
    lists = ["support_edge_ids", "contradiction_edge_ids", "all_edge_ids", "source_episode_ids", "independence_groups", "words_met", "numbers_met"]
    all_claims = claims.join(per, ["run_id", "claim_id"], "left").withColumns({c: F.coalesce(c, empty) for c in lists} | {"quarantined": F.coalesce("quarantined", F.lit(False))})
    lexical = F.coalesce(F.try_divide(F.size("words_met").cast("double"), F.size("claim_words")), F.lit(0.0))
    judged = all_claims.withColumns({"lexical": lexical, "consistent": F.size(F.array_except("claim_numbers", "numbers_met")) == 0, "supported": F.size("support_edge_ids") > 0})
    failed = [~F.col("supported"), (F.size("claim_numbers") > 0) & ~F.col("consistent"), F.col("supported") & (F.col("lexical") < min_lexical), F.size("independence_groups") < min_groups, F.col("quarantined")]
    judged = judged.withColumn("issues", F.filter(F.array(*[F.when(c, text) for c, text in zip(failed, ISSUES, strict=True)]), lambda x: x.isNotNull()))
    status = F.when(~F.col("supported"), "rejected").when(F.size("contradiction_edge_ids") > 0, "contested").when(F.size("issues") > 0, "needs_review").otherwise("verified")
    judged = judged.withColumn("status", status)
    return judged.select(
        "run_id", "claim_id", "status", "support_edge_ids", "contradiction_edge_ids", "source_episode_ids", "independence_groups",
        F.round("lexical", 6).alias("lexical_entailment"), F.col("consistent").alias("numerical_consistency"), "issues",
        (F.col("supported") & (F.col("lexical") < max(min_lexical, REVIEW_BELOW))).alias("requires_model_review"),
        stable_id("adjudication", F.col("run_id"), F.col("claim_id"), F.col("status"), F.array_join("all_edge_ids", ",")).alias("decision_id"),
    )


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision on each claim: by created_at, then decision_id; decisions without claim or time come never first."""
    w = Window.partitionBy("run_id", "claim_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("decision_id").desc())
    return decisions.where("claim_id is not null").withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def unsupported_claims(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, node_id of the claims that no SUPPORTS edge leads to, at whatever time."""
    supported = edges.where("edge_type = 'SUPPORTS'").select("run_id", F.col("to_id").alias("node_id"))
    return nodes.where("node_type = 'Claim'").select("run_id", "node_id").join(supported, ["run_id", "node_id"], "left_anti")


def independent_groups(sources: DataFrame, keys: list[str]) -> DataFrame:
    """*keys, groups: the number of different, non-empty independence groups."""
    return sources.groupBy(*keys).agg(F.count_distinct(F.nullif(F.col("independence_group"), F.lit(""))).alias("groups"))
