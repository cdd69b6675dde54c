"""Taking in contents of sources: an episode per new content, with version, predecessor, risk and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import content
from ..functions.ids import content_hash, stable_id


def record_episodes(contents: DataFrame) -> DataFrame:
    """run_id, episode_id, source_id, content_hash, version, supersedes_episode_id, first_seen of each new content of a
    source; a content that a source had before is the episode it was then.

    contents: run_id, source_id, content, first_seen, seq (breaks ties). Null contents are empty ones; rows without run or
    source are dropped. Texts are hashed where they lie, so only hashes are shuffled.
    """
    hashed = contents.where("run_id is not null and source_id is not null").select("run_id", "source_id", content_hash(F.coalesce("content", F.lit(""))).alias("content_hash"), "first_seen", "seq")
    versions = content.source_versions(hashed)
    named = versions.withColumn("episode_id", stable_id("episode", F.col("run_id"), F.col("source_id"), F.col("content_hash")))
    before = F.when(F.col("supersedes_hash").isNotNull(), stable_id("episode", F.col("run_id"), F.col("source_id"), F.col("supersedes_hash")))
    return named.select("run_id", "episode_id", "source_id", "content_hash", "version", before.alias("supersedes_episode_id"))


def scanned_episodes(contents: DataFrame) -> DataFrame:
    """run_id, episode_id, injection_risk, sensitive_classes, findings (code, severity, excerpt) of each new content."""
    w = Window.partitionBy("run_id", "source_id", "content_hash").orderBy("first_seen", "seq")
    hashed = contents.where("run_id is not null and source_id is not null").withColumn("content_hash", content_hash(F.coalesce("content", F.lit(""))))
    # whole rows move only here: each content is scanned once, however often it was delivered
    once = hashed.withColumn("__nth", F.row_number().over(w)).where("__nth = 1")
    named = once.select("run_id", stable_id("episode", F.col("run_id"), F.col("source_id"), F.col("content_hash")).alias("episode_id"), F.coalesce("content", F.lit("")).alias("content"))
    found = content.scan(named.select(F.struct("run_id", "episode_id").alias("key"), F.col("content").alias("text")), "key").select("key.*", F.col("risk").alias("injection_risk"), "findings")
    classes = named.select("run_id", "episode_id", content.redacted(F.col("content"))["classes"].alias("sensitive_classes"))
    return classes.join(found, ["run_id", "episode_id"]).select("run_id", "episode_id", "injection_risk", "sensitive_classes", "findings")


def episode_findings(scanned: DataFrame) -> DataFrame:
    """run_id, episode_id, code, severity, excerpt: a row per finding."""
    return scanned.select("run_id", "episode_id", F.inline("findings"))
