"""Type graphs: validity, competency questions, evolution, versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_HOPS = 4


def type_paths(relations: DataFrame, questions: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """ontology_id, question_id, path (relation names) of each question that has one: the shortest, then smallest, directed
    path from start to end. relations: ontology_id, name, domain, range; questions: ontology_id, question_id, start, end.
    A question whose start is its end has an empty path."""
    steps = relations.select("ontology_id", F.col("domain").alias("at"), F.col("range").alias("next"), "name")
    frontier = known = questions.select("ontology_id", "question_id", F.col("start").alias("at"), F.array().cast("array<string>").alias("path"))
    for _ in range(max_hops):
        moved = frontier.join(steps, ["ontology_id", "at"]).select("ontology_id", "question_id", F.col("next").alias("at"), F.concat("path", F.array("name")).alias("path"))
        frontier = moved.groupBy("ontology_id", "question_id", "at").agg(F.min("path").alias("path")).join(known, ["ontology_id", "question_id", "at"], "left_anti")
        known = known.unionByName(frontier)
    goal = questions.select("ontology_id", "question_id", F.col("end").alias("at"))
    return known.join(goal, ["ontology_id", "question_id", "at"]).select("ontology_id", "question_id", "path")


def ontology_errors(entities: DataFrame, relations: DataFrame, questions: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """ontology_id, subject, rule: no_entities, unknown_domain, unknown_range, unknown_start, unknown_end, no_path.
    entities: ontology_id, name."""
    ids = relations.select("ontology_id").unionByName(questions.select("ontology_id")).distinct()
    missing = lambda df, subject, col, rule: df.select("ontology_id", F.col(subject).alias("subject"), F.col(col).alias("name")).join(entities, ["ontology_id", "name"], "left_anti").select("ontology_id", "subject", F.lit(rule).alias("rule"))
    known = questions.join(entities.withColumnRenamed("name", "start"), ["ontology_id", "start"], "left_semi").join(entities.withColumnRenamed("name", "end"), ["ontology_id", "end"], "left_semi")
    return reduce(DataFrame.unionByName, [
        ids.join(entities, "ontology_id", "left_anti").select("ontology_id", F.lit(None).cast("string").alias("subject"), F.lit("no_entities").alias("rule")),
        missing(relations, "name", "domain", "unknown_domain"),
        missing(relations, "name", "range", "unknown_range"),
        missing(questions, "question_id", "start", "unknown_start"),
        missing(questions, "question_id", "end", "unknown_end"),
        known.join(type_paths(relations, questions, max_hops), ["ontology_id", "question_id"], "left_anti").select("ontology_id", F.col("question_id").alias("subject"), F.lit("no_path").alias("rule")),
    ])


def evolution(previous: DataFrame, proposed: DataFrame) -> DataFrame:
    """kind, name, change, breaking: what differs between two ontologies (kind entity or relation, name, domain, range;
    entities have neither domain nor range). Removals and new signatures break, additions don't."""
    old = previous.select("kind", "name", F.struct("domain", "range").alias("old"))
    new = proposed.select("kind", "name", F.struct("domain", "range").alias("new"))
    change = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(~F.col("old").eqNullSafe(F.col("new")), "signature_changed")
    return old.join(new, ["kind", "name"], "full").withColumn("change", change).where("change is not null").select("kind", "name", "change", (F.col("change") != "added").alias("breaking"))


def refused(previous: DataFrame, proposed: DataFrame, allow_breaking: bool = False) -> DataFrame:
    """kind, name, change: what keeps a proposal from being stored beside the active version; none if breaking is allowed."""
    return evolution(previous, proposed).where(F.col("breaking") & F.lit(not allow_breaking)).drop("breaking")


def minimal(relations: DataFrame, questions: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """kind, name, domain, range: the smallest ontology that answers the questions: the relations on their paths, and the
    types these join. relations: ontology_id, name, domain, range (see type_paths)."""
    used = type_paths(relations, questions, max_hops).select("ontology_id", F.explode("path").alias("name")).distinct()
    kept = relations.join(used, ["ontology_id", "name"], "left_semi").select("ontology_id", F.lit("relation").alias("kind"), "name", "domain", "range").distinct()
    types = kept.select("ontology_id", F.explode(F.array("domain", "range")).alias("name")).distinct()
    return kept.unionByName(types.select("ontology_id", F.lit("entity").alias("kind"), "name", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("range")))


def register_versions(offers: DataFrame) -> DataFrame:
    """run_id, content_hash, version: the first offer of each content is the run's next version. offers: run_id, content_hash, seq."""
    first = offers.groupBy("run_id", "content_hash").agg(F.min("seq").alias("seq"))
    return first.select("run_id", "content_hash", F.row_number().over(Window.partitionBy("run_id").orderBy("seq")).alias("version"))


def active_version(activations: DataFrame) -> DataFrame:
    """run_id, version: the one activated last. activations: run_id, version, seq."""
    return activations.groupBy("run_id").agg(F.max_by("version", "seq").alias("version"))
