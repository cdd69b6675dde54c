"""Checks of task graphs and of state histories, for all runs at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .traverse import topological_levels


def lint(tasks: DataFrame, links: DataFrame, fan_in: int = 32) -> DataFrame:
    """run_id, task_id, rule of each violation.

    tasks: run_id, task_id, task_type, owner, consumes, produces; links: run_id, task_id, depends_on. Rules: duplicate_id,
    shared_output (an artifact of several tasks), missing_task, missing_dependency, fake_dependency (nothing consumed that
    the parent produces), self_verification (a verification by the owner of its only parent), fan_in (more parents), cycle.
    """
    row = lambda df, rule: df.select("run_id", "task_id", F.lit(rule).alias("rule"))
    ids = tasks.select("run_id", "task_id").distinct()
    parents = links.where("depends_on is not null").select("run_id", "task_id", "depends_on").distinct()
    made = tasks.select("run_id", "task_id", F.explode("produces").alias("artifact")).distinct()
    shared = made.groupBy("run_id", "artifact").agg(F.count("*").alias("n")).where("n > 1")
    one = tasks.dropDuplicates(["run_id", "task_id"])
    child = one.select("run_id", "task_id", "task_type", "owner", "consumes")
    parent = one.select("run_id", F.col("task_id").alias("depends_on"), F.col("owner").alias("parent_owner"), "produces")
    both = parents.join(child, ["run_id", "task_id"]).join(parent, ["run_id", "depends_on"])
    alone = parents.groupBy("run_id", "task_id").agg(F.count("*").alias("n"))
    levels = topological_levels(tasks, parents)
    empty = F.array().cast("array<string>")
    return reduce(DataFrame.unionByName, [
        row(tasks.groupBy("run_id", "task_id").count().where("count > 1"), "duplicate_id"),
        row(made.join(shared, ["run_id", "artifact"]).select("run_id", "task_id").distinct(), "shared_output"),
        row(parents.join(ids, ["run_id", "task_id"], "left_anti").select("run_id", "task_id").distinct(), "missing_task"),
        row(parents.join(ids.withColumnRenamed("task_id", "depends_on"), ["run_id", "depends_on"], "left_anti").select("run_id", "task_id").distinct(), "missing_dependency"),
        row(both.where(~F.arrays_overlap(F.coalesce("consumes", empty), F.coalesce("produces", empty))).select("run_id", "task_id").distinct(), "fake_dependency"),
        row(both.where("task_type = 'verification' and owner = parent_owner").join(alone.where("n = 1"), ["run_id", "task_id"], "left_semi").select("run_id", "task_id").distinct(), "self_verification"),
        row(alone.where(F.col("n") > fan_in), "fan_in"),
        row(levels.where("level is null"), "cycle"),
    ])


def level_widths(levels: DataFrame) -> DataFrame:
    """run_id, level, width: how many tasks may run side by side."""
    return levels.where("level is not null").groupBy("run_id", "level").agg(F.count("*").alias("width"))


def ready(tasks: DataFrame, links: DataFrame, done: str = "SUCCEEDED", waiting: str = "PENDING") -> DataFrame:
    """run_id, task_id of the waiting tasks none of whose known parents is anything but done."""
    unfinished = tasks.where(F.col("state") != done).select("run_id", F.col("task_id").alias("depends_on"))
    blocked = links.join(unfinished, ["run_id", "depends_on"], "left_semi").select("run_id", "task_id")
    return tasks.where(F.col("state") == waiting).select("run_id", "task_id").distinct().join(blocked, ["run_id", "task_id"], "left_anti")


def stale_leases(tasks: DataFrame, now: Column) -> DataFrame:
    """run_id, task_id, attempts_left of the running tasks whose lease has run out."""
    return tasks.where((F.col("state") == "RUNNING") & (F.col("lease_expires_at") <= now)).select("run_id", "task_id", F.greatest(F.lit(0), F.col("max_attempts") - F.col("attempt_count")).alias("attempts_left"))


def completion(tasks: DataFrame, done: str = "SUCCEEDED") -> DataFrame:
    """run_id, tasks, complete: whether a run's tasks are all done."""
    return tasks.groupBy("run_id").agg(F.count("*").alias("tasks"), F.bool_and(F.coalesce(F.col("state") == done, F.lit(False))).alias("complete"))


def capabilities(text: Column) -> Column:
    """The sorted set of a comma-separated list, trimmed and in lower case; null stays null."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")))


def capability_check(requests: DataFrame, strict: bool = True) -> DataFrame:
    """requests (available, required, any_of: arrays) with missing and passed; unknown availability passes unless strict."""
    norm = lambda c: F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))))
    lacking = F.array_sort(F.array_except(norm("required"), norm("available")))
    fine = (F.size(lacking) == 0) & ((F.size(norm("any_of")) == 0) | F.arrays_overlap(norm("any_of"), norm("available")))
    return requests.withColumns({"missing": lacking, "passed": F.when(F.col("available").isNull(), F.lit(not strict)).otherwise(fine)})


def illegal_transitions(history: DataFrame, allowed: list[tuple[str, str]], resume_from: str | None = None) -> DataFrame:
    """run_id, seq, state_before, state of each step that isn't allowed. history: run_id, seq, state. A step out of
    resume_from is legal only back into the state before it."""
    w = Window.partitionBy("run_id").orderBy("seq")
    steps = history.select("run_id", "seq", F.lag("state").over(w).alias("state_before"), F.lag("state", 2).over(w).alias("earlier"), "state").where("state_before is not null")
    ok = reduce(Column.__or__, [(F.col("state_before") == a) & (F.col("state") == b) for a, b in allowed], F.lit(False))
    if resume_from:
        ok = F.when(F.col("state_before") == resume_from, F.coalesce(F.col("state") == F.col("earlier"), F.lit(False))).otherwise(ok)
    return steps.where(~ok).drop("earlier")
