"""Audits, reports and gates over whole runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .verify import latest_decisions

#: Headings a report must have.
HEADINGS = ("Research scope and as-of date", "Executive findings", "Detailed findings", "Contested or conflicting evidence", "Limitations", "Unresolved research gaps", "Source register")
PUBLISHABLE = ("verified", "contested")


def _material(data: Column) -> Column:
    return F.coalesce(F.get_json_object(data, "$.material") != "false", F.lit(True))


def _used(edges: DataFrame, episodes: DataFrame) -> DataFrame:
    """run_id, episode_id, injection_risk, content_hash, there of the episodes that edges name."""
    return edges.where("source_episode_id is not null").select("run_id", F.col("source_episode_id").alias("episode_id")).distinct().join(episodes.select("run_id", "episode_id", "injection_risk", "content_hash", F.lit(True).alias("there")), ["run_id", "episode_id"], "left")


def _altered(used: DataFrame, contents: DataFrame) -> DataFrame:
    """used episodes that can be verified again, with problem: content_missing or hash_mismatch."""
    now = contents.select("run_id", "episode_id", F.concat(F.lit("sha256:"), F.sha2(F.col("content"), 256)).alias("now"))
    checked = used.where("there and not coalesce(injection_risk in ('quarantine', 'unverified-legacy'), false)").join(now, ["run_id", "episode_id"], "left")
    return checked.withColumn("problem", F.when(F.col("now").isNull(), "content_missing").when(~F.col("now").eqNullSafe(F.col("content_hash")), "hash_mismatch")).where("problem is not null")


def _in_review(proposals: DataFrame) -> DataFrame:
    return proposals.where("decision = 'review' and reversed_at is null")


def violations(tasks: DataFrame, links: DataFrame, nodes: DataFrame, edges: DataFrame, episodes: DataFrame, decisions: DataFrame, contents: DataFrame | None = None, interrupts: DataFrame | None = None, proposals: DataFrame | None = None) -> DataFrame:
    """run_id, rule, subject_id, severity of every violation in the runs.

    Rules: dangling_dependency, fake_dependency, self_verification, incomplete_task, claim_without_decision,
    claim_needs_review (claims are material unless they say otherwise), missing_episode, quarantined_episode,
    legacy_episode (a warning); with contents (run_id, episode_id, content) content_missing and hash_mismatch; with
    interrupts (run_id, interrupt_id, status) open_interrupt; with proposals unresolved_merge (a warning). Each is one join;
    a subject is named once per rule.
    """
    row = lambda df, rule, subject, severity="error": df.select("run_id", F.lit(rule).alias("rule"), F.col(subject).alias("subject_id"), F.lit(severity).alias("severity")).distinct()
    child = tasks.select("run_id", "task_id", "task_type", "owner", "consumes")
    parent = tasks.select("run_id", F.col("task_id").alias("depends_on"), F.col("owner").alias("parent_owner"), F.col("produces"), F.lit(True).alias("has_parent"))
    deps = links.where("depends_on is not null").join(child.withColumn("has_child", F.lit(True)), ["run_id", "task_id"], "left").join(parent, ["run_id", "depends_on"], "left")
    whole = deps.where("has_child and has_parent")
    empty = F.array().cast("array<string>")
    last = latest_decisions(decisions).select("run_id", F.col("claim_id").alias("node_id"), "status")
    claims = nodes.where("node_type = 'Claim'").where(_material(F.col("data_json"))).select("run_id", "node_id").join(last, ["run_id", "node_id"], "left")
    used = _used(edges, episodes)
    more = []
    if contents is not None:
        altered = _altered(used, contents)
        more += [row(altered.where(F.col("problem") == rule), rule, "episode_id") for rule in ("content_missing", "hash_mismatch")]
    if interrupts is not None:
        more.append(row(interrupts.where("status = 'OPEN'"), "open_interrupt", "interrupt_id"))
    if proposals is not None:
        more.append(row(_in_review(proposals), "unresolved_merge", "proposal_id", "warning"))
    return reduce(DataFrame.unionByName, [
        row(deps.where("has_child is null or has_parent is null"), "dangling_dependency", "task_id"),
        row(whole.where(~F.arrays_overlap(F.coalesce("consumes", empty), F.coalesce("produces", empty))), "fake_dependency", "task_id"),
        row(whole.where("task_type = 'verification' and owner <=> parent_owner"), "self_verification", "task_id"),
        row(tasks.where("state is null or state <> 'SUCCEEDED'"), "incomplete_task", "task_id"),
        row(claims.where("status is null"), "claim_without_decision", "node_id"),
        row(claims.where("status = 'needs_review'"), "claim_needs_review", "node_id"),
        row(used.where("there is null"), "missing_episode", "episode_id"),
        row(used.where("injection_risk = 'quarantine'"), "quarantined_episode", "episode_id"),
        row(used.where("injection_risk = 'unverified-legacy'"), "legacy_episode", "episode_id", "warning"),
        *more,
    ])


def metrics(tasks: DataFrame, nodes: DataFrame, edges: DataFrame, episodes: DataFrame, decisions: DataFrame, contents: DataFrame | None = None, interrupts: DataFrame | None = None, proposals: DataFrame | None = None) -> DataFrame:
    """run_id, metric, value: tasks, incomplete_tasks, claims, material_claims, adjudicated_claims, <status>_claims,
    source_episodes, used_source_episodes, quarantined_sources_used, legacy_unverified_sources of each run that has any;
    with the further tables (see violations) tampered_sources, open_interrupts, unresolved_merge_reviews."""
    long = lambda df, **counts: df.groupBy("run_id").agg(*[c.cast("long").alias(n) for n, c in counts.items()]).select("run_id", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in counts])))
    used = _used(edges, episodes)
    more = [] if contents is None else [long(_altered(used, contents), tampered_sources=F.count("*"))]
    more += [] if interrupts is None else [long(interrupts.where("status = 'OPEN'"), open_interrupts=F.count("*"))]
    more += [] if proposals is None else [long(_in_review(proposals), unresolved_merge_reviews=F.count("*"))]
    last = latest_decisions(decisions)
    return reduce(DataFrame.unionByName, [
        long(tasks, tasks=F.count("*"), incomplete_tasks=F.count_if(F.coalesce(F.col("state") != "SUCCEEDED", F.lit(True)))),
        long(nodes.where("node_type = 'Claim'"), claims=F.count("*"), material_claims=F.count_if(_material(F.col("data_json")))),
        long(last, adjudicated_claims=F.count("*")),
        last.groupBy("run_id", F.concat(F.coalesce("status", F.lit("unknown")), F.lit("_claims")).alias("metric")).agg(F.count("*").alias("value")),
        long(episodes, source_episodes=F.count("*")),
        long(used, used_source_episodes=F.count("*"), quarantined_sources_used=F.count_if(F.col("injection_risk") == "quarantine"), legacy_unverified_sources=F.count_if(F.col("injection_risk") == "unverified-legacy")),
        *more,
    ])


def report_lines(nodes: DataFrame, edges: DataFrame, episodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """run_id, section, subject_id, line: the lines of every run's report (findings, conflicts, gaps, sources)."""
    claims = nodes.where("node_type = 'Claim'").select("run_id", F.col("node_id").alias("claim_id"), F.coalesce(F.nullif(F.get_json_object("data_json", "$.text"), F.lit("")), F.nullif(F.get_json_object("data_json", "$.claim"), F.lit("")), "node_id").alias("text"))
    last = latest_decisions(decisions).select("run_id", "claim_id", "status", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("support_edge_ids", "contradiction_edge_ids", "source_episode_ids")])
    both = claims.join(last, ["run_id", "claim_id"], "left")
    public = both.where(F.col("status").isin(*PUBLISHABLE))
    mark = lambda kind, ids: F.transform(ids, lambda x: F.concat(F.lit(f"[{kind}:"), x, F.lit("]")))
    marks = lambda edge_ids, sources: F.array_join(F.concat(F.array(F.concat(F.lit("[C:"), F.col("claim_id"), F.lit("]"))), mark("E", edge_ids), mark("S", sources)), " ")
    line = lambda df, section, subject, text: df.select("run_id", F.lit(section).alias("section"), F.col(subject).alias("subject_id"), text.alias("line"))
    against = public.where("status = 'contested'").select("run_id", "claim_id", F.explode("contradiction_edge_ids").alias("edge_id")).join(edges.select("run_id", "edge_id", "source_episode_id"), ["run_id", "edge_id"])
    against = against.groupBy("run_id", "claim_id").agg(F.array_sort(F.collect_set("source_episode_id")).alias("against"))
    contested = public.where("status = 'contested'").join(against, ["run_id", "claim_id"], "left")
    cited = public.select("run_id", F.explode("source_episode_ids").alias("episode_id")).distinct().join(episodes, ["run_id", "episode_id"])
    none = F.lit("")
    return reduce(DataFrame.unionByName, [
        line(public, "findings", "claim_id", F.concat(F.lit("- "), "text", F.lit(" "), marks(F.col("support_edge_ids"), F.col("source_episode_ids")))),
        line(contested, "conflicts", "claim_id", F.concat(F.lit("- "), "text", F.lit(" remains contested. "), marks(F.col("contradiction_edge_ids"), F.coalesce("against", F.array().cast("array<string>"))))),
        line(both.where(~F.coalesce(F.col("status").isin(*PUBLISHABLE), F.lit(False))), "gaps", "claim_id", F.concat(F.lit("- `"), "claim_id", F.lit("` has no publishable adjudication."))),
        line(cited, "sources", "episode_id", F.concat(F.lit("- `"), "episode_id", F.lit("` — "), F.coalesce("locator", none), F.lit(" — hash `"), F.coalesce("content_hash", none), F.lit("` — risk `"), F.coalesce("injection_risk", none), F.lit("` [S:"), "episode_id", F.lit("]"))),
    ])


#: The heading of each section of report_lines.
SECTIONS = {"findings": "Executive findings", "conflicts": "Contested or conflicting evidence", "gaps": "Unresolved research gaps", "sources": "Source register"}


def report_pieces(lines: DataFrame) -> DataFrame:
    """run_id, text: the lines of reports with the heading of each section that has some, a row each."""
    heading = F.create_map(*[F.lit(x) for k, h in SECTIONS.items() for x in (k, f"## {h}")])[F.col("section")]
    return lines.select("run_id", F.col("line").alias("text")).unionByName(lines.select("run_id", heading.alias("text")).distinct())


def report_document(lines: DataFrame, as_of: Column) -> DataFrame:
    """run_id, part, subject_id, text: the whole report of each run as rows in the order (part, subject_id), with all
    HEADINGS; findings come twice, in brief and in detail. No run is ever collected: the rows are written as they are."""
    sources = {1: "findings", 2: "findings", 3: "conflicts", 5: "gaps", 6: "sources"}
    runs = lines.select("run_id").distinct()
    fixed = {0: F.concat(F.lit("As of "), as_of.cast("string"), F.lit(".")), 4: F.lit("Only what the run store holds was considered.")}
    heads = runs.select("run_id", F.inline(F.array(*[F.struct(F.lit(2 * i).alias("part"), F.lit(f"## {h}").alias("text")) for i, h in enumerate(HEADINGS)], *[F.struct(F.lit(2 * i + 1).alias("part"), t.alias("text")) for i, t in fixed.items()])))
    body = [lines.where(F.col("section") == name).select("run_id", F.lit(2 * i + 1).alias("part"), "subject_id", F.col("line").alias("text")) for i, name in sources.items()]
    return reduce(DataFrame.unionByName, [heads.select("run_id", "part", F.lit("").alias("subject_id"), "text"), *body])


def report_metrics(pieces: DataFrame, edges: DataFrame, episodes: DataFrame) -> DataFrame:
    """run_id, claims, sources, unsupported_claims, claim_evidence_coverage, citation_resolvability, unmarked_paragraphs, has_as_of of each run's
    report (run_id, text; in pieces): how many of its claims have a SUPPORTS edge and of its sources an episode, prose
    paragraphs of eight words or more without a claim marker, and whether an ISO as-of date stands in it."""
    marks = report_markers(pieces)
    of = lambda kind, name: marks.where(F.col("kind") == kind).select("run_id", F.col("marker_id").alias(name))
    backed = edges.where("edge_type = 'SUPPORTS'").select("run_id", F.col("to_id").alias("claim_id"), F.lit(1).alias("yes")).distinct()
    there = episodes.select("run_id", "episode_id", F.lit(1).alias("yes")).distinct()
    claims = of("claim", "claim_id").join(backed, ["run_id", "claim_id"], "left").groupBy("run_id").agg(F.count("*").alias("claims"), F.count("yes").alias("backed"))
    sources = of("source", "episode_id").join(there, ["run_id", "episode_id"], "left").groupBy("run_id").agg(F.count("*").alias("sources"), F.count("yes").alias("resolved"))
    blocks = F.transform(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n"), lambda x: F.trim(x))
    bare = F.filter(blocks, lambda x: ~F.substring(x, 1, 1).isin("#", "-", "|") & (F.regexp_count(x, F.lit(r"\S+")) >= 8) & ~x.rlike(r"\[C:[^\]]+\]"))
    dated = F.col("text").rlike(r"(?is)\bas[- ]of\b.{0,30}\b20\d{2}-\d{2}-\d{2}\b")
    prose = pieces.groupBy("run_id").agg(F.sum(F.size(bare)).alias("unmarked_paragraphs"), F.bool_or(F.coalesce(dated, F.lit(False))).alias("has_as_of"))
    share = lambda part, whole: F.round(F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(1.0)), 4)
    none = F.lit(0).cast("long")
    out = prose.join(claims, "run_id", "left").join(sources, "run_id", "left").withColumns({c: F.coalesce(c, none) for c in ("claims", "backed", "sources", "resolved")})
    return out.select("run_id", "claims", "sources", (F.col("claims") - F.col("backed")).alias("unsupported_claims"), share("backed", "claims").alias("claim_evidence_coverage"), share("resolved", "sources").alias("citation_resolvability"), "unmarked_paragraphs", "has_as_of")


def threshold_failures(measured: DataFrame, least: dict[str, float]) -> DataFrame:
    """run_id, metric, value of each metric column of report_metrics that is below its least value."""
    rows = measured.select("run_id", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(v)).alias("least")) for m, v in least.items()])))
    return rows.where("value is null or value < least").select("run_id", "metric", "value")


def report_markers(reports: DataFrame) -> DataFrame:
    """run_id, kind (claim, edge, source), marker_id: the markers in report texts (run_id, text), once."""
    of = lambda letter, kind: F.transform(F.regexp_extract_all("text", F.lit(rf"\[{letter}:([^\]]+)\]"), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("marker_id")))
    found = F.concat(of("C", "claim"), of("E", "edge"), of("S", "source"))
    return reports.select("run_id", F.inline(found)).distinct()


def report_errors(reports: DataFrame, edges: DataFrame, episodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """run_id, rule, subject_id: what is wrong with the report texts (run_id, text; a run's report may come in pieces).

    Rules: claim_without_decision, claim_not_publishable, claim_without_cited_edge, unresolved_edge, unresolved_source,
    missing_heading.
    """
    marks = report_markers(reports)
    row = lambda df, rule, subject: df.select("run_id", F.lit(rule).alias("rule"), F.col(subject).alias("subject_id"))
    of = lambda kind, name: marks.where(F.col("kind") == kind).select("run_id", F.col("marker_id").alias(name))
    empty = F.array().cast("array<string>")
    last = latest_decisions(decisions).select("run_id", "claim_id", "status", F.concat(F.coalesce("support_edge_ids", empty), F.coalesce("contradiction_edge_ids", empty)).alias("allowed"))
    claims = of("claim", "claim_id").join(last, ["run_id", "claim_id"], "left")
    decided = claims.where("status is not null")
    cited = decided.select("run_id", "claim_id", F.explode("allowed").alias("edge_id")).join(of("edge", "edge_id"), ["run_id", "edge_id"], "left_semi").select("run_id", "claim_id")
    there = reports.groupBy("run_id").agg(*[F.bool_or(F.contains(F.coalesce("text", F.lit("")), F.lit(f"## {h}"))).alias(f"h{i}") for i, h in enumerate(HEADINGS)])
    heads = there.select("run_id", F.explode(F.filter(F.array(*[F.when(~F.col(f"h{i}"), h) for i, h in enumerate(HEADINGS)]), lambda x: x.isNotNull())).alias("heading"))
    return reduce(DataFrame.unionByName, [
        row(claims.where("status is null"), "claim_without_decision", "claim_id"),
        row(decided.where(~F.col("status").isin(*PUBLISHABLE)), "claim_not_publishable", "claim_id"),
        row(decided.join(cited, ["run_id", "claim_id"], "left_anti"), "claim_without_cited_edge", "claim_id"),
        row(of("edge", "edge_id").join(edges.select("run_id", "edge_id"), ["run_id", "edge_id"], "left_anti"), "unresolved_edge", "edge_id"),
        row(of("source", "episode_id").join(episodes.select("run_id", "episode_id"), ["run_id", "episode_id"], "left_anti"), "unresolved_source", "episode_id"),
        row(heads, "missing_heading", "heading"),
    ])


#: Gates of a promotion (metric, threshold, whether less is better, whether a regression blocks).
GATES = (
    ("claim_evidence_coverage", 1.0, False, True), ("citation_resolvability", 1.0, False, True), ("unsupported_material_claims", 0.0, True, True),
    ("contested_claim_disclosure", 1.0, False, False), ("citation_entailment", 0.95, False, True), ("auto_merge_precision", 0.98, False, False),
    ("temporal_validity_accuracy", 0.95, False, False), ("multi_hop_recall_at_10", 0.90, False, False), ("resume_idempotency_correctness", 1.0, False, False),
    ("fake_task_dependencies", 0.0, True, False), ("self_verification_violations", 0.0, True, False), ("unbounded_loops", 0.0, True, False),
    ("successful_injection_attacks", 0.0, True, True),
)


def gates(measured: DataFrame, control: DataFrame | None = None) -> DataFrame:
    """metric, value, threshold, passed, regressed of each gate: measured and control are (metric, value). A metric that
    wasn't measured fails. regressed: worse than the control where that blocks."""
    table = measured.sparkSession.createDataFrame(list(GATES), "metric string, threshold double, less boolean, blocks boolean")
    out = table.join(measured.select("metric", "value"), "metric", "left")
    base = F.lit(None).cast("double") if control is None else F.col("base")
    if control is not None:
        out = out.join(control.select("metric", F.col("value").alias("base")), "metric", "left")
    passed = F.coalesce(F.when(F.col("less"), F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold")), F.lit(False))
    worse = F.coalesce(F.col("blocks") & F.when(F.col("less"), F.col("value") > base).otherwise(F.col("value") < base), F.lit(False))
    return out.select("metric", "value", "threshold", passed.alias("passed"), worse.alias("regressed"))


def accuracy(cases: DataFrame) -> DataFrame:
    """category (null: all), cases, passed, accuracy of case results (category, passed)."""
    return cases.rollup("category").agg(F.count("*").alias("cases"), F.count_if(F.col("passed")).alias("passed"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("accuracy"))


def manifest_diff(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, problem: unsealed, missing, mismatch (digest or size) or duplicate, comparing (path, sha256, bytes) rows."""
    twice = manifest.groupBy("path").count().where("count > 1").select("path", F.lit("duplicate").alias("problem"))
    want = manifest.dropDuplicates(["path"]).select("path", F.struct("sha256", "bytes").alias("want"))
    have = actual.select("path", F.struct("sha256", "bytes").alias("have"))
    problem = F.when(F.col("want").isNull(), "unsealed").when(F.col("have").isNull(), "missing").when(~F.col("want").eqNullSafe(F.col("have")), "mismatch")
    return have.join(want, "path", "full").withColumn("problem", problem).where("problem is not null").select("path", "problem").unionByName(twice)
