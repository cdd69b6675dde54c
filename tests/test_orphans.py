from __future__ import annotations

from tessera.operators import orphans

from .helpers import rows

REFS = "table_name string, run_id string, row_id string, ref_id string, ref_time long"
PARENTS = "table_name string, run_id string, ref_id string, arrived long, deleted long"


def test_reasons(spark):
    refs = spark.createDataFrame([("t", "r", f"row{i}", ref, at) for i, (ref, at) in enumerate([("p", 10), ("p", 4), ("p", 20), ("gone", 5), ("P2", 5), ("p2", None), ("p3", 1)])] + [("t", "other", "row9", "p", 10)], REFS)
    parents = spark.createDataFrame([("t", "r", "p", 5, 20), ("t", "r", "p2", 9, 9), ("t", "r", "p3", None, None), ("u", "r", "gone", 1, None)], PARENTS)
    got = {(r.run_id, r.row_id): r.reason for r in orphans.orphans(refs, parents).collect()}
    assert got == {("r", "row1"): "later", ("r", "row2"): "deleted", ("r", "row3"): "missing", ("r", "row4"): "missing", ("other", "row9"): "missing"}


def test_no_parents_and_no_references(spark):
    refs, parents = spark.createDataFrame([("t", "r", "x", "p", 1)], REFS), spark.createDataFrame([], PARENTS)
    assert [r.reason for r in orphans.orphans(refs, parents).collect()] == ["missing"]
    assert rows(orphans.orphans(refs.limit(0), parents)) == []


def test_filter_is_bounded_and_never_wrong(spark):
    many = spark.range(5000).selectExpr("'t' as table_name", "'r' as run_id", "concat('p', id) as ref_id", "0L as arrived", "cast(null as long) as deleted")
    refs = spark.range(10000).selectExpr("'t' as table_name", "'r' as run_id", "concat('row', id) as row_id", "concat('p', id) as ref_id", "1L as ref_time")
    assert orphans.orphans(refs, many).count() == 5000
    assert orphans.orphan_counts(orphans.orphans(refs, many)).first().orphans == 5000


def test_run_store_tables_with_nulls_repeats_and_clashing_columns(spark):
    from .helpers import edge, edges, t

    deps = spark.createDataFrame([("r", "a", " P ", t(1)), ("r", "a", "p", t(9)), ("r", "b", None, t(1)), ("r", "c", " ", None), (None, None, None, None)], "run_id string, task_id string, depends_on string, registered_at timestamp_ntz")
    verifications = spark.createDataFrame([("r", "d1", "c1", t(5)), ("r", None, "c2", None)], "run_id string, decision_id string, claim_id string, created_at timestamp_ntz")
    refs = orphans.run_store_references(deps.selectExpr("*", "1 as ref_id", "2 as row_id"), edges(spark, edge("e1", 0, source="ep")), verifications)
    assert rows(refs, "table_name", "row_id", "ref_id") == [("claim_verifications", "d1", "c1"), ("claim_verifications", None, "c2"), ("graph_edges", "e1", "ep"), ("task_dependencies", "a", "p")]
    tasks = spark.createDataFrame([("r", "P", t(3), None), ("r", "p", t(0), None)], "run_id string, task_id string, registered_at timestamp_ntz, deleted_at timestamp_ntz")
    episodes = spark.createDataFrame([("r", "ep", t(7), None)], "run_id string, episode_id string, retrieved_at timestamp_ntz, deleted_at timestamp_ntz")
    nodes = spark.createDataFrame([("r", "c1", "Claim", t(0), t(5)), ("r", "c2", "Product", t(0), None)], "run_id string, node_id string, node_type string, created_at timestamp_ntz, deleted_at timestamp_ntz")
    got = {(r.table_name, r.ref_id): r.reason for r in orphans.orphans(refs, orphans.run_store_parents(tasks, episodes, nodes)).collect()}
    assert got == {("graph_edges", "ep"): "later", ("claim_verifications", "c1"): "deleted", ("claim_verifications", "c2"): "missing"}


def test_plan_does_not_grow_with_the_parents(spark):
    refs = spark.createDataFrame([("t", "r", "x", "p1", 1), ("t", "r", "y", "gone", 1)], REFS)

    def found(n):
        return orphans.orphans(refs, spark.range(n).selectExpr("'t' as table_name", "'r' as run_id", "concat('p', id) as ref_id", "0L as arrived", "cast(null as long) as deleted"))

    few, many = found(10), found(200_000)
    assert [r.row_id for r in many.collect()] == ["y"]
    assert len(many._jdf.queryExecution().toString()) < 2 * len(few._jdf.queryExecution().toString())


def test_filter_table_holds_every_key_and_few_others(spark):
    from pyspark.sql import functions as F

    keys = spark.range(20_000).selectExpr("concat('p', id) as ref_id")
    bloom = orphans.bloom_filter(keys, F.xxhash64("ref_id"), 20_000)
    assert bloom[0].selectExpr("sum(size(__words))").first()[0] == bloom[1]
    asked = spark.range(40_000).selectExpr("concat('p', id) as ref_id", "id < 20000 as there")
    got = {r.there: r.n for r in orphans.with_possible(asked, bloom, F.xxhash64("ref_id")).where("__possible").groupBy("there").agg(F.count("*").alias("n")).collect()}
    assert got[True] == 20_000 and got.get(False, 0) < 600


def test_repeated_references_are_one_of_the_earliest_time(spark):
    refs = spark.createDataFrame([("t", "r", "x", "p", 9), ("t", "r", "x", "p", 4), ("t", "r", "y", "gone", 9), ("t", "r", "y", "gone", None), ("t", None, "z", "p", 9)], REFS)
    parents = spark.createDataFrame([("t", "r", "p", 5, None), ("t", None, "p", 5, None)], PARENTS)
    assert rows(orphans.orphans(refs, parents), "row_id", "ref_time", "reason") == [("x", 4, "later"), ("y", 9, "missing"), ("z", 9, "missing")]
