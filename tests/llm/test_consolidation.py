from __future__ import annotations

import random
from datetime import datetime

from tessera.llm import consolidation

SCHEMA = "run_id string, proposal_id string, left_id string, right_id string, canonical_id string, decision string, created_at timestamp_ntz, reversed_at timestamp_ntz"


def proposals(spark, links, run="r", decision="auto_merge", reversed_at=None):
    return spark.createDataFrame([(run, f"p{i}", a, b, None, decision, None, reversed_at) for i, (a, b) in enumerate(links)], SCHEMA)


def brute(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return sorted(("r", find(n), n) for n in list(parent))


def got(df):
    return sorted(tuple(r) for r in consolidation.consolidate(df).collect())


def test_chains_stars_and_random_links(spark):
    rng = random.Random(5)
    chain = [(f"c{i:04}", f"c{i + 1:04}") for i in range(400)]
    shuffled = [(f"s{a:03}", f"s{b:03}") for a, b in zip(rng.sample(range(200), 200), rng.sample(range(200), 200), strict=True)]
    star = [("hub", f"x{i:03}") for i in range(300)]
    loose = [(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(60)]
    links = chain + shuffled + star + loose
    links += [(b, a) for a, b in links[:100]]
    assert got(proposals(spark, links)) == brute(links)


def test_only_accepted_links_of_the_run_count(spark):
    df = proposals(spark, [("a", "B "), (" b", "c")]).unionByName(proposals(spark, [("c", "d")], decision="review"))
    df = df.unionByName(proposals(spark, [("x", "y"), ("z", None), ("q", "q"), ("", "w")], run="other"))
    df = df.unionByName(proposals(spark, [("d", "e")], reversed_at=datetime(2024, 1, 1)))
    assert got(df) == [("other", "x", "x"), ("other", "x", "y"), ("r", "a", "a"), ("r", "a", "b"), ("r", "a", "c")]


def test_empty_table_and_clashing_columns(spark):
    empty = proposals(spark, [])
    assert got(empty) == []
    assert got(proposals(spark, [("a", "b")]).selectExpr("*", "1 as node", "2 as up", "3 as hi", "4 as member")) == [("r", "a", "a"), ("r", "a", "b")]
