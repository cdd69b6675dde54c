from __future__ import annotations

import random

import pytest

from tessera.operators import hierarchy

from .helpers import rows, t

SCHEMA = "run_id string, task_id string, depends_on string, registered_at timestamp_ntz"


def deps(spark, *pairs, run="r"):
    return spark.createDataFrame([(run, c, p, t(0)) for c, p in pairs], SCHEMA)


def reach(pairs):
    below = {}
    for c, p in pairs:
        if p is not None:
            below.setdefault(p, set()).add(c)
    out = set()
    for start in {x for pair in pairs for x in pair if x is not None}:
        todo, seen = list(below.get(start, ())), set()
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo.extend(below.get(n, ()))
        out |= {(start, n) for n in seen}
    return out


@pytest.mark.parametrize("bound", [0, 45, 500_000])
def test_random_graphs_match_brute_force(spark, bound):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(38)] + [("n1", None), ("lone", None)]
    df = deps(spark, *pairs, *pairs[:4])
    want = reach(pairs)
    assert rows(hierarchy.tasks_in_cycles(df, bound)) == sorted(("r", a) for a, b in want if a == b)
    assert rows(hierarchy.task_descendants(df, bound)) == sorted(("r", a, b) for a, b in want)


@pytest.mark.parametrize("bound", [0, 500_000])
def test_paths_lead_from_roots_over_links(spark, bound):
    pairs = [("b", "a"), ("c", "b"), ("d", "b"), ("d", "a"), ("y", "x"), ("x", "y"), ("z", "y"), ("s", "s"), ("lone", None), ("q", " B\t")]
    got = {r.task_id: r for r in hierarchy.task_paths(deps(spark, *pairs), bound).collect()}
    assert set(got) == set("abcdxyzsq") | {"lone"}
    assert got["c"].path == ["a", "b", "c"] and got["c"].depth == 2 and got["c"].root_id == "a"
    assert got["q"].path == ["a", "b", "q"]
    assert got["d"].path == ["a", "d"]
    assert got["x"].root_id == "x" and got["z"].path == ["x", "y", "z"]
    assert {k for k, r in got.items() if r.in_cycle} == {"x", "y", "s"}
    assert got["lone"].depth == 0


def test_back_edges_and_runs_apart(spark):
    df = deps(spark, ("b", "a"), ("a", "b")).unionByName(deps(spark, ("b", "a"), run="other"))
    assert rows(hierarchy.back_edges(df)) == [("r", "b", "a")]
    assert rows(hierarchy.tasks_in_cycles(df)) == [("r", "a"), ("r", "b")]


def test_long_chain_nulls_and_empty(spark):
    n = 3000
    chain = deps(spark, *[(f"t{i:05}", f"t{i - 1:05}") for i in range(1, n)])
    deepest = hierarchy.task_paths(chain).selectExpr("max(depth) as d").first().d
    assert deepest == n - 1
    assert rows(hierarchy.tasks_in_cycles(chain)) == []
    assert rows(hierarchy.tasks_in_cycles(deps(spark, ("a", None), ("b", ""), ("c", " \t"), (None, "a")))) == []
    assert rows(hierarchy.task_paths(chain.limit(0))) == []


def test_clashing_columns(spark):
    df = deps(spark, ("a", "b"), ("b", "a"), ("c", "b")).selectExpr("*", "1 as child", "2 as parent", "3 as component", "4 as node", "5 as up")
    assert rows(hierarchy.tasks_in_cycles(df)) == [("r", "a"), ("r", "b")]
    assert len(rows(hierarchy.task_descendants(df))) == 6


def test_both_bounds_give_the_same_paths_and_back_edges(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(50)}", f"n{rng.randrange(50)}") for _ in range(45)] + [("s", "s"), ("below", "loop2"), ("loop1", "loop2"), ("loop2", "loop1"), ("loop2", "loop2")]
    pairs += [("d", "b"), ("b", "a"), ("c", "b"), ("d", "c"), ("d", "a")]  # more ways than one
    df = deps(spark, *pairs).unionByName(deps(spark, *pairs[:9], run="other"))
    assert rows(hierarchy.task_paths(df, 0)) == rows(hierarchy.task_paths(df))
    back = rows(hierarchy.back_edges(df))
    assert rows(hierarchy.back_edges(df, 0)) == back
    closed = reach(pairs)
    assert all((b, a) in closed or a == b for run, a, b in back if run == "r")  # each is on a cycle
    kept = [(c, p) for c, p in pairs if ("r", p, c) not in back]
    assert not any(a == b for a, b in reach(kept))  # none is left without them


@pytest.mark.parametrize("bound", [0, 500_000])
def test_back_edges_close_a_cycle_and_paths_are_shortest(spark, bound):
    # two cycles, and a link from the one to the other that closes none
    two = deps(spark, ("b", "a"), ("a", "b"), ("c", "b"), ("d", "c"), ("c", "d"), ("a", "root"))
    assert rows(hierarchy.back_edges(two, bound)) == [("r", "b", "a"), ("r", "d", "c")]
    got = {r.task_id: r.path for r in hierarchy.task_paths(deps(spark, ("b", "a"), ("c", "b"), ("d", "c"), ("d", "a"), ("0", "y"), ("y", "x"), ("x", "y")), bound).collect()}
    assert got["d"] == ["a", "d"] and got["0"] == ["x", "y", "0"]


def test_chains_are_contracted(spark):
    """Long chains, circles and chains between cycles, by the whole cluster, give what one task gives."""
    chain = [(f"t{i:04}", f"t{i - 1:04}") for i in range(1, 400)]
    circle = [(f"c{i:03}", f"c{(i - 1) % 150:03}") for i in range(150)]
    # a cycle of two with a long way round, a tail, and a chain from one cycle to another
    knot = [("k000", "k001"), ("k001", "k000"), ("k002", "k001"), *[(f"k{i:03}", f"k{i - 1:03}") for i in range(3, 40)], ("k000", "k039"), ("tail", "k020")]
    two = [("x1", "x0"), ("x0", "x1"), ("m1", "x1"), ("m2", "m1"), ("m3", "m2"), ("y0", "m3"), ("y1", "y0"), ("y0", "y1"), ("y1", "y1")]
    pairs = chain + circle + knot + two
    df = deps(spark, *pairs)
    want = sorted(("r", x) for x in [*(c for c, _ in circle), *(f"k{i:03}" for i in range(40)), "x0", "x1", "y0", "y1"])
    assert rows(hierarchy.tasks_in_cycles(df)) == want
    groups = {r.task_id: r.group_id for r in hierarchy.cyclic_groups(hierarchy.links_of(df)).collect()}
    assert sorted(groups) == [x for _, x in want]
    assert {groups[c] for c, _ in circle} == {"c149"} and groups["k005"] == "k039" and groups["x0"] == "x1" and groups["y1"] == "y1"


def test_many_levels_stay_small(spark):
    """Paths are handed on by their elements, not by rows."""
    import pandas as pd

    n = 5000
    batch = pd.DataFrame({"run_id": "r", "component": None, "child": [f"t{i:05}" for i in range(1, n)], "parent": [f"t{i:05}" for i in range(n - 1)]})
    sizes = [sum(map(len, out["path"])) for out in hierarchy._paths(iter([batch]))]
    assert sum(sizes) == n * (n + 1) // 2 and max(sizes) <= hierarchy.PATH_ELEMENTS + n
