from __future__ import annotations

import random

import pytest

from tessera.operators import as_known

from .helpers import edge, edges, rows, t


def brute(trace_rows, edge_rows):
    """The rule of the statement, edge by edge."""
    by_id = {}
    for e in edge_rows:
        k = (e[0], e[1])
        if k not in by_id or (e[8] is not None and (by_id[k][8] is None or e[8] < by_id[k][8])):
            by_id[k] = e
    successors = {}
    for e in by_id.values():
        if e[12] and e[12] != e[1]:
            successors[(e[0], e[12])] = e
    out = set()
    for run, trace, anchor, kind, at in trace_rows:
        best = None
        for e in by_id.values():
            if at is None or (e[0], e[3], e[2]) != (run, anchor, kind) or e[6] is None or e[8] is None or e[8] > at or e[6] > at:
                continue
            s = successors.get((run, e[1]))
            if s is None:
                end = e[7]
            elif s[8] is None or s[8] > at:
                end = None
            else:
                end = min((x for x in (e[7], s[6]) if x is not None), default=None)
            if (end is None or end > at) and (best is None or (e[8], e[6], e[1]) > best):
                best = (e[8], e[6], e[1])
        if best:
            out.add((trace, best[2]))
    return sorted(out)


TRACE = "run_id string, trace_id string, anchor_id string, edge_type string, as_of timestamp_ntz"


@pytest.mark.parametrize("period", [3600, 12 * 3600, as_known.PERIOD_SECONDS])
def test_random_graph_matches_brute_force(spark, period):
    rng = random.Random(period)
    es = []
    for n in range(300):
        start = rng.choice([None, *range(0, 900, 7)]) if rng.random() < 0.1 else rng.randrange(900)
        end = None if rng.random() < 0.3 or start is None else start + rng.randrange(-5, 200)
        rec = None if rng.random() < 0.05 else (start or 0) + rng.randrange(-50, 200)
        es.append(edge(f"e{n:03}", start, end, rec, from_id=rng.choice("aaaab"), supersedes=None))
    taken = set()
    for n in range(0, 300, 3):  # every third edge supersedes an earlier one, each at most once
        target = f"e{rng.randrange(300):03}"
        if target not in taken and target != f"e{n:03}":
            taken.add(target)
            es[n] = (*es[n][:12], target)
    es += es[:10]
    ts = [("r", f"t{n}", rng.choice("ab"), "K", t(rng.randrange(-20, 1200)) if rng.random() < 0.95 else None) for n in range(300)]
    facts = as_known.known_spans(edges(spark, *es)).withColumnRenamed("edge_id", "fact_id")
    events = spark.createDataFrame(ts, TRACE).selectExpr("run_id", "anchor_id as from_id", "edge_type", "trace_id as event_id", "unix_seconds(cast(as_of as timestamp)) as at")
    assert rows(as_known.as_known(events, facts, ["run_id", "from_id", "edge_type"], period)) == brute(ts, es)


def test_later_knowledge_is_never_used(spark):
    es = edges(spark, edge("e1", 0, None, 0), edge("e2", 10, None, 50, supersedes="e1"))
    ask = lambda h: spark.createDataFrame([("r", "t", "a", "K", t(h))], TRACE)
    assert rows(as_known.traces_as_known(ask(20), es)) == [("t", "e1")]  # the successor isn't recorded yet
    assert rows(as_known.traces_as_known(ask(50), es)) == [("t", "e2")]


def test_ties_nulls_empty_tables_and_clashing_columns(spark):
    es = edges(spark, edge("e1", 0), edge("e2", 0), edge("e3", 0, 0))
    ts = spark.createDataFrame([("r", " T1 ", "A ", "K", t(5)), ("r", "t1", "a", "K", t(5)), ("r", None, "a", "K", t(5)), ("r", "t2", None, "K", t(5)), ("r", "t3", "a", None, t(5))], TRACE)
    clash = ts.selectExpr("*", "1 as period", "2 as kind", "3 as known_to", "4 as id")
    assert rows(as_known.traces_as_known(clash, es)) == [("t1", "e2")]
    assert rows(as_known.traces_as_known(ts, edges(spark))) == []
    assert rows(as_known.traces_as_known(ts.limit(0), es)) == []
