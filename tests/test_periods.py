from __future__ import annotations

import random

import pytest

from tessera.operators import periods

from .helpers import edge, edges, rows


def brute(spans):
    """Merged periods and gaps of (lo, hi) spans."""
    merged = []
    for lo, hi in sorted(s for s in spans if s[0] < s[1]):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return [tuple(m) for m in merged], [(a[1], b[0]) for a, b in zip(merged, merged[1:], strict=False)]


@pytest.mark.parametrize("shard", [7, 64, 1000])
def test_random_intervals_match_brute_force(spark, shard):
    rng = random.Random(shard)
    data = []
    for key in "abcd":
        for _ in range({"a": 200, "b": 30, "c": 3, "d": 1}[key]):
            lo = rng.randrange(2000)
            data.append((key, lo, rng.choice([lo, lo + rng.randrange(1, 40), lo + rng.randrange(1, 40), lo + rng.randrange(60)])))
    data += data[:20]
    df = spark.createDataFrame(data, "k string, lo long, hi long")
    got_gaps, got_periods = rows(periods.gaps(df, ["k"], shard)), rows(periods.periods(df, ["k"], shard))
    want_gaps, want_periods = [], []
    for key in "abcd":
        p, g = brute([(lo, hi) for k, lo, hi in data if k == key])
        want_periods += [(key, *x) for x in p]
        want_gaps += [(key, *x) for x in g]
    assert got_gaps == sorted(want_gaps, key=repr)
    assert got_periods == sorted(want_periods, key=repr)


def test_open_touching_empty_and_null_keys(spark):
    df = spark.createDataFrame([(None, 0, 10), (None, 10, 20), (None, 30, periods.FOREVER), ("x", 5, 5), ("y", 1, 2)], "k string, lo long, hi long")
    assert rows(periods.gaps(df, ["k"], 8)) == [(None, 20, 30)]
    assert rows(periods.periods(df, ["k"], 8)) == [("y", 1, 2), (None, 0, 20), (None, 30, None)]


def test_edges_end_with_their_successor(spark):
    df = edges(
        spark,
        edge("e1", 0, 100),
        edge(" E2\t", 50, 60, supersedes=" E1 "),  # closes e1 at 50, ends at 60
        edge("e3", 80, None),
        edge("e4", None, 70),  # no start
        edge("e5", 65, 65),  # empty
        edge("e6", 1, 2, supersedes="nowhere"),
        edge("e3", 80, None, recorded_at=9),  # delivered again
    )
    assert rows(periods.edge_gaps(df), "gap_from", "gap_to") == [("2024-01-03T12:00:00Z", "2024-01-04T08:00:00Z")]
    assert rows(periods.edge_continuous_periods(df), "period_from", "period_to") == [("2024-01-01T00:00:00Z", "2024-01-03T12:00:00Z"), ("2024-01-04T08:00:00Z", None)]


def test_empty_table_and_extra_columns(spark):
    assert rows(periods.edge_gaps(edges(spark))) == []
    extra = edges(spark, edge("e1", 0, 1), edge("e2", 2, 3)).selectExpr("*", "1 as lo", "2 as hi", "3 as shard", "'x' as runs")
    assert len(rows(periods.edge_gaps(extra))) == 1
