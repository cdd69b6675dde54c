"""Small builders for tests."""

from __future__ import annotations

from datetime import datetime, timedelta

T0 = datetime(2024, 1, 1)


def t(hours: float | None):
    return None if hours is None else T0 + timedelta(hours=hours)


EDGE_SCHEMA = "run_id string, edge_id string, edge_type string, from_id string, to_id string, ontology_version int, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_at timestamp_ntz, source_episode_id string, provenance_json string, status string, supersedes_edge_id string"


def edge(edge_id, valid_from, valid_to=None, recorded_at=0.0, supersedes=None, run="r", from_id="a", to_id="b", kind="K", source=None):
    return (run, edge_id, kind, from_id, to_id, 1, t(valid_from), t(valid_to), t(recorded_at), source, "{}", "active", supersedes)


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), EDGE_SCHEMA)


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
