from __future__ import annotations

import json


from tessera.streaming import events

LOG = "seq long, run_id string, task_id string, event_type string, idempotency_key string, payload string, created_at timestamp, lease_expires_at timestamp"


def write(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def event(seq, hour, kind="E", key=None, task="t", lease=None):
    out = {"seq": seq, "run_id": "r", "task_id": task, "event_type": kind, "idempotency_key": key or f"k{seq}", "created_at": f"2024-01-{1 + hour // 24:02}T{hour % 24:02}:00:00Z"}
    return out | ({"lease_expires_at": f"2024-01-{1 + lease // 24:02}T{lease % 24:02}:00:00Z"} if lease is not None else {})


def run(spark, stream, tmp_path, name):
    events.run_to_table(stream, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")).awaitTermination()
    return spark.read.parquet(str(tmp_path / name))


def test_repeats_are_taken_once_and_the_stream_goes_on(spark, tmp_path):
    write(tmp_path / "log", "a.json", [event(1, 0, key="x"), event(2, 1, key="x"), event(3, 2, key="y")])
    stream = lambda: events.append_once(events.read_log(spark, str(tmp_path / "log"), LOG))
    assert run(spark, stream(), tmp_path, "once").count() == 2
    write(tmp_path / "log", "b.json", [event(4, 3, key="y"), event(5, 3, key="z")])
    assert {r.idempotency_key for r in run(spark, stream(), tmp_path, "once").collect()} == {"x", "y", "z"}


def test_windows_close_behind_the_watermark(spark, tmp_path):
    write(tmp_path / "log", "a.json", [event(1, 0), event(2, 0), event(3, 100)])
    counts = run(spark, events.windowed_counts(events.read_log(spark, str(tmp_path / "log"), LOG, 1)), tmp_path, "counts")
    write(tmp_path / "log", "b.json", [event(4, 300)])
    counts = run(spark, events.windowed_counts(events.read_log(spark, str(tmp_path / "log"), LOG, 1)), tmp_path, "counts")
    assert [r.events for r in counts.orderBy("window_start").collect()][:1] == [2]


def test_leases_expire_in_event_time(spark, tmp_path):
    write(tmp_path / "log", "a.json", [event(1, 0, "TASK_STARTED", task="a", lease=5), event(2, 0, "TASK_STARTED", task="b", lease=5), event(3, 1, "TASK_SUCCEEDED", task="b"), event(4, 2, "TASK_LEASE_RENEWED", task="c", lease=300)])
    make = lambda: events.expired_leases(events.read_log(spark, str(tmp_path / "log"), LOG, 1))
    run(spark, make(), tmp_path, "leases")
    write(tmp_path / "log", "b.json", [event(5, 50, "OTHER", task="d")])
    run(spark, make(), tmp_path, "leases")
    write(tmp_path / "log", "c.json", [event(6, 51, "OTHER", task="d")])
    got = run(spark, make(), tmp_path, "leases").collect()
    assert [(r.task_id, r.event) for r in got] == [("a", "TASK_LEASE_EXPIRED")]
