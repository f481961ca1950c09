"""The event log in batch and as a stream."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright.operators import events
from tracewright.plans import events as plans
from tracewright.session import clear_stored, stored
from tracewright.streaming import log

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
T = datetime(2024, 1, 1)


def rows(spark, *data):
    return spark.createDataFrame([(i, T + timedelta(minutes=m), u, k, v) for i, m, u, k, v in data], SCHEMA)


def some(spark):
    return rows(spark, (1, 0, 7, "a", 1.0), (2, 0, 7, "b", None), (3, 5, 8, "a", 2.0), (4, 300, 7, "a", 3.0), (5, 300, None, "c", 3.0))


def test_cursor_skips_nothing_of_one_instant(spark):
    got = {r.event_id for r in events.since(some(spark), "2024-01-01 00:00:00", 1).collect()}
    assert got == {2, 3, 4, 5}


def test_batch_operators(spark):
    e = some(spark)
    last = {r.user_id: (r.event_id, r.n_versions) for r in events.latest(e, ["user_id"], ["ts", "event_id"], "event_id").collect()}
    assert last == {7: (4, 3), 8: (3, 1), None: (5, 1)}
    assert {r.event_id: r.prior_value for r in events.previous(e, "user_id", "value").collect()} == {1: None, 2: 1.0, 3: None, 4: None, 5: None}
    top = events.top_k(e, "event_type", 1, F.desc_nulls_last("value"), F.col("event_id"))
    assert {r.event_type: r.event_id for r in top.collect()} == {"a": 4, "b": 2, "c": 5}
    share = {r.event_id: (r.seen, r.of_kind) for r in events.running_share(e, "user_id", F.col("event_type") == "a").collect()}
    assert share[2] == (2, 1) and share[4] == (3, 2)
    s = sorted((r.user_id, r.n) for r in events.sessions(e.filter("user_id IS NOT NULL"), "user_id").collect())
    assert s == [(7, 1), (7, 2), (8, 1)]
    assert events.latest(e.limit(0), ["user_id"], ["ts"], "event_id").count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_equal_batch_and_go_on(spark, tmp_path, parts):
    path = str(tmp_path / "log")
    some(spark).repartition(parts).write.parquet(path)
    tail = lambda: log.tail(spark, path, some(spark).schema)
    folder = str(tmp_path / "out")
    first = {tuple(r) for r in log.drain(log.counts(tail()), "complete", folder).collect()}
    assert first == {tuple(r) for r in log.counts(some(spark)).collect()}
    rows(spark, (6, 400, 8, "a", 1.0)).write.mode("append").parquet(path)
    again = {tuple(r) for r in log.drain(log.counts(tail()), "complete", folder).collect()}
    assert again == {("a", 4), ("b", 1), ("c", 1)}
    state = {tuple(r) for r in log.drain(log.state(tail()), "complete").collect()}
    assert state == {(7, 4, "a", 3), (8, 6, "a", 2), (None, 5, "c", 1)}


def test_late_events_are_dropped_after_the_watermark(spark, tmp_path):
    path = str(tmp_path / "log")
    for k, m in enumerate((0, 3000, 10)):  # the third is two days late
        rows(spark, (k, m, 1, "a", 1.0)).write.mode("append").parquet(path)
    got = log.drain(log.windowed(log.tail(spark, path, some(spark).schema, files_per_batch=1)), "append")
    assert [(r.start, r.n) for r in got.collect()][0][0] == T


def test_windows_do_not_depend_on_the_files(spark, tmp_path):
    e = rows(spark, *((i, 97 * i, i % 5, "ab"[i % 2], 1.0) for i in range(200)))
    got = []
    for parts in (1, 12):
        (e.coalesce(1) if parts == 1 else e.repartition(parts, "event_id")).write.parquet(f"{tmp_path}/{parts}/events.parquet")
        got.append(sorted(tuple(r) for r in plans.stream_windows(spark, f"{tmp_path}/{parts}").select("start", "event_type", "n").collect()))
    batch = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    final = batch.filter(F.col("w.end") <= T + timedelta(minutes=97 * 199) - timedelta(hours=1))
    assert got[0] == got[1] == sorted(tuple(r) for r in final.select(F.unix_micros("w.start"), "event_type", "n").collect())
    assert got[0]


def test_appended_events_come_back_in_order(spark, tmp_path):
    path = str(tmp_path / "log")
    for kind in ("start", "stop"):
        log.append(spark.createDataFrame([("agent", kind, "{}")], "actor string, kind string, payload string"), path)
    got = spark.read.parquet(path).orderBy("ts").collect()
    assert [r.kind for r in got] == ["start", "stop"] and len({r.event_id for r in got}) == 2


@pytest.mark.parametrize("files", [None, 1])
def test_batches_of_a_stream_give_what_one_batch_gives(spark, tmp_path, files):
    path = str(tmp_path / "log")
    some(spark).repartition(3).write.parquet(path)
    stream = log.tail(spark, path, some(spark).schema, files)
    got = log.each_batch(stream, lambda b: b.select("event_id", (F.col("value") * 2).alias("v")))
    assert got.columns == ["event_id", "v"]
    assert sorted(got.collect(), key=lambda r: r.event_id) == some(spark).select("event_id", (F.col("value") * 2).alias("v")).orderBy("event_id").collect()


def test_stored_tables_keep_schema_and_go_away(spark):
    df = spark.createDataFrame([(1, None, [1, 2])], "a long, b string, c array<int>")
    kept = stored(df)
    assert kept.schema == df.schema and kept.collect() == df.collect()
    empty = stored(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["a", "b", "c"]
    clear_stored()
