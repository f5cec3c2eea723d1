"""Streams over split files give what the batch form gives on all of them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from galley.operators import routing, worklog
from galley.plans import prompt_load
from galley.session import scratch_path
from galley.sources import transcripts
from galley.streaming import operators as streaming
from galley.streaming import run
from workload import prompt_log

SF = "/root/testdata/sf0.001"


@pytest.fixture
def events(spark, tmp_path):
    """Events in time order, one file per tenth, read one file per batch."""
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    lowest, highest = rows.agg(F.min("event_id"), F.max("event_id")).first()
    path = str(tmp_path / "events")
    part = F.floor((F.col("event_id") - lowest) * 10 / (highest - lowest + 1))
    for i in range(10):
        rows.filter(part == i).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return rows, stream


def finish(spark, df, mode):
    path = scratch_path(spark, "out")
    run.to_batches(df, path, scratch_path(spark, "cp"), mode).awaitTermination()
    return run.read_batches(spark, path, df.schema)


def test_trailing_count(spark, events):
    rows, stream = events
    store = scratch_path(spark, "store")
    streaming.count_posts(stream, "event_type", store, scratch_path(spark, "cp")).awaitTermination()
    got = streaming.trailing_count(streaming.posts_per_day(spark, store, "event_type", "string"), "event_type", 7)
    window = F.window("ts", "7 days", "1 day")
    wanted = rows.groupBy("event_type", window.alias("w")).agg(F.count("*").alias("posts")).select(
        "event_type", F.to_date("w.start").alias("window_start"), F.to_date("w.end").alias("window_end"), "posts"
    )
    assert got.exceptAll(wanted).count() == 0
    assert wanted.exceptAll(got).count() == 0
    assert run.read_accounts(spark, store).agg(F.sum("arrived"), F.sum("late")).first() == (rows.count(), 0)


def test_digest(spark, events):
    told = lambda df: df.withColumn("notify", F.when(F.col("event_type") == "error", "none"))
    rows, stream = events
    got = {(r.event_type, r.day): r["items"] for r in finish(spark, streaming.daily_digest(told(stream), "event_type"), "append").collect()}
    wanted = {(r.event_type, r.day): r["items"] for r in routing.daily_digest(told(rows), "event_type").collect()}
    assert got and all(wanted[k] == v for k, v in got.items())
    last = max(d for _, d in wanted)
    assert {k for k in wanted if k[1] < last} <= set(got)


def test_idle_items_alert_once(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2026, 8, d, h)
    batches = [
        [("quiet", day(1), "work"), ("closed", day(1), "work"), ("kept", day(1), "work")],
        [("closed", day(2), "close"), ("kept", day(3), "confirm")],
        [("kept", day(5), "confirm"), ("other", day(6), "work")],
        [("other", day(30), "work")],
    ]
    path = str(tmp_path / "in")
    schema = "item string, ts timestamp, kind string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = sorted((r["item"], r.last_seen) for r in finish(spark, streaming.idle_items(stream, "item"), "append").collect())
    assert got == [("kept", day(5)), ("other", day(6)), ("quiet", day(1))]


def test_prompts_load_once(spark, tmp_path):
    path = str(tmp_path / "lines")
    raw = prompt_log.transcript_lines(spark, SF)
    for i in range(3):
        raw.filter(F.pmod(F.hash("session_id", "line_no"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(path)
    raw.coalesce(1).write.mode("append").parquet(path)  # everything is delivered again
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(path)
    store = scratch_path(spark, "store")
    streaming.load_prompts(transcripts.parse_events(stream), store, scratch_path(spark, "cp")).awaitTermination()
    got = sorted(r.turn_uuid for r in spark.read.parquet(store).collect())
    wanted = sorted(r.turn_uuid for r in prompt_load.prompt_records(transcripts.parse_events(raw)).collect())
    assert got == wanted


def test_late_posts_are_counted_and_kept_apart(spark, tmp_path):
    at = lambda d, h=0: dt.datetime(2026, 8, d, h)
    batches = [[("a", at(1)), ("a", at(2)), ("b", at(5))], [("a", at(4, 1)), ("a", at(3)), ("b", at(1))], [("b", at(6)), (None, at(9))], [("a", at(7)), ("a", None)]]
    path, store, progress = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp")
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
        streaming.count_posts(stream, "k", store, progress).awaitTermination()  # a restart for each file
    accounts = run.read_accounts(spark, store).orderBy("batch").collect()
    assert [(r.batch, r.arrived, r.late) for r in accounts] == [(0, 3, 0), (1, 3, 2), (2, 2, 0), (3, 2, 1)]
    daily = streaming.posts_per_day(spark, store, "k", "string")
    counted = {(r.k, r.day.day if r.day else None): r.posts for r in daily.collect()}
    assert counted == {("a", 1): 1, ("a", 2): 1, ("b", 5): 1, ("a", 4): 1, ("b", 6): 1, (None, 9): 1, ("a", None): 1}
    assert sum(r.arrived - r.late for r in accounts) == sum(counted.values())


def test_digests_are_told_once_and_late_rows_counted(spark, tmp_path):
    at = lambda d, h=0: dt.datetime(2026, 8, d, h)
    batches = [
        [("a", at(1), None), ("a", at(1, 5), "daily"), ("b", at(1, 6), "none")],
        [("a", at(1, 23), None), ("b", at(2, 2), "daily")],
        [("a", at(1, 9), None), ("a", at(2, 3), None)],
        [("b", at(4), None), ("b", at(2, 22), "daily")],
        [("a", at(2), None), ("a", at(4, 1), None)],
    ]
    schema = "k string, ts timestamp, notify string"
    path, store, progress = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        streaming.tell_digest(stream, "k", store, progress).awaitTermination()
    told = spark.read.schema("k string, day date, items long, batch long").parquet(f"{store}/told").collect()
    assert sorted((r.k, r.day.day, r["items"], r.batch) for r in told) == [("a", 1, 3, 1), ("a", 2, 1, 3), ("b", 2, 2, 3)]
    accounts = run.read_accounts(spark, store).orderBy("batch").collect()
    assert [(r.arrived, r.late) for r in accounts] == [(2, 0), (2, 0), (2, 1), (2, 0), (2, 1)]
    still_open = streaming.posts_per_day(spark, store, "k", "string").filter("day >= '2026-08-04'").agg(F.sum("posts").alias("n")).first().n
    assert sum(r.arrived - r.late for r in accounts) == sum(r["items"] for r in told) + still_open


def test_the_first_of_repeated_prompts_is_loaded(spark, tmp_path):
    rows = [("s", "user", "same words", True, dt.datetime(2026, 8, d), f"cwd{d}") for d in (3, 1, 2)]
    path = str(tmp_path / "in")
    schema = "session_id string, type string, content string, is_text boolean, ts timestamp, cwd string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    store = str(tmp_path / "store")
    stream = spark.readStream.schema(schema).parquet(path)
    streaming.load_prompts(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert [(r.ts.day, r.project_hint) for r in spark.read.parquet(store).collect()] == [(1, "cwd1")]


def test_interrupted_sessions_out_of_order_and_after_a_restart(spark, tmp_path):
    """Files in mixed order within the delay; the query stops after each few and starts again from its checkpoint."""
    import random

    rng = random.Random(4)
    start = dt.datetime(2026, 8, 1)
    rows = []
    for user in range(12):
        at = start
        for _ in range(60):
            at += dt.timedelta(seconds=rng.choice([60, 1799, 1800, 1801, 7200]))
            rows.append((f"u{user}", at, rng.random() < 0.15))
    rows += [("u0", start + dt.timedelta(days=20), False), ("u1", start + dt.timedelta(days=20), True)]  # closes everything
    # Shuffled within pieces that span less than the delay of the watermark.
    rows.sort(key=lambda r: r[1] + dt.timedelta(seconds=rng.randint(0, 3 * 3600)))
    schema = "u string, ts timestamp, save boolean"
    path, out, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    size = len(rows) // 9 + 1
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(path)
        if i // size % 3 == 2 or i + size >= len(rows):
            events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
            found = streaming.interrupted_sessions(events.where("not save"), events.where("save"), "u", 1800, "4 hours")
            run.to_batches(found, out, progress).awaitTermination()
    got = sorted(tuple(r)[:4] for r in run.read_batches(spark, out, found.schema).collect())
    every = spark.createDataFrame(rows, schema)
    wanted = worklog.interrupted_sessions(every.where("not save"), every.where("save"), "u", 1800)
    closed = wanted.filter(F.col("ended") < F.lit(start + dt.timedelta(days=19)))
    assert got == sorted(tuple(r) for r in closed.select("u", "started", "ended", "prompts").collect()) and len(got) > 30
