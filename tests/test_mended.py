"""Cases that were once green and wrong."""

import datetime

from pyspark.sql import functions as F

from galley.operators import keywords, layout, recall, rules, worklog
from galley.session import scratch_path
from galley.sources import sinks, transcripts
from galley.streaming import operators as streaming

EVENT = "session_id string, type string, content string, is_text boolean, ts timestamp, cwd string"


def test_stream_loads_prompts_of_any_date(spark):
    days = ["2024-06-10", "2024-01-01", None, "2024-06-01", "2024-06-10"]
    where = scratch_path(spark, "events")
    store, progress = scratch_path(spark, "prompts"), scratch_path(spark, "progress")
    for k, day in enumerate(days):
        ts = day and datetime.datetime.fromisoformat(day)
        row = ("s", "user", f"a prompt that is long enough, number {k % 4}", True, ts, None)
        spark.createDataFrame([row, row], EVENT).write.mode("append").parquet(where)
        stream = spark.readStream.schema(EVENT).parquet(where)
        streaming.load_prompts(stream, store, progress).awaitTermination()
    assert spark.read.parquet(store).count() == 4


def test_nearest_ranks_raw_values(spark):
    rows = [(1, [1.0, 0.0001]), (2, [1.0, 0.00005]), (3, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id int, v array<double>")
    got = recall.similar_top_k(vectors, F.array(F.lit(1.0), F.lit(0.0)), "id", "v", 1).collect()
    assert [(r["id"], r["similarity"]) for r in got] == [(3, 1.0)]


def test_small_channel_videos_are_counted(spark):
    day = datetime.date(2024, 5, 1)
    rows = [("k", "small", 10, v, day) for v in (1.0, 2.0, 3.0)] + [("k", "big", 10**6, 9.0, day)]
    videos = spark.createDataFrame(rows, "keyword string, channel string, followers long, views double, uploaded date")
    assert keywords.demand_axes(videos, "2024-06-01").first()["small_channel_videos"] == 3


def test_automatic_notes_are_no_items(spark):
    notes = spark.createDataFrame([("2026-08-01-autohandoff-x.md", "b"), ("2026-08-01-handoff-y.md", "b")], "name string, body string")
    assert [r["item_id"] for r in worklog.work_item_header(notes).collect()] == ["2026-08-01-handoff-y.md"]


def test_utterances_outside_all_segments_stay(spark):
    spoken = spark.createDataFrame([(1, "d", 0.5), (2, "d", 1.5), (3, "d", 9.0), (4, "e", 0.5), (5, "d", None)], "id int, deck string, at_min double")
    parts = [("d", "a", 0.0, 1.0, True), ("d", "b", 2.0, 3.0, False)]
    segments = spark.createDataFrame(parts, "deck string, segment string, from_min double, to_min double, cta_allowed boolean")
    got = {r["id"]: (r["segment"], r["cta_allowed"]) for r in layout.segments_of_deck(spoken, segments, "deck").collect()}
    assert got == {1: ("a", True), 2: ("gap", False), 3: ("overrun", False), 4: ("overrun", False), 5: ("overrun", False)}


def test_last_value_of_a_repeated_key_counts(spark):
    line = '{"type": "user", "type": "other", "message": {"content": "x"}}'
    raw = spark.createDataFrame([("s", 1, line), ("s", 2, "{broken")], "session_id string, line_no int, value string")
    assert [r["type"] for r in transcripts.parse_events(raw).collect()] == ["other"]


def test_a_token_of_two_tenants_is_rejected_once(spark):
    rows = spark.createDataFrame([(1, "t", "A")], "id int, token string, tenant_claimed string")
    claims = spark.createDataFrame([("t", "A"), ("t", "B")], "token string, tenant string")
    accepted, rejected = rules.tenant_guard(rows, claims, "token")
    assert accepted.count() == 0
    assert [(r["id"], r["reason"]) for r in rejected.collect()] == [(1, "ambiguous_token")]


def test_a_key_sent_twice_is_stored_once(spark):
    sent = spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "id int, v string")
    stored = spark.createDataFrame([(1, "z")], "id int, v string")
    got = sinks.changed_records(sent, stored, "id", ["v"]).collect()
    assert sorted((r["id"], r["action"], r["v"]) for r in got) == [(1, "update", "a"), (2, "insert", None)]


def test_a_repeated_item_has_one_tip(spark):
    items = [("a", "b"), ("b", "c"), ("b", "c"), ("b", None), ("c", None)]
    got = worklog.chain_tips(spark.createDataFrame(items, "item_id string, successor string")).collect()
    assert sorted((r["item_id"], r["tip"]) for r in got) == [("a", "c"), ("b", "c"), ("c", "c")]
