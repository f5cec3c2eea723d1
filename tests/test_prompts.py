import json

from pyspark.sql import functions as F

from galley.functions import keys, text
from galley.operators import prompts
from galley.plans import prompt_load
from galley.sources import sinks, transcripts

UUID = "0a1b2c3d-1111-2222-3333-444455556666"


def event(content, ts="2026-08-01T10:00:00Z", kind="user"):
    return json.dumps({"type": kind, "message": {"content": content}, "timestamp": ts, "cwd": "/w"})


LINES = [
    event("  hello there　\n"),
    event([{"type": "tool_result"}]),
    "",
    "{broken",
    event("x"),
    event("😀"),
    event("<command>"),
    event("Caveat: generated"),
    event("[Request interrupted by user]"),
    event("This session is being continued from"),
    event("hello there", ts="2026-08-02T10:00:00Z"),
    event("no time", ts=None),
    event('["looks like a list"]'),
    event("answer", kind="assistant"),
]


def write(path, name, lines):
    folder = path / "project"
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_transcripts_to_records(spark, tmp_path):
    write(tmp_path, UUID, LINES)
    write(tmp_path, "plain-name", [event("hello there")])
    events = transcripts.read_transcripts(spark, str(tmp_path / "*" / "*.jsonl"))
    assert events.count() == 13  # blank and broken lines are skipped
    rows = prompt_load.prompt_records(events).collect()
    of_uuid = {r.prompt_text: r for r in rows if r.session_id == UUID}
    assert set(of_uuid) == {"hello there", "😀", "no time", '["looks like a list"]'}
    # the first of two equal texts counts
    assert of_uuid["hello there"].ts.day == 1
    assert of_uuid["no time"].ts is None
    assert of_uuid["hello there"].session_uuid == UUID
    other = [r for r in rows if r.session_id == "plain-name"]
    assert len(other) == 1 and other[0].session_uuid is None
    assert other[0].turn_uuid != of_uuid["hello there"].turn_uuid


def test_turn_key_golden(spark):
    key = spark.range(1).select(keys.turn_key(F.lit("s"), F.lit("p")).alias("k")).first().k
    assert key == "8598d4ac-2c6b-c139-141e-9c368fe37e94"


def test_append_new_twice(spark, tmp_path):
    write(tmp_path, UUID, LINES)
    path, store = str(tmp_path / "*" / "*.jsonl"), str(tmp_path / "store")
    first = prompt_load.load(spark, path, store).first().asDict()
    again = prompt_load.load(spark, path, store).first().asDict()
    assert first == {"total": 4, "new": 4, "existing": 0, "failed": 0}
    assert again == {"total": 4, "new": 0, "existing": 4, "failed": 0}
    assert spark.read.parquet(store).count() == 4


def test_load_counts_of_nothing(spark):
    empty = spark.createDataFrame([], "k string")
    assert prompts.load_counts(empty, empty, "k").first().asDict() == {
        "total": 0, "new": 0, "existing": 0, "failed": 0,
    }


def test_failed_rows_have_no_key(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    stored = spark.createDataFrame([], "k string")
    assert prompts.load_counts(rows, stored, "k").first().asDict() == {
        "total": 3, "new": 1, "existing": 1, "failed": 1,
    }


def test_preview(one):
    assert one(text.preview, "a\n\nb" + "c" * 100) == "a b" + "c" * 77


def test_store_error_is_not_hidden(spark, tmp_path):
    missing = sinks.read_or_empty(spark, str(tmp_path / "none"), spark.range(1).schema)
    assert missing.count() == 0
