"""Transcript events to loaded prompt records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.operators import prompts
from galley.sources import sinks, transcripts


def prompt_records(events: DataFrame, source: str = "transcript") -> DataFrame:
    """Typed, first of its session and text, keyed. One shuffle."""
    typed = prompts.typed_prompts(events)
    first = prompts.first_occurrence(typed, ["session_id", "content"], ["line_no"])
    return prompts.keyed(first, source)


def session_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("prompts"),
        F.sum(F.length("prompt_text")).alias("characters"),
    )


def load(spark: SparkSession, transcript_path: str, store_path: str) -> DataFrame:
    """Read, key and append; returns the load counts. Safe to run again."""
    records = prompt_records(transcripts.read_transcripts(spark, transcript_path))
    return sinks.append_new(records, store_path, "turn_uuid")
