"""Transcript files: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import text


def parse_events(raw: DataFrame) -> DataFrame:
    """Rows (session_id, line_no, value) to typed events.

    Blank and malformed lines are skipped. Of a repeated key the last value counts, which
    is a setting of the session (`session.DEFAULTS`). `is_text` tells a typed text from a
    list of blocks: a list can look like text once it is a string.
    """
    event = F.try_parse_json("value")
    content = F.try_variant_get(event, "$.message.content", "variant")
    return (
        raw.select(
            "session_id",
            "line_no",
            event.isNotNull().alias("_ok"),
            F.try_variant_get(event, "$.type", "string").alias("type"),
            content.cast("string").alias("content"),
            F.coalesce(F.schema_of_variant(content) == "STRING", F.lit(False)).alias("is_text"),
            F.try_to_timestamp(F.try_variant_get(event, "$.timestamp", "string")).alias("ts"),
            F.try_variant_get(event, "$.cwd", "string").alias("cwd"),
        )
        .filter("_ok")
        .drop("_ok")
    )


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Events of all transcript files under a path or pattern.

    Files stay splittable. `line_no` orders the lines of a file: the offset of
    the split a line lies in, then its place in the split.
    """
    raw = spark.read.text(path)
    return parse_events(
        raw.select(
            text.stem(F.col("_metadata.file_path")).alias("session_id"),
            F.struct(
                F.col("_metadata.file_block_start").alias("offset"),
                F.monotonically_increasing_id().alias("place"),
            ).alias("line_no"),
            "value",
        ).filter(text.strip(F.col("value")) != "")
    )
