"""Typed prompts: filter, first occurrence, key, load counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.functions import keys, text
from galley.schema import require

# Beginnings of texts that a machine wrote.
MACHINE_PREFIXES = (
    "<",
    "Caveat:",
    "[Request interrupted",
    "This session is being continued",
)


def typed_prompts(events: DataFrame) -> DataFrame:
    """Events a person typed, with trimmed text of at least two units."""
    require(events, "type", "content", "is_text")
    trimmed = events.filter((F.col("type") == "user") & F.col("is_text")).withColumn(
        "content", text.strip(F.col("content"))
    )
    wanted = text.utf16_length(F.col("content")) >= 2
    for prefix in MACHINE_PREFIXES:
        wanted = wanted & ~F.col("content").startswith(prefix)
    return trimmed.filter(wanted)


def first_occurrence(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The earliest row for each key.

    An aggregate, not a window: copies of one text meet already in the map
    tasks, so a text that fills a third of the input does not fill one task.
    """
    require(df, *by, *order)
    rest = [c for c in df.columns if c not in by]
    if not rest:
        return df.distinct()
    return (
        df.groupBy(*by)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
        .select(*by, "_first.*")
        .select(*df.columns)
    )


def keyed(prompts: DataFrame, source: str = "transcript") -> DataFrame:
    """Prompt records ready to load."""
    require(prompts, "session_id", "content", "ts", "cwd")
    return prompts.select(
        keys.turn_key(F.col("session_id"), F.col("content")).alias("turn_uuid"),
        "session_id",
        keys.valid_uuid(F.col("session_id")).alias("session_uuid"),
        F.col("content").alias("prompt_text"),
        "ts",
        F.col("cwd").alias("project_hint"),
        F.lit(source).alias("source"),
    )


def only_new(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored; reads only the key of the store."""
    require(df, key)
    return df.join(stored.select(key), key, "left_anti")


def load_counts(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """One row: total, new, existing, failed (no key)."""
    require(df, key)
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    known = stored.select(key).distinct().withColumn("_known", F.lit(True))
    joined = per_key.join(known, key, "left")
    has_key = F.col(key).isNotNull()
    is_new = has_key & F.col("_known").isNull()

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    return joined.agg(
        total(F.col("_n")).alias("total"),
        total(F.when(is_new, 1).otherwise(0)).alias("new"),
        # a repeat inside the load is as idempotent as a stored key
        total(F.when(is_new, F.col("_n") - 1).when(has_key, F.col("_n"))).alias("existing"),
        total(F.when(~has_key, F.col("_n")).otherwise(0)).alias("failed"),
    )
