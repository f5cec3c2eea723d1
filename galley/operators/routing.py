"""Incoming material: category and notification."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.schema import require

# Categories and ways to be told.
CATEGORIES = ("knowledge", "judgment", "object")
NOTIFY = ("immediate", "daily", "none")


def with_category(rows: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Fills a missing category by the first pattern that fits, else knowledge."""
    require(rows, "text", "category")
    unknown = set(patterns) - set(CATEGORIES)
    if unknown:
        raise ValueError(f"unknown categories {sorted(unknown)}")
    guess = F.lit("knowledge")
    for name, pattern in reversed(list(patterns.items())):
        guess = F.when(F.col("text").rlike(pattern), name).otherwise(guess)
    return rows.withColumn("category", F.coalesce("category", guess))


def immediate_notices(rows: DataFrame) -> DataFrame:
    return require(rows, "notify").filter(F.col("notify") == "immediate")


def daily_digest(rows: DataFrame, by: str) -> DataFrame:
    """(by, day, items) for material that is told once a day, which is the default."""
    require(rows, by, "ts", "notify")
    wanted = rows.filter(F.coalesce("notify", F.lit("daily")) == "daily")
    return (
        wanted.groupBy(by, F.window("ts", "1 day").alias("_w"))
        .agg(F.count(F.lit(1)).alias("items"))
        .select(by, F.col("_w.start").alias("day"), F.col("_w.end").alias("day_end"), "items")
    )
