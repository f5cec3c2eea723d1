"""Pairwise creative tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.functions import stats
from galley.schema import require


def preference_counts(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """(axis, wins, n): how often the side that is higher on an axis won.

    A pair that is equal on the axis, or not measured on both sides, says
    nothing and is left out.
    """
    require(pairs, "pair_id", "left_id", "right_id", "winner")
    require(features, "id", "axis", "value")
    left = features.select(F.col("id").alias("left_id"), "axis", F.col("value").alias("_l"))
    right = features.select(F.col("id").alias("right_id"), "axis", F.col("value").alias("_r"))
    joined = pairs.join(left, "left_id").join(right, ["right_id", "axis"])
    higher = F.when(F.col("_l") > F.col("_r"), F.col("left_id")).when(
        F.col("_l") < F.col("_r"), F.col("right_id")
    )
    counts = joined.groupBy("axis").agg(
        F.count_if(higher == F.col("winner")).alias("wins"),
        F.count_if(higher.isNotNull() & F.col("winner").isin(F.col("left_id"), F.col("right_id"))).alias("n"),
    )
    return counts


def preference_test(pairs: DataFrame, features: DataFrame, level: float = 0.05) -> DataFrame:
    """Adds rate, p and verdict; an axis without a preference is reported too."""
    counts = preference_counts(pairs, features)
    p = stats.sign_test_p(F.col("wins"), F.col("n"))
    return (
        counts.withColumn("rate", F.when(F.col("n") > 0, F.col("wins") / F.col("n")))
        .withColumn("p", p)
        .withColumn(
            "verdict",
            F.when(F.col("n") == 0, "not_measured")
            .when(F.col("p") < level, "preference")
            .otherwise("no_preference"),
        )
    )
