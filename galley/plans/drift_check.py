"""One verdict per document for copy drift, visuals and references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.operators import drift


def drift_verdict(
    slides: DataFrame, scripts: DataFrame, broken: DataFrame, key: str, *, min_shots: int = 1,
    max_text_only: float = 0.7, image: str = r"(?i)<img\s", drawing: str = r"(?i)<svg\s",
) -> DataFrame:
    """(key, hard, soft, shots, text_only_ratio, broken_refs, verdict).

    Each part is summed per document before the parts are joined.
    """
    missing = drift.numeral_split(drift.missing_copy(slides, scripts, key))
    copy = missing.groupBy(key).agg(
        F.count_if(F.col("severity") == "hard").alias("hard"),
        F.count_if(F.col("severity") == "soft").alias("soft"),
    )
    visuals = drift.visual_mix(
        slides, key, image=image, drawing=drawing, min_shots=min_shots, max_text_only=max_text_only
    ).select(key, "shots", "text_only_ratio", F.col("verdict").alias("_visuals"))
    refs = broken.groupBy(key).agg(F.count(F.lit(1)).alias("broken_refs"))
    joined = (
        visuals.join(copy, key, "left").join(refs, key, "left").fillna(0, ["hard", "soft", "broken_refs"])
    )
    failed = (F.col("hard") > 0) | (F.col("broken_refs") > 0) | (F.col("_visuals") == "fail")
    warned = (F.col("soft") > 0) | (F.col("_visuals") == "warn")
    return joined.withColumn(
        "verdict", F.when(failed, "fail").when(warned, "pass_with_warnings").otherwise("pass")
    ).drop("_visuals")
