"""A whole keyword survey: bands, ranking and the verdict per survey."""

from __future__ import annotations

from pyspark.sql import DataFrame

from galley.operators import keywords


def banded(rows: DataFrame, survey: str = "survey_id") -> DataFrame:
    return keywords.with_price_band(keywords.with_entry(rows), survey)


def survey_report(rows: DataFrame, survey: str = "survey_id", n: int = 8) -> DataFrame:
    """The ranked keywords of each survey beside its verdict and next action."""
    judged = banded(rows, survey)
    return keywords.golden_rank(judged, survey, n).join(keywords.group_verdict(judged, survey), survey)
