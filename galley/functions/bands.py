"""Bands and units: small rules on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUBLICATIONS = "publications"
ADS = "ads"

ENTRY_ORDER = {"easy": 1, "ok": 2, "hard": 3}


def entry_band(channel: Column, publications: Column, competition: Column) -> Column:
    """How open a keyword is: by posts of 30 days, or by ad competition."""
    by_posts = (
        F.when(publications.isNull(), "unknown")
        .when(publications < 10, "easy")
        .when(publications < 100, "ok")
        .otherwise("hard")
    )
    by_ads = (
        F.when(competition.isNull(), "unknown")
        .when(competition <= 33, "easy")
        .when(competition <= 66, "ok")
        .otherwise("hard")
    )
    return (
        F.when(channel == PUBLICATIONS, by_posts)
        .when(channel == ADS, by_ads)
        .otherwise("unknown")
    )


def evidence_grade(channel: Column) -> Column:
    """Counted posts are better evidence than advertiser competition."""
    return F.when(channel == PUBLICATIONS, "A-").when(channel == ADS, "B")


def entry_order(band: Column) -> Column:
    expr = F.lit(4)
    for name, rank in ENTRY_ORDER.items():
        expr = F.when(band == name, rank).otherwise(expr)
    return expr


def audience_stage(subscribers: Column) -> Column:
    return (
        F.when(subscribers.isNull(), "unknown")
        .when(subscribers < 1_000, "0-1K")
        .when(subscribers < 10_000, "1K-10K")
        .when(subscribers < 100_000, "10K-100K")
        .otherwise("100K+")
    )


def residual_verdict(ratio: Column) -> Column:
    """Share of the home-market demand that is found in the probe market."""
    return (
        F.when(ratio.isNull(), "unknown")
        .when(ratio >= 0.30, "genuine")
        .when(ratio <= 0.10, "discard")
        .otherwise("review")
    )


def points_to_mm(points: Column) -> Column:
    return points / 72 * 25.4


def mm_to_form_units(mm: Column) -> Column:
    return mm * 283.46


def pixels_to_mm(pixels: Column) -> Column:
    return pixels / 96 * 25.4


def mm_to_pixels(mm: Column) -> Column:
    """Whole pixels, at least one; halves round to even."""
    return F.greatest(F.lit(1), F.bround(mm / 25.4 * 96, 0).cast("int"))


def visible_points(canvas_points: Column, insert_width: Column, canvas_width: Column) -> Column:
    """Size a reader sees once a drawing is scaled into the page."""
    return canvas_points * insert_width / canvas_width
