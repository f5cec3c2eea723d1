"""Boxes on slides and pages, time segments and prompter cues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import bands, text
from galley.operators import ordered
from galley.schema import require


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("long")


def extents(boxes: DataFrame, slide: Sequence[str], limit: float, margin: float = 0.0) -> DataFrame:
    """Lowest and highest element per slide against the safe zone.

    Boxes without width and height are hidden and do not count. On equal
    values the element that comes first in the slide is named. A slide with no
    visible box is unmeasured.
    """
    require(boxes, *slide, "pos", "element", "top", "bottom", "width", "height")
    shown = ~((F.col("width") == 0) & (F.col("height") == 0))
    low_order = F.when(shown, F.struct(F.col("bottom").alias("v"), (-F.col("pos")).alias("p")))
    high_order = F.when(shown, F.struct(F.col("top").alias("v"), F.col("pos").alias("p")))
    facts = boxes.groupBy(*slide).agg(
        F.max(F.when(shown, F.col("bottom"))).alias("_bottom"),
        F.min(F.when(shown, F.col("top"))).alias("_top"),
        F.max_by("element", low_order).alias("lowest"),
        F.min_by("element", high_order).alias("highest"),
    )
    bottom, top = F.col("_bottom"), F.col("_top")
    over = bottom > limit
    status = (
        F.when(bottom.isNull(), "unmeasured")
        .when(over | (top < 0), "fail")
        .when(_half_up(bottom) > limit - margin, "tight")
        .otherwise("pass")
    )
    return facts.select(
        *slide,
        _half_up(top).alias("top"),
        _half_up(bottom).alias("bottom"),
        over.alias("over"),
        F.greatest(F.lit(0), _half_up(bottom - limit)).alias("over_by"),
        (top < 0).alias("above"),
        "lowest",
        "highest",
        status.alias("status"),
    )


def invalid_measurements(images: DataFrame, slide: Sequence[str]) -> DataFrame:
    """(slide, unloaded): slides whose extents are void, since an image did not load."""
    require(images, *slide, "loaded")
    return (
        images.groupBy(*slide)
        .agg(F.count_if(~F.coalesce("loaded", F.lit(False))).alias("unloaded"))
        .filter(F.col("unloaded") > 0)
    )


def page_rollup(lines: DataFrame, doc: str, edge: float = 5.0) -> DataFrame:
    """Per document: pages, characters, text extent in mm and lines beyond the right edge."""
    require(lines, doc, "page", "page_width", "x0", "y0", "x1", "y1", "text")
    # Pages are counted after one row per page, without a set per document.
    per_page = lines.groupBy(doc, "page").agg(
        F.sum(F.length("text")).alias("_chars"),
        F.count_if(F.col("x1") > F.col("page_width") - edge).alias("_over"),
        *[F.min(c).alias(c) for c in ("x0", "y0")],
        *[F.max(c).alias(c) for c in ("x1", "y1")],
    )
    return per_page.groupBy(doc).agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("_chars").alias("chars"),
        F.sum("_over").alias("overflow_lines"),
        bands.points_to_mm(F.min("x0")).alias("left_mm"),
        bands.points_to_mm(F.min("y0")).alias("top_mm"),
        bands.points_to_mm(F.max("x1")).alias("right_mm"),
        bands.points_to_mm(F.max("y1")).alias("bottom_mm"),
    )


def page_expectation(rollup: DataFrame, expected: DataFrame, doc: str) -> DataFrame:
    """Adds expected pages and status; a document with no expectation is unmeasured."""
    require(rollup, doc, "pages", "overflow_lines")
    require(expected, doc, "expected_pages")
    status = (
        F.when(F.col("pages").isNull() | F.col("expected_pages").isNull(), "unmeasured")
        .when((F.col("pages") == F.col("expected_pages")) & (F.col("overflow_lines") == 0), "pass")
        .otherwise("fail")
    )
    return rollup.join(expected.select(doc, "expected_pages"), doc, "full_outer").withColumn("status", status)


def image_sizes(images: DataFrame, doc: str) -> DataFrame:
    """Adds width, height and place of each image in mm, from points."""
    require(images, doc, "page", "x", "y", "w", "h")
    return images.select(
        doc, "page", *[bands.points_to_mm(F.col(c)).alias(f"{c}_mm") for c in ("w", "h", "x", "y")]
    )


def height_fit(blocks: DataFrame, page: Sequence[str], available_mm: float) -> DataFrame:
    """(page, required_mm, spare_mm, fits): blocks of a page against its free height."""
    require(blocks, *page, "height_mm")
    needed = blocks.groupBy(*page).agg(F.sum("height_mm").alias("required_mm"))
    spare = F.lit(available_mm) - F.col("required_mm")
    return needed.withColumn("spare_mm", spare).withColumn("fits", F.col("spare_mm") >= 0)


# Minutes of the four segments and what each may hold.
SEGMENTS = (
    ("hook", 0.0, 1.0, False),
    ("result", 1.0, 3.0, False),
    ("practice", 3.0, 6.0, False),
    ("immersion", 6.0, 13.0, True),
)


def segment_of(
    utterances: DataFrame, minute: str, segments: Sequence[tuple[str, float, float, bool]] = SEGMENTS
) -> DataFrame:
    """Adds segment and cta_allowed; a boundary minute opens the next segment.

    The segments are a few constants, so this is an expression, not a range join.
    """
    require(utterances, minute)
    name, allowed = F.lit("overrun"), F.lit(False)
    for label, start, end, cta in segments:
        here = (F.col(minute) >= start) & (F.col(minute) < end)
        name = F.when(here, label).otherwise(name)
        allowed = F.when(here, F.lit(cta)).otherwise(allowed)
    return utterances.withColumn("segment", name).withColumn("cta_allowed", allowed)


def segments_of_deck(utterances: DataFrame, segments: DataFrame, deck: str) -> DataFrame:
    """As `segment_of` with segments per deck from a table.

    A segment is spread over the whole minutes it touches, and the join is on deck,
    minute and the exact bounds. Every utterance stays: one outside all segments is a
    `gap` before the deck's last segment ends and an `overrun` otherwise, and allows no
    call to action. Segments of a deck do not overlap.
    """
    require(utterances, deck, "at_min")
    require(segments, deck, "segment", "from_min", "to_min", "cta_allowed")
    minutes = segments.select(
        F.col(deck).alias("_deck"), "segment", "from_min", "to_min", "cta_allowed",
        F.explode(F.sequence(F.floor("from_min"), F.ceil("to_min") - 1)).alias("_m"),
    )
    ends = segments.groupBy(deck).agg(F.max("to_min").alias("_end"))
    inside = (
        (F.col(deck) == F.col("_deck"))
        & (F.floor("at_min") == F.col("_m"))
        & (F.col("at_min") >= F.col("from_min"))
        & (F.col("at_min") < F.col("to_min"))
    )
    outside = F.when(F.col("at_min") < F.col("_end"), "gap").otherwise("overrun")
    return (
        utterances.join(ends, deck, "left")
        .join(minutes, inside, "left")
        .withColumn("segment", F.when(F.col("_deck").isNull(), outside).otherwise(F.col("segment")))
        .withColumn("cta_allowed", F.coalesce("cta_allowed", F.lit(False)))
        .drop("_deck", "_m", "_end")
    )


def pacing(utterances: DataFrame, deck: str, minute: str, slide: str, planned: float) -> DataFrame:
    """(deck, slides, minutes, slides_per_minute, overrun) against the planned length."""
    require(utterances, deck, minute, slide)
    per_slide = utterances.groupBy(deck, slide).agg(F.max(minute).alias("_end"))
    minutes = F.max("_end")
    return per_slide.groupBy(deck).agg(
        F.count(F.lit(1)).alias("slides"),
        minutes.alias("minutes"),
        F.when(minutes > 0, F.count(F.lit(1)) / minutes).alias("slides_per_minute"),
        F.greatest(F.lit(0.0), minutes - planned).alias("overrun"),
    )


def prompter_cues(slides: DataFrame, deck: str) -> DataFrame:
    """(deck, slide_no, paragraphs, total, progress, title, next_title).

    Slides are numbered from 1. A slide with no title is "(none)", and the last
    slide has the marker "(last)" instead of a next title.
    """
    require(slides, deck, "slide_no", "script", "title")
    named = slides.withColumn(
        "title",
        F.coalesce(F.when(text.strip(F.col("title")) != "", F.substring(text.collapse(F.col("title")), 1, 40)), F.lit("(none)")),
    ).withColumn(
        "paragraphs",
        F.size(F.filter(F.split("script", r"\|"), lambda p: text.strip(p) != "")),
    )
    ahead = ordered.next_value(
        named.select(deck, "slide_no", "title", "paragraphs"), [deck], ["slide_no"], F.col("title"),
        "next_title", ordered.line_block("slide_no"),
    )
    totals = slides.groupBy(deck).agg(F.count(F.lit(1)).alias("total"))
    return ahead.join(totals, deck).select(
        deck, "slide_no", "paragraphs", "total",
        (F.col("slide_no") * 100.0 / F.col("total")).alias("progress"),
        "title", F.coalesce("next_title", F.lit("(last)")).alias("next_title"),
    )
