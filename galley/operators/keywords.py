"""Keyword demand: entry, price, residual demand, gaps and placement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions import bands
from galley.operators import ordered
from galley.schema import require


def with_entry(rows: DataFrame) -> DataFrame:
    """Adds entry and evidence per channel; an unmeasured row stays unknown."""
    require(rows, "channel", "pub_30d", "competition")
    return rows.withColumn(
        "entry", bands.entry_band(F.col("channel"), F.col("pub_30d"), F.col("competition"))
    ).withColumn("evidence", bands.evidence_grade(F.col("channel")))


def with_price_band(rows: DataFrame, survey: str = "survey_id") -> DataFrame:
    """Adds cpc_band: high at or above the upper quartile of the same survey.

    The absolute price stays; it is the only value comparable across surveys.
    """
    require(rows, survey, "cpc")
    cut = ordered.exact_quantile(rows, [survey], "cpc", 0.75, "_cut")
    band = (
        F.when(F.col("cpc").isNull(), "unknown")
        .when(F.col("cpc").cast("double") >= F.col("_cut"), "high")
        .otherwise("normal")
    )
    return rows.join(cut, survey, "left").withColumn("cpc_band", band).drop("_cut")


def report_columns(volume: Column, publications: Column, capped: Column) -> tuple[Column, Column]:
    """(volume_text, posts_text) as the report prints them."""
    volume_text = F.coalesce(F.format_number(volume, 0), F.lit("below measurement"))
    posts_text = (
        F.when(publications.isNull(), "unknown")
        .when(capped, F.concat(publications.cast("string"), F.lit("+")))
        .otherwise(publications.cast("string"))
    )
    return volume_text, posts_text


def residual_ratio(rows: DataFrame, base: str, probe: str) -> DataFrame:
    """(keyword, base_volume, probe_volume, ratio, verdict) for two markets.

    One aggregate brings both markets together, so a keyword is shuffled once
    and already summed.
    """
    require(rows, "keyword", "market", "volume")
    of = lambda m: F.sum(F.when(F.col("market") == m, F.col("volume")))
    both = (
        rows.filter(F.col("market").isin(base, probe))
        .groupBy("keyword")
        .agg(of(base).alias("base_volume"), of(probe).alias("probe_volume"))
    )
    ratio = F.when(F.col("base_volume") > 0, F.col("probe_volume") / F.col("base_volume"))
    return both.withColumn("ratio", ratio).withColumn("verdict", bands.residual_verdict(F.col("ratio")))


def channel_flip(rows: DataFrame) -> DataFrame:
    """(keyword, saturated_on, open_on): closed on one channel, easy on another."""
    require(rows, "keyword", "channel", "entry")
    per_band = lambda b: F.array_sort(F.collect_set(F.when(F.col("entry") == b, F.col("channel"))))
    both = rows.groupBy("keyword").agg(per_band("hard").alias("saturated_on"), per_band("easy").alias("open_on"))
    both = both.withColumn("saturated_on", F.array_except("saturated_on", "open_on"))
    return both.filter((F.size("saturated_on") > 0) & (F.size("open_on") > 0)).select(
        "keyword",
        F.array_join("saturated_on", ",").alias("saturated_on"),
        F.array_join("open_on", ",").alias("open_on"),
    )


def golden_rank(rows: DataFrame, survey: str = "survey_id", n: int = 8) -> DataFrame:
    """The first n keywords of a survey: entry first, then price, unmeasured last."""
    require(rows, survey, "keyword", "entry", "cpc")
    order = Window.partitionBy(survey).orderBy(
        bands.entry_order(F.col("entry")), F.col("cpc").desc_nulls_last(), "keyword"
    )
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def group_verdict(rows: DataFrame, survey: str = "survey_id") -> DataFrame:
    """(survey, verdict, action): what a survey as a whole says.

    usable: the seed itself is open. conditional: only other candidates are.
    avoid: everything measured is closed. unknown: nothing was measured.
    """
    require(rows, survey, "seed", "keyword", "entry", "cpc_band", "channel")
    is_open = F.col("entry").isin("easy", "ok")
    is_seed = F.col("keyword") == F.col("seed")
    facts = rows.groupBy(survey).agg(
        F.bool_or(is_open & is_seed).alias("_seed"),
        F.bool_or(is_open).alias("_any"),
        F.bool_and(F.col("entry") == "unknown").alias("_none"),
        F.bool_or(is_open & (F.col("cpc_band") == "high")).alias("_open_high"),
        F.bool_or((F.col("entry") == "hard") & (F.col("cpc_band") == "high")).alias("_hard_high"),
        F.bool_or(F.col("channel") == bands.PUBLICATIONS).alias("_posts"),
    )
    verdict = (
        F.when(F.col("_none"), "unknown")
        .when(F.col("_seed"), "usable")
        .when(F.col("_any"), "conditional")
        .otherwise("avoid")
    )
    action = (
        F.when(F.col("_none"), "measure_again")
        .when(F.col("_open_high"), "write")
        .when(~F.col("_any") & F.col("_posts"), "measure_other_channel")
        .when(F.col("_hard_high"), "long_tail")
        .otherwise("narrow")
    )
    return facts.select(survey, verdict.alias("verdict"), action.alias("action"))


def gap_band(
    seeds: DataFrame, *, wide: float, moderate: float, narrow: float, min_demand: int
) -> DataFrame:
    """Adds gap: demand over supply. The cut points are not published, so all are required.

    A capped supply means "at least": the true gap can only be smaller, so a
    wide or moderate gap is lowered by one step.
    """
    require(seeds, "demand", "supply", "supply_capped")
    ratio = F.when(F.col("supply") > 0, F.col("demand") / F.col("supply"))
    capped = F.coalesce(F.col("supply_capped"), F.lit(False))
    gap = (
        F.when(F.col("demand").isNull() | F.col("supply").isNull(), "unknown")
        .when(F.col("demand") < min_demand, "low_demand")
        .when(F.col("supply") == 0, "wide")
        .when(ratio >= wide, F.when(capped, "moderate").otherwise("wide"))
        .when(ratio >= moderate, F.when(capped, "narrow").otherwise("moderate"))
        .when(ratio >= narrow, "narrow")
        .otherwise("saturated")
    )
    return seeds.withColumn("gap_ratio", ratio).withColumn("gap", gap)


def demand_axes(
    videos: DataFrame, as_of: str, *, one_hit: float = 10.0, small_channel: int = 40_000,
    months: int = 6,
) -> DataFrame:
    """Per keyword: median and top views, one-hit flag, videos by small channels, recent share."""
    require(videos, "keyword", "channel", "followers", "views", "uploaded")
    recent = F.col("uploaded") >= F.add_months(F.lit(as_of).cast("date"), -months)
    small = F.col("followers") < small_channel
    # One row per keyword and channel first, so channels are counted without a set.
    per_channel = videos.groupBy("keyword", "channel").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("views").alias("_top"),
        F.count_if(recent).alias("_recent"),
        F.bool_or(small).alias("_small"),
    )
    facts = per_channel.groupBy("keyword").agg(
        F.sum("_n").alias("videos"),
        F.max("_top").alias("top_views"),
        F.coalesce(F.sum(F.when(F.col("_small"), F.col("_n"))), F.lit(0)).alias("small_channel_videos"),
        (F.sum("_recent") / F.sum("_n")).alias("recent_share"),
    )
    median = ordered.exact_quantile(videos, ["keyword"], "views", 0.5, "median_views")
    joined = facts.join(median, "keyword", "left")
    ratio = F.when(F.col("median_views") > 0, F.col("top_views") / F.col("median_views"))
    return joined.withColumn("one_hit", F.coalesce(ratio >= one_hit, F.lit(False)))


def audience_label(videos: DataFrame, labels: DataFrame) -> DataFrame:
    """(keyword, audience, share): whom the channels in a place speak to.

    The label most videos carry; a channel without a label counts as unknown.
    """
    require(videos, "keyword", "channel")
    require(labels, "channel", "audience")
    per_channel = videos.groupBy("keyword", "channel").agg(F.count(F.lit(1)).alias("_n"))
    per_label = (
        per_channel.join(labels.select("channel", "audience"), "channel", "left")
        .groupBy("keyword", F.coalesce("audience", F.lit("unknown")).alias("audience"))
        .agg(F.sum("_n").alias("_n"))
    )
    most = F.max_by("audience", F.struct("_n", "audience"))
    return per_label.groupBy("keyword").agg(
        most.alias("audience"), (F.max("_n") / F.sum("_n")).alias("share")
    )


def volatile_metrics(observations: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, measured, low, high, volatile): a changing value must not be quoted as a number."""
    require(observations, *by, value)
    return observations.groupBy(*by).agg(
        F.count(value).alias("measured"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        (F.min(value) != F.max(value)).alias("volatile"),
    )


def trailing_count(posts: DataFrame, keyword: str, day: str, days: int = 30) -> DataFrame:
    """(keyword, day, posts, trailing) with the posts of the last `days` days, this one included.

    Posts are counted per day first; the frame sees at most one row per day.
    """
    require(posts, keyword, day)
    daily = posts.groupBy(keyword, day).agg(F.count(F.lit(1)).alias("posts"))
    frame = (
        Window.partitionBy(keyword)
        .orderBy(F.unix_date(F.col(day)))
        .rangeBetween(-(days - 1), Window.currentRow)
    )
    return daily.withColumn("trailing", F.sum("posts").over(frame))


def price_trend(snapshots: DataFrame) -> DataFrame:
    """(keyword, survey_date, cpc, change, rising) against the previous survey."""
    require(snapshots, "keyword", "survey_date", "cpc")
    per_survey = snapshots.groupBy("keyword", "survey_date").agg(F.avg("cpc").alias("cpc"))
    before = F.lag("cpc").over(Window.partitionBy("keyword").orderBy("survey_date"))
    change = F.col("cpc") - before
    return per_survey.withColumn("change", change).withColumn(
        "rising", F.coalesce(F.col("change") > 0, F.lit(False))
    )


def placement_plan(topics: DataFrame, channel: str) -> DataFrame:
    """(channel, week, kind, topic, tier): one search piece and one story piece a week.

    Open places come first, places won by difference second, saturated
    cornerstones last. Stories follow their topic order. The order is cut into
    ranges, so a channel of any size, also one of equal tiers and volumes, is
    numbered by many tasks.
    """
    require(topics, channel, "topic", "kind", "entry", "differentiated", "volume")
    tier = (
        F.when(F.col("entry") == "easy", 1)
        .when((F.col("entry") == "ok") | F.col("differentiated"), 2)
        .otherwise(3)
    )
    ranked = ordered.range_numbered(
        topics.withColumn("tier", tier), [channel, "kind"], ["tier", F.desc("volume"), "topic"], "week"
    )
    return ranked.select(channel, "week", "kind", "topic", "tier")
