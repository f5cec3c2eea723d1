import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from galley.functions import bands
from galley.operators import keywords


@pytest.mark.parametrize(
    "channel, posts, competition, band",
    [
        ("publications", 9, None, "easy"), ("publications", 10, None, "ok"), ("publications", 99, None, "ok"),
        ("publications", 100, None, "hard"), ("publications", None, 5, "unknown"), ("ads", None, 33, "easy"),
        ("ads", 5, 34, "ok"), ("ads", None, 66, "ok"), ("ads", None, 67, "hard"), ("ads", 5, None, "unknown"),
    ],
)
def test_entry(spark, channel, posts, competition, band):
    df = spark.createDataFrame([(channel, posts, competition)], "channel string, pub_30d int, competition int")
    assert keywords.with_entry(df).first().entry == band


def test_residual_golden(spark):
    rows = []
    for word, base, probe in [("river", 1600, 1000), ("crab", 1600, 590), ("booth", 1000, 110), ("veg", 2900, 210), ("zero", 0, 5), ("none", None, 5), ("edge", 1000, 300), ("low", 1000, 100)]:
        rows += [(word, "us", base), (word, "kr", probe)]
    rows.append(("alone", "us", 100))
    df = spark.createDataFrame(rows, "keyword string, market string, volume long")
    got = {r.keyword: r.verdict for r in keywords.residual_ratio(df, "us", "kr").collect()}
    assert got == {"river": "genuine", "crab": "genuine", "booth": "review", "veg": "discard", "zero": "unknown",
                   "none": "unknown", "edge": "genuine", "low": "discard", "alone": "unknown"}


def survey(spark, rows):
    return spark.createDataFrame(
        [("s", "seed", k, "publications", Decimal(c) if c else None, p) for k, c, p in rows],
        "survey_id string, seed string, keyword string, channel string, cpc decimal(12,2), pub_30d int",
    ).withColumn("competition", F.lit(None).cast("int"))


def test_price_band_and_rank(spark):
    rows = [("a", "100", 5), ("b", "200", 50), ("c", "300", 200), ("d", "400", 8), ("e", None, 3), ("f", "400", None)]
    banded = keywords.with_price_band(keywords.with_entry(survey(spark, rows)))
    assert {r.keyword: r.cpc_band for r in banded.collect()} == {
        "a": "normal", "b": "normal", "c": "normal", "d": "high", "e": "unknown", "f": "high",
    }
    ranked = keywords.golden_rank(banded, n=8).orderBy("rank").collect()
    assert [r.keyword for r in ranked] == ["d", "a", "e", "b", "c", "f"]


@pytest.mark.parametrize(
    "rows, verdict, action",
    [
        ([("seed", "100", 5), ("x", "90", 200)], "usable", "write"),
        ([("seed", "100", 200), ("x", "90", 5)], "conditional", "long_tail"),
        ([("seed", "100", 200), ("x", "90", 300)], "avoid", "measure_other_channel"),
        ([("seed", None, None)], "unknown", "measure_again"),
    ],
)
def test_group_verdict(spark, rows, verdict, action):
    judged = keywords.with_price_band(keywords.with_entry(survey(spark, rows)))
    got = keywords.group_verdict(judged).first()
    assert (got.verdict, got.action) == (verdict, action)


def test_report_words(spark):
    df = spark.createDataFrame([(5270, 33, False), (None, 100, True), (1, None, None)], "v long, p int, c boolean")
    volume, posts = keywords.report_columns(F.col("v"), F.col("p"), F.col("c"))
    assert [tuple(r) for r in df.select(volume, posts).collect()] == [
        ("5,270", "33"), ("below measurement", "100+"), ("1", "unknown"),
    ]


def test_gap_needs_cuts(spark):
    seeds = spark.createDataFrame([("a", 487_888, 100, True), ("b", 10, 1, False), ("c", None, 5, False), ("d", 900, 0, False), ("e", 500, 100, False)],
                                  "seed string, demand long, supply int, supply_capped boolean")
    with pytest.raises(TypeError):
        keywords.gap_band(seeds)
    got = {r.seed: r.gap for r in keywords.gap_band(seeds, wide=1000, moderate=100, narrow=10, min_demand=50).collect()}
    assert got == {"a": "moderate", "b": "low_demand", "c": "unknown", "d": "wide", "e": "saturated"}


def test_demand_axes(spark):
    d = dt.date
    rows = [("k", "big", 40_000, 1000, d(2026, 2, 15)), ("k", "small", 39_999, 10, d(2026, 2, 14)), ("k", "small", 39_999, 20, d(2026, 8, 1))]
    videos = spark.createDataFrame(rows, "keyword string, channel string, followers long, views long, uploaded date")
    got = keywords.demand_axes(videos, "2026-08-15").first()
    assert (got.median_views, got.top_views, got.small_channel_videos, got.one_hit) == (20, 1000, 2, True)
    assert got.recent_share == pytest.approx(2 / 3)  # exactly six months ago still counts


def test_trailing(spark):
    d = dt.date
    posts = spark.createDataFrame([("k", d(2026, 1, 1)), ("k", d(2026, 1, 1)), ("k", d(2026, 1, 30)), ("k", d(2026, 1, 31))], "k string, day date")
    got = {r.day: r.trailing for r in keywords.trailing_count(posts, "k", "day").collect()}
    assert got == {d(2026, 1, 1): 2, d(2026, 1, 30): 3, d(2026, 1, 31): 2}


def test_flip(spark):
    rows = [("a", "publications", "hard"), ("a", "ads", "easy"), ("b", "publications", "hard"), ("b", "ads", "ok")]
    got = keywords.channel_flip(spark.createDataFrame(rows, "keyword string, channel string, entry string")).collect()
    assert [tuple(r) for r in got] == [("a", "publications", "ads")]


def test_stage_edges(spark):
    df = spark.createDataFrame([(999,), (1000,), (10_000,), (100_000,), (None,)], "n long")
    assert [r[0] for r in df.select(bands.audience_stage(F.col("n"))).collect()] == ["0-1K", "1K-10K", "10K-100K", "100K+", "unknown"]
