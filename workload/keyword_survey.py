"""Keyword queries: users stand for keywords and event types for surveys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import bands
from galley.operators import keywords
from galley.plans import keyword_survey
from galley.session import scratch_path
from galley.sources import sinks
from workload.registry import query, table

KEYWORDS_SQL = """
kw AS (
  SELECT event_type AS survey_id, 'u' || length(event_type) AS seed, 'u' || user_id AS keyword,
    CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'publications' ELSE 'ads' END AS channel,
    CASE WHEN user_id % 11 <> 0 THEN sum(CAST(props->>'k' AS INT)) END AS volume,
    CASE WHEN user_id % 13 <> 0 THEN max(value) END AS cpc,
    CASE WHEN user_id % 17 <> 0 THEN sum(CAST(props->>'k' AS INT)) % 130 END AS pub_30d,
    CASE WHEN user_id % 19 <> 0 THEN sum(CAST(props->>'k' AS INT)) % 101 END AS competition
  FROM events GROUP BY event_type, user_id
), entry AS (
  SELECT *, CASE WHEN channel = 'publications' THEN
      CASE WHEN pub_30d IS NULL THEN 'unknown' WHEN pub_30d < 10 THEN 'easy'
        WHEN pub_30d < 100 THEN 'ok' ELSE 'hard' END
    ELSE CASE WHEN competition IS NULL THEN 'unknown' WHEN competition <= 33 THEN 'easy'
        WHEN competition <= 66 THEN 'ok' ELSE 'hard' END END AS entry,
    CASE WHEN channel = 'publications' THEN 'A-' ELSE 'B' END AS evidence
  FROM kw
), cut AS (
  SELECT survey_id, quantile_cont(cpc, 0.75) AS q FROM kw GROUP BY 1
), banded AS (
  SELECT e.*, CASE WHEN cpc IS NULL THEN 'unknown' WHEN cpc >= q THEN 'high' ELSE 'normal' END AS cpc_band
  FROM entry e JOIN cut USING (survey_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY
    CASE entry WHEN 'easy' THEN 1 WHEN 'ok' THEN 2 WHEN 'hard' THEN 3 ELSE 4 END,
    cpc DESC NULLS LAST, keyword) AS rank FROM banded
), verdicts AS (
  SELECT survey_id,
    CASE WHEN bool_and(entry = 'unknown') THEN 'unknown'
      WHEN bool_or(entry IN ('easy', 'ok') AND keyword = seed) THEN 'usable'
      WHEN bool_or(entry IN ('easy', 'ok')) THEN 'conditional' ELSE 'avoid' END AS verdict,
    CASE WHEN bool_and(entry = 'unknown') THEN 'measure_again'
      WHEN bool_or(entry IN ('easy', 'ok') AND cpc_band = 'high') THEN 'write'
      WHEN NOT bool_or(entry IN ('easy', 'ok')) AND bool_or(channel = 'publications') THEN 'measure_other_channel'
      WHEN bool_or(entry = 'hard' AND cpc_band = 'high') THEN 'long_tail' ELSE 'narrow' END AS action
  FROM banded GROUP BY 1
)"""


def keyword_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey rows summed from the events, with gaps where nothing was measured."""
    events = table(spark, sf_dir, "events", "user_id", "event_type", "value", "props")
    k = F.sum(F.get_json_object("props", "$.k").cast("int"))
    user = F.col("user_id")
    return events.groupBy("event_type", "user_id").agg(k.alias("_k"), F.max("value").alias("_v")).select(
        F.col("event_type").alias("survey_id"),
        F.concat(F.lit("u"), F.length("event_type")).alias("seed"),
        F.concat(F.lit("u"), user).alias("keyword"),
        F.when(F.col("event_type").isin("view", "click", "signup"), bands.PUBLICATIONS)
        .otherwise(bands.ADS)
        .alias("channel"),
        F.when(user % 11 != 0, F.col("_k")).alias("volume"),
        F.when(user % 13 != 0, F.col("_v")).alias("cpc"),
        F.when(user % 17 != 0, F.col("_k") % 130).alias("pub_30d"),
        F.when(user % 19 != 0, F.col("_k") % 101).alias("competition"),
    )


@query(
    "entry_band",
    f"WITH {KEYWORDS_SQL} SELECT survey_id, keyword, channel, entry, evidence FROM entry",
)
def entry_band(spark, sf_dir):
    rows = keywords.with_entry(keyword_rows(spark, sf_dir))
    return rows.select("survey_id", "keyword", "channel", "entry", "evidence")


@query(
    "report_format",
    f"""WITH {KEYWORDS_SQL}
SELECT survey_id, keyword, coalesce(format('{{:,}}', CAST(volume AS BIGINT)), 'below measurement') AS volume_text,
  CASE WHEN pub_30d IS NULL THEN 'unknown' WHEN pub_30d >= 100 THEN '100+'
    ELSE CAST(CAST(pub_30d AS BIGINT) AS VARCHAR) END AS posts_text FROM kw""",
)
def report_format(spark, sf_dir):
    rows = keyword_rows(spark, sf_dir)
    capped = F.col("pub_30d") >= 100
    posts = F.least(F.col("pub_30d"), F.lit(100))
    volume_text, posts_text = keywords.report_columns(
        F.col("volume"), F.when(F.col("pub_30d").isNotNull(), posts), capped
    )
    return rows.select(
        "survey_id", "keyword", volume_text.alias("volume_text"), posts_text.alias("posts_text")
    )


@query("cpc_band", f"WITH {KEYWORDS_SQL} SELECT survey_id, keyword, cpc_band FROM banded")
def cpc_band(spark, sf_dir):
    rows = keywords.with_price_band(keyword_rows(spark, sf_dir))
    return rows.select("survey_id", "keyword", "cpc_band")


@query(
    "golden_rank",
    f"WITH {KEYWORDS_SQL} SELECT survey_id, keyword, entry, rank FROM ranked WHERE rank <= 8",
)
def golden_rank(spark, sf_dir):
    rows = keywords.golden_rank(keywords.with_entry(keyword_rows(spark, sf_dir)))
    return rows.select("survey_id", "keyword", "entry", "rank")


@query("group_verdict", f"WITH {KEYWORDS_SQL} SELECT * FROM verdicts")
def group_verdict(spark, sf_dir):
    return keywords.group_verdict(keyword_survey.banded(keyword_rows(spark, sf_dir)))


@query(
    "survey_report",
    f"""WITH {KEYWORDS_SQL}
SELECT survey_id, rank, keyword, entry, cpc_band, verdict, action
FROM ranked JOIN verdicts USING (survey_id) WHERE rank <= 8""",
)
def survey_report(spark, sf_dir):
    report = keyword_survey.survey_report(keyword_rows(spark, sf_dir))
    return report.select("survey_id", "rank", "keyword", "entry", "cpc_band", "verdict", "action")


@query(
    "channel_flip",
    f"""WITH {KEYWORDS_SQL}, f AS (
  SELECT keyword, channel, bool_or(entry = 'easy') AS easy, bool_or(entry = 'hard') AS hard
  FROM entry GROUP BY ALL)
SELECT h.keyword, h.channel AS saturated_on, e.channel AS open_on
FROM f h JOIN f e ON h.keyword = e.keyword AND h.channel <> e.channel
WHERE h.hard AND NOT h.easy AND e.easy""",
)
def channel_flip(spark, sf_dir):
    return keywords.channel_flip(keywords.with_entry(keyword_rows(spark, sf_dir)))


@query(
    "residual_ratio",
    """
WITH v AS (
  SELECT user_id, count(*) FILTER (event_type = 'view') AS b,
    count(*) FILTER (event_type = 'click') AS p FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)
SELECT user_id AS keyword,
  CASE WHEN b = 0 THEN 'unknown' WHEN p = 0 THEN 'unknown' WHEN p / b >= 0.30 THEN 'genuine'
    WHEN p / b <= 0.10 THEN 'discard' ELSE 'review' END AS verdict
FROM v
""",
)
def residual_ratio(spark, sf_dir):
    """Views are the home market, clicks the probe market."""
    rows = table(spark, sf_dir, "events", "user_id", "event_type").select(
        F.col("user_id").alias("keyword"), F.col("event_type").alias("market"), F.lit(1).alias("volume")
    )
    return keywords.residual_ratio(rows, "view", "click").select("keyword", "verdict")


@query(
    "demand_axes",
    """
WITH f AS (
  SELECT o_orderpriority AS keyword, count(*) AS videos, median(o_totalprice) AS m, max(o_totalprice) AS top_views,
    count(*) FILTER (o_custkey * 60 < 40000) AS small_channel_videos,
    avg(CASE WHEN o_orderdate >= DATE '2000-07-01' THEN 1.0 ELSE 0.0 END) AS r
  FROM orders GROUP BY 1)
SELECT keyword, videos, round(m, 4) AS median_views, top_views, small_channel_videos,
  round(r, 6) AS recent_share, top_views / m >= 1.9 AS one_hit FROM f
""",
)
def demand_axes(spark, sf_dir):
    """Orders as videos: the price is the views, the customer the channel."""
    videos = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("keyword"),
        F.col("o_custkey").alias("channel"),
        (F.col("o_custkey") * 60).alias("followers"),
        F.col("o_totalprice").alias("views"),
        F.to_date("o_orderdate").alias("uploaded"),
    )
    return (
        keywords.demand_axes(videos, "2001-01-01", one_hit=1.9)
        .withColumn("median_views", F.round("median_views", 4))
        .withColumn("recent_share", F.round("recent_share", 6))
    )


@query(
    "audience_label",
    """WITH n AS (
  SELECT o_orderpriority AS keyword, CASE WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE c_mktsegment END AS audience, count(*) AS n
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
SELECT keyword, first(audience ORDER BY n DESC, audience DESC) AS audience, round(max(n) / sum(n), 6) AS share FROM n GROUP BY 1""",
)
def audience_label(spark, sf_dir):
    """Customers as channels; every fourth has no label."""
    videos = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("keyword"), F.col("o_custkey").alias("channel")
    )
    labels = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("channel"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("audience")
    )
    return keywords.audience_label(videos, labels).withColumn("share", F.round("share", 6))


@query(
    "volatile_metrics",
    """
SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS measured,
  min(value) AS low, max(value) AS high, min(value) <> max(value) AS volatile
FROM events GROUP BY ALL
""",
)
def volatile_metrics(spark, sf_dir):
    events = table(spark, sf_dir, "events", "user_id", "event_type", "ts", "value")
    daily = events.withColumn("day", F.to_date("ts"))
    return keywords.volatile_metrics(daily, ["user_id", "event_type", "day"], "value")


@query(
    "gap_band",
    """
WITH s AS (
  SELECT user_id AS seed, CASE WHEN user_id % 23 <> 0 THEN sum(CAST(props->>'k' AS INT)) END AS demand,
    count(*) FILTER (event_type = 'error') AS supply,
    count(*) FILTER (event_type = 'error') >= 18 AS capped FROM events GROUP BY 1)
SELECT seed, CASE WHEN demand IS NULL THEN 'unknown' WHEN demand < 2500 THEN 'low_demand'
    WHEN supply = 0 THEN 'wide'
    WHEN demand / supply >= 300 THEN CASE WHEN capped THEN 'moderate' ELSE 'wide' END
    WHEN demand / supply >= 220 THEN CASE WHEN capped THEN 'narrow' ELSE 'moderate' END
    WHEN demand / supply >= 180 THEN 'narrow' ELSE 'saturated' END AS gap FROM s
""",
)
def gap_band(spark, sf_dir):
    events = table(spark, sf_dir, "events", "user_id", "event_type", "props")
    seeds = events.groupBy(F.col("user_id").alias("seed")).agg(
        F.sum(F.get_json_object("props", "$.k").cast("int")).alias("demand"),
        F.count_if(F.col("event_type") == "error").alias("supply"),
    )
    seeds = seeds.withColumn("demand", F.when(F.col("seed") % 23 != 0, F.col("demand"))).withColumn(
        "supply_capped", F.col("supply") >= 18
    )
    return keywords.gap_band(seeds, wide=300, moderate=220, narrow=180, min_demand=2500).select("seed", "gap")


@query(
    "trailing_count",
    """
WITH d AS (SELECT user_id AS keyword, CAST(ts AS DATE) AS day, count(*) AS posts FROM events GROUP BY ALL)
SELECT keyword, day, posts, CAST(sum(posts) OVER (PARTITION BY keyword ORDER BY day
  RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing FROM d
""",
)
def trailing_count(spark, sf_dir):
    """A week instead of thirty days, since the events cover one month."""
    posts = table(spark, sf_dir, "events", "user_id", "ts").select(
        F.col("user_id").alias("keyword"), F.to_date("ts").alias("day")
    )
    return keywords.trailing_count(posts, "keyword", "day", 7)


SNAPSHOT_SQL = """
snap AS (
  SELECT l_suppkey AS keyword, CAST(date_trunc('month', l_shipdate) AS DATE) AS survey_date,
    max(l_extendedprice) AS cpc FROM lineitem GROUP BY ALL
)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", "l_extendedprice")
    return lines.groupBy(
        F.col("l_suppkey").alias("keyword"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("survey_date")
    ).agg(F.max("l_extendedprice").alias("cpc"))


@query(
    "price_trend",
    f"""WITH {SNAPSHOT_SQL}, c AS (
  SELECT *, cpc - lag(cpc) OVER (PARTITION BY keyword ORDER BY survey_date) AS change FROM snap)
SELECT keyword, survey_date, cpc, round(coalesce(change, 0), 4) AS change,
  coalesce(change > 0, false) AS rising FROM c""",
)
def price_trend(spark, sf_dir):
    trend = keywords.price_trend(snapshots(spark, sf_dir))
    return trend.withColumn("change", F.round(F.coalesce("change", F.lit(0.0)), 4))


@query(
    "append_snapshot",
    f"""WITH {SNAPSHOT_SQL}
SELECT survey_date, count(*) AS keywords, round(sum(cpc), 2) AS total FROM snap GROUP BY 1""",
)
def append_snapshot(spark, sf_dir):
    """Every survey month, stored twice; a repeat replaces its own month."""
    path = scratch_path(spark, "surveys")
    rows = snapshots(spark, sf_dir)
    for _ in range(2):
        sinks.append_snapshot(rows, path)
    stored = spark.read.schema("keyword long, cpc double, survey_date date").parquet(path)
    return stored.groupBy("survey_date").agg(
        F.count(F.lit(1)).alias("keywords"), F.round(F.sum("cpc"), 2).alias("total")
    )


@query(
    "placement_plan",
    """
WITH t AS (
  SELECT p_brand AS channel, p_name || ' ' || p_partkey AS topic,
    CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'story' ELSE 'search' END AS kind,
    CASE WHEN p_size < 15 THEN 1 WHEN p_size < 30 OR p_partkey % 4 = 0 THEN 2 ELSE 3 END AS tier,
    CAST(floor(p_retailprice) AS BIGINT) AS volume FROM part)
SELECT channel, row_number() OVER (PARTITION BY channel, kind ORDER BY tier, volume DESC, topic) AS week,
  kind, topic, tier FROM t
""",
)
def placement_plan(spark, sf_dir):
    topics = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("channel"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("topic"),
        F.when(F.col("p_type").isin("SMALL", "LARGE"), "story").otherwise("search").alias("kind"),
        F.when(F.col("p_size") < 15, "easy").when(F.col("p_size") < 30, "ok").otherwise("hard").alias("entry"),
        (F.col("p_partkey") % 4 == 0).alias("differentiated"),
        F.floor("p_retailprice").alias("volume"),
    )
    return keywords.placement_plan(topics, "channel")


@query(
    "audience_stage",
    """
SELECT c_custkey, CASE WHEN c_acctbal * 12 < 1000 THEN '0-1K' WHEN c_acctbal * 12 < 10000 THEN '1K-10K'
  WHEN c_acctbal * 12 < 100000 THEN '10K-100K' ELSE '100K+' END AS stage FROM customer
""",
)
def audience_stage(spark, sf_dir):
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    return customers.select("c_custkey", bands.audience_stage(F.col("c_acctbal") * 12).alias("stage"))
