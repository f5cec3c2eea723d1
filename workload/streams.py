"""Streaming queries: each reads a table as a file stream and is run to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.operators import routing
from galley.schema import PROMPT
from galley.session import scratch_path
from galley.streaming import operators as streaming
from galley.streaming import run
from workload import prompt_log, recall_routing, work_log
from workload import sqltext as Q
from workload.registry import query, table


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table, which is one file or a folder of them: a stream takes both where the path is a pattern."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def finished(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there and read what it wrote."""
    path = scratch_path(spark, "stream")
    run.to_batches(df, path, scratch_path(spark, "progress"), mode).awaitTermination()
    return run.read_batches(spark, path, df.schema)


@query(
    "stream_prompts",
    f"""WITH {prompt_log.TYPED_SQL}, hashed AS (
  SELECT DISTINCT session_id, content, sha256(session_id || ':' || content) AS h FROM kept)
SELECT {prompt_log.KEY_SQL} AS turn_uuid, content AS prompt_text FROM hashed""",
)
def stream_prompts(spark, sf_dir):
    turns = stream(spark, sf_dir, "conversations")
    events = turns.select(
        F.format_string("conv-%d", "conv_id").alias("session_id"),
        F.col("role").alias("type"),
        F.col("text").alias("content"),
        F.lit(True).alias("is_text"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("ts"),
        F.lit(None).cast("string").alias("cwd"),
    )
    store = scratch_path(spark, "prompts")
    for _ in range(2):  # the second run has nothing new to load
        streaming.load_prompts(events, store, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.schema(PROMPT).parquet(store).select("turn_uuid", "prompt_text")


@query(
    "stream_trailing_count",
    """WITH e AS (
  SELECT user_id, CAST(ts AS DATE) - CAST(unnest(range(0, 7)) AS INT) AS start FROM events)
SELECT user_id, strftime(start, '%Y-%m-%d') AS window_start, count(*) AS posts FROM e GROUP BY ALL""",
)
def stream_trailing_count(spark, sf_dir):
    posts = stream(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    store = scratch_path(spark, "posts")
    streaming.count_posts(posts, "user_id", store, scratch_path(spark, "progress")).awaitTermination()
    daily = streaming.posts_per_day(spark, store, "user_id", posts.schema["user_id"].dataType.simpleString())
    last = streaming.trailing_count(daily, "user_id", 7)
    return last.select("user_id", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "posts")


def notices(df: DataFrame) -> DataFrame:
    """Views are told daily, clicks by default, errors at once, the rest never."""
    notify = (
        F.when(F.col("event_type") == "view", "daily")
        .when(F.col("event_type") == "click", F.lit(None))
        .when(F.col("event_type") == "error", "immediate")
        .otherwise("none")
    )
    return df.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), notify.alias("notify"))


@query(
    "stream_digest",
    """WITH d AS (SELECT * FROM events WHERE event_type IN ('view', 'click'))
SELECT event_type, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS items FROM d
WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) FROM d) - INTERVAL 1 HOUR GROUP BY ALL""",
)
def stream_digest(spark, sf_dir):
    store = scratch_path(spark, "digest")
    rows = notices(stream(spark, sf_dir, "events"))
    streaming.tell_digest(rows, "event_type", store, scratch_path(spark, "progress")).awaitTermination()
    told = spark.read.schema("event_type string, day date, items long").parquet(f"{store}/told")
    return told.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "items")


@query(
    "daily_digest",
    """SELECT event_type, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS items
FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL""",
)
def daily_digest(spark, sf_dir):
    told = routing.daily_digest(notices(table(spark, sf_dir, "events")), "event_type")
    return told.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "items")


@query(
    "stream_immediate",
    "SELECT event_id, event_type FROM events WHERE event_type = 'error'",
)
def stream_immediate(spark, sf_dir):
    told = routing.immediate_notices(notices(stream(spark, sf_dir, "events")))
    return finished(spark, told.select("event_id", "event_type"), "append").drop("batch")


@query(
    "stream_idle_items",
    """WITH cut AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 DAY THEN 0 ELSE 1 END AS starts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM cut),
g AS (SELECT user_id, max(ts) AS last_seen, arg_max(event_type, ts) AS kind FROM n GROUP BY user_id, s)
SELECT user_id, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen FROM g
WHERE kind <> 'purchase' AND last_seen + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def stream_idle_items(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "close").otherwise("work")
    activity = stream(spark, sf_dir, "events").select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind")
    )
    alerts = finished(spark, streaming.idle_items(activity, "user_id", "2 days"), "append")
    return alerts.select("user_id", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


@query(
    "stream_interrupted_sessions",
    f"""WITH {work_log.SESSIONS_SQL}, edge AS (
  SELECT least(max(ts) FILTER (event_type = 'purchase'), max(ts) FILTER (event_type <> 'purchase')) - INTERVAL 1 HOUR AS edge FROM events)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS prompts
FROM numbered, edge GROUP BY user_id, s, edge
HAVING count(*) FILTER (event_type = 'purchase') = 0 AND max(ts) + INTERVAL 6 HOUR - INTERVAL 1 MICROSECOND <= edge""",
)
def stream_interrupted_sessions(spark, sf_dir):
    """Sessions that are over by the watermark of the slower of the two streams; a purchase is a save."""
    events = stream(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    activity = events.filter(F.col("event_type") != "purchase")
    saves = events.filter(F.col("event_type") == "purchase")
    found = finished(spark, streaming.interrupted_sessions(activity, saves, "user_id", 6 * 3600), "append")
    return work_log.seconds(found.drop("batch"))


@query("stream_route", f"WITH {recall_routing.MAPPED_SQL} SELECT doc_id, object_id, route FROM routed")
def stream_route(spark, sf_dir):
    texts = stream(spark, sf_dir, "documents").select("doc_id", "text")
    objects = recall_routing.objects(spark, sf_dir)
    mapped, review = scratch_path(spark, "mapped"), scratch_path(spark, "review")
    streaming.route(
        texts, objects, "doc_id", "text", mapped, review, scratch_path(spark, "progress")
    ).awaitTermination()
    schema = "doc_id long, matched long, object_id string, route string"
    both = spark.read.schema(schema).parquet(mapped).unionByName(
        spark.read.schema(schema).parquet(f"{review}/queue")
    )
    return both.select("doc_id", "object_id", "route")
