"""Streaming forms of the incremental rules, all with built-in operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from galley.operators import prompts, recall
from galley.schema import require
from galley.sources import sinks
from galley.streaming import run


def keyed_prompts(events: DataFrame) -> DataFrame:
    """Typed prompts with their keys, whatever their time; an event may have none."""
    return prompts.keyed(prompts.typed_prompts(events))


def load_prompts(events: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Load a stream of events once, in any order of their times.

    No watermark: an event is never too late. Of repeats inside a batch the first
    by time counts, whatever their order in the files; later ones, and batches
    delivered again, are stopped by the keys already in the store.
    """

    def load(batch: DataFrame, _: int) -> None:
        first = prompts.first_occurrence(batch, ["turn_uuid"], ["ts", *[c for c in batch.columns if c not in ("turn_uuid", "ts")]])
        sinks.insert_new(first, store, "turn_uuid")

    return run.for_each_batch(keyed_prompts(events), load, checkpoint)


def count_posts(posts: DataFrame, keyword: str, store: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Counts per keyword and day, each batch in its own folder, and an account of late rows beside them.

    A row is late when it is older than the newest row of all earlier batches by
    more than the delay. Late rows are counted, not added, so of each batch
    arrived = counted + late. Nothing is kept but one row per keyword, day and
    batch; a batch that is delivered again sees the same earlier accounts and
    replaces both its folders.
    """
    require(posts, keyword, "ts")

    def load(batch: DataFrame, number: int) -> None:
        before = run.read_accounts(batch.sparkSession, store).filter(F.col("batch") < number)
        edge = before.agg((F.max("newest") - F.expr(f"INTERVAL {delay}")).alias("edge")).first()["edge"]
        late = F.coalesce(F.col("ts") < F.lit(edge).cast("timestamp"), F.lit(False))
        with_account = run.accounted(batch, store, number, late, "ts")
        daily = with_account.rows.filter(~late).groupBy(keyword, F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("posts"))
        daily.write.mode("overwrite").parquet(f"{store}/days/batch={number}")
        with_account.write()

    return run.for_each_batch(posts.select(keyword, "ts"), load, checkpoint)


def posts_per_day(spark: SparkSession, store: str, keyword: str, kind: str, upto: int | None = None) -> DataFrame:
    """(keyword, day, posts) of all batches so far, or up to one; `kind` is the type of the keyword."""
    stored = spark.read.schema(f"`{keyword}` {kind}, day date, posts long, batch long").parquet(f"{store}/days")
    if upto is not None:
        stored = stored.filter(F.col("batch") <= upto)
    return stored.groupBy(keyword, "day").agg(F.sum("posts").alias("posts"))


def trailing_count(daily: DataFrame, keyword: str, days: int = 30) -> DataFrame:
    """(keyword, window_start, window_end, posts) of every window of `days` days, a day apart, from counts per day.

    Only the counted days are spread over the windows that hold them, not the posts.
    """
    require(daily, keyword, "day", "posts")
    starts = F.explode(F.sequence(F.date_sub("day", days - 1), F.col("day"))).alias("window_start")
    return (
        daily.select(keyword, starts, "posts")
        .groupBy(keyword, "window_start")
        .agg(F.sum("posts").alias("posts"))
        .select(keyword, "window_start", F.date_add("window_start", days).alias("window_end"), "posts")
    )


def daily_digest(rows: DataFrame, by: str, delay: str = "1 hour") -> DataFrame:
    """(by, day, items), told once when the day is over."""
    require(rows, by, "ts", "notify")
    wanted = rows.filter(F.coalesce("notify", F.lit("daily")) == "daily")
    return (
        wanted.withWatermark("ts", delay)
        .groupBy(by, F.window("ts", "1 day").alias("_w"))
        .agg(F.count(F.lit(1)).alias("items"))
        .select(by, F.col("_w.start").alias("day"), "items")
    )


def tell_digest(rows: DataFrame, by: str, store: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Daily digests as rows arrive, told once per day in `told`, with an account of late rows.

    A day is over when the newest row so far is later than its end by the delay. A
    row of a day that was told before its batch is late: it is counted in the account and not
    added, so arrived = told + late + what lies in days that are still open. Counts of a day and batch are all
    that is kept. A batch that is delivered again replaces its own folders.
    """
    require(rows, by, "ts", "notify")
    wanted = rows.filter(F.coalesce("notify", F.lit("daily")) == "daily").select(by, "ts")
    kind = wanted.schema[by].dataType.simpleString()

    def load(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        edge = lambda accounts: accounts.agg((F.max("newest") - F.expr(f"INTERVAL {delay}")).alias("e")).first()["e"]
        over = lambda day, at: F.coalesce(F.date_add(day, 1).cast("timestamp") <= F.lit(at).cast("timestamp"), F.lit(False))
        before = edge(run.read_accounts(spark, store).filter(F.col("batch") < number))
        late = over(F.to_date("ts"), before)
        with_account = run.accounted(batch, store, number, late, "ts")
        daily = with_account.rows.filter(~late).groupBy(by, F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("posts"))
        daily.write.mode("overwrite").parquet(f"{store}/days/batch={number}")
        with_account.write()
        after = edge(run.read_accounts(spark, store).filter(F.col("batch") <= number))
        closed = posts_per_day(spark, store, by, kind, number).filter(over(F.col("day"), after) & ~over(F.col("day"), before))
        closed.withColumnRenamed("posts", "items").write.mode("overwrite").parquet(f"{store}/told/batch={number}")

    return run.for_each_batch(wanted, load, checkpoint)


def idle_items(activity: DataFrame, item: str, silence: str = "3 days", delay: str = "1 hour") -> DataFrame:
    """(item, last_seen): one alert each time an open item falls silent.

    A span of activity is a session that ends after the silence: a
    confirmation extends it, and a span that ends with a closing raises no
    alert. Spans of one item are merged in the map tasks, so a busy item does
    not fill one task.
    """
    require(activity, item, "ts", "kind")
    return (
        activity.withWatermark("ts", delay)
        .groupBy(item, F.session_window("ts", silence).alias("_w"))
        .agg(F.max(F.struct("ts", "kind")).alias("_last"))
        .filter(F.col("_last.kind") != "close")
        .select(item, F.col("_last.ts").alias("last_seen"))
    )


def interrupted_sessions(
    activity: DataFrame, saves: DataFrame, by: str, gap_seconds: int = 1_800, delay: str = "1 hour"
) -> DataFrame:
    """(by, started, ended, prompts): sessions with prompts and no save, told once when they are over.

    Prompts and saves are tagged and share one session window, so a save extends
    the session it belongs to and no stream is joined with the other. Each side
    has its own watermark and the slower one closes a session: as long as saves
    may still come, no session counts as interrupted. A pause as long as the gap
    ends a session, so the window is a microsecond shorter than the gap.
    """
    require(activity, by, "ts")
    require(saves, by, "ts")
    prompted = activity.select(by, "ts", F.lit(True).alias("_p")).withWatermark("ts", delay)
    saved = saves.select(by, "ts", F.lit(False).alias("_p")).withWatermark("ts", delay)
    window = F.session_window("ts", f"{gap_seconds * 1_000_000 - 1} microseconds")
    return (
        prompted.unionByName(saved)
        .groupBy(by, window.alias("_w"))
        .agg(
            F.min("ts").alias("started"),
            F.max("ts").alias("ended"),
            F.count_if("_p").alias("prompts"),
            F.count_if(~F.col("_p")).alias("_saves"),
        )
        .filter((F.col("prompts") > 0) & (F.col("_saves") == 0))
        .select(by, "started", "ended", "prompts")
    )


def route(
    texts: DataFrame, objects: DataFrame, key: str, body: str, mapped: str, review: str, checkpoint: str
) -> StreamingQuery:
    """Map each micro-batch to objects and write mapped and unclear texts apart."""

    def write(batch: DataFrame, number: int) -> None:
        routed = recall.map_objects(batch, objects, key, body)
        decided = f"{review}/decided/batch={number}"
        routed.write.mode("overwrite").parquet(decided)
        stored = batch.sparkSession.read.schema(routed.schema).parquet(decided)
        for name, path in (("mapped", mapped), ("review", f"{review}/queue")):
            part = stored.filter(F.col("route") == name)
            part.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run.for_each_batch(texts, write, checkpoint)
