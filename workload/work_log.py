"""Work log queries: orders stand for work items, tasks and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.operators import ordered, recall, worklog
from workload.registry import query, table

AS_OF = "1998-06-01"

ITEMS_SQL = """
items AS (
  SELECT o_orderkey AS item_id,
    CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS item_date,
    CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'unmarked' END AS status,
    CASE WHEN o_orderkey % 5 = 0
      THEN CAST(o_orderdate AS DATE) + CAST(o_custkey % 900 AS INT) END AS confirmed_on
  FROM orders
)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as work items; every ninth has no date, every fifth a confirmation."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    day = F.to_date("o_orderdate")
    return orders.select(
        F.col("o_orderkey").alias("item_id"),
        F.when(F.col("o_orderkey") % 9 != 0, day).alias("item_date"),
        F.when(F.col("o_orderstatus") == "O", "open")
        .when(F.col("o_orderstatus") == "F", "closed")
        .otherwise("unmarked")
        .alias("status"),
        F.when(F.col("o_orderkey") % 5 == 0, F.date_add(day, (F.col("o_custkey") % 900).cast("int"))).alias(
            "confirmed_on"
        ),
    )


@query(
    "work_item_header",
    """
SELECT CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') || '-' ELSE '' END
    || 'handoff-' || o_orderkey || '.md' AS item_id,
  CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'none' END AS item_date,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'unmarked' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d') ELSE 'none' END AS closed_on,
  CASE WHEN o_orderstatus = 'F' THEN 'handoff-' || (o_orderkey + 1) || '.md' ELSE 'none' END AS successor,
  CASE WHEN o_orderstatus = 'O' THEN strftime(o_orderdate + INTERVAL 5 DAY, '%Y-%m-%d') ELSE 'none' END AS confirmed_on,
  o_custkey % 7 = 0 AS do_not_close,
  CASE WHEN o_custkey % 3 = 0 THEN 'plain ' || o_custkey ELSE '**bold ' || o_custkey || '**' END AS one_line
FROM orders
""",
)
def work_item_header(spark, sf_dir):
    """Handoff notes written from the orders and read back by their marks."""
    orders = table(spark, sf_dir, "orders")
    day = lambda n: F.date_format(F.date_add(F.to_date("o_orderdate"), n), "yyyy-MM-dd")
    name = F.concat(
        F.when(F.col("o_orderkey") % 9 != 0, F.concat(day(0), F.lit("-"))).otherwise(""),
        F.lit("handoff-"), F.col("o_orderkey"), F.lit(".md"),
    )
    state = (
        F.when(
            F.col("o_orderstatus") == "O",
            F.concat(F.lit("> 상태: 🔵 진행 (확인 "), day(5), F.lit(") (확인 "), day(2), F.lit(")\n")),
        )
        .when(
            F.col("o_orderstatus") == "F",
            F.concat(
                F.lit("> 상태: ✅ 종결 ("), day(9), F.lit(") → 후속: handoff-"),
                F.col("o_orderkey") + 1, F.lit(".md\n"),
            ),
        )
        .otherwise("")
    )
    keep = F.when(F.col("o_custkey") % 7 == 0, "아직 닫지 말 것\n").otherwise("")
    bold = F.when(F.col("o_custkey") % 3 == 0, "").otherwise(
        F.concat(F.lit("**bold "), F.col("o_custkey"), F.lit("**\n"))
    )
    body = F.concat(
        F.lit("# 핸드오프\n\n"), state, keep, F.lit("\n## 한 줄\n⟳ meta\n> quote\n\nplain "),
        F.col("o_custkey"), F.lit("\n"), bold, F.lit("\n## 남은 것\n**later**\n"),
    )
    notes = orders.select(name.alias("name"), body.alias("body"))
    found = worklog.work_item_header(notes)
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c)
    return found.select(
        "item_id", text_of("item_date"), "status", text_of("closed_on"), text_of("successor"),
        text_of("confirmed_on"), "do_not_close", "one_line",
    )


@query(
    "stale_work",
    f"""WITH {ITEMS_SQL}, stale AS (
  SELECT item_id, item_date FROM items
  WHERE status = 'open' AND item_date < DATE '{AS_OF}' - 3
    AND (confirmed_on IS NULL OR confirmed_on < DATE '{AS_OF}' - 3))
SELECT item_id, item_date, (SELECT count(*) FROM stale) AS total
FROM stale ORDER BY item_date, item_id LIMIT 3""",
)
def stale_work(spark, sf_dir):
    return worklog.stale_work(items(spark, sf_dir), AS_OF).select("item_id", "item_date", "total")


@query(
    "resume_candidates",
    f"""WITH {ITEMS_SQL}
SELECT item_id, status,
  CASE WHEN item_date < DATE '{AS_OF}' - 3 THEN 'OLD' ELSE 'NEW' END AS fold
FROM items WHERE status = 'open'
  OR (status = 'unmarked' AND item_date IN (DATE '{AS_OF}', DATE '{AS_OF}' - 1))""",
)
def resume_candidates(spark, sf_dir):
    return worklog.resume_candidates(items(spark, sf_dir), AS_OF).select("item_id", "status", "fold")


@query(
    "fold_counts",
    f"""WITH {ITEMS_SQL}
SELECT count(*) FILTER (item_date IS NULL OR item_date >= DATE '{AS_OF}' - 3) AS shown,
  count(*) FILTER (item_date < DATE '{AS_OF}' - 3) AS folded
FROM items WHERE status = 'open'
  OR (status = 'unmarked' AND item_date IN (DATE '{AS_OF}', DATE '{AS_OF}' - 1))""",
)
def fold_counts(spark, sf_dir):
    return worklog.fold_counts(worklog.resume_candidates(items(spark, sf_dir), AS_OF))


@query(
    "distinct_union",
    f"""WITH {ITEMS_SQL}
SELECT item_id FROM items WHERE status = 'open'
UNION SELECT item_id FROM items WHERE item_date IN (DATE '{AS_OF}', DATE '{AS_OF}' - 1)""",
)
def distinct_union(spark, sf_dir):
    """Open items together with those of today and yesterday, each once."""
    all_items = items(spark, sf_dir)
    today = F.lit(AS_OF).cast("date")
    recent = F.col("item_date").isin(today, F.date_sub(today, 1))
    return recall.distinct_union(
        all_items.filter(F.col("status") == "open").select("item_id"),
        all_items.filter(recent).select("item_id"),
    )


@query(
    "backlog_health",
    f"""WITH {ITEMS_SQL}
SELECT count(*) FILTER (status = 'open') AS "open",
  count(*) FILTER (status = 'open' AND item_date < DATE '{AS_OF}' - 3) AS stale,
  round(count(*) FILTER (status = 'open' AND item_date < DATE '{AS_OF}' - 3)
    / count(*) FILTER (status = 'open'), 6) AS share,
  count(*) FILTER (status = 'open' AND item_date < DATE '{AS_OF}' - 3
    AND confirmed_on >= DATE '{AS_OF}' - 3) AS stale_confirmed
FROM items""",
)
def backlog_health(spark, sf_dir):
    return worklog.backlog_health(items(spark, sf_dir), AS_OF).withColumn("share", F.round("share", 6))


@query(
    "own_last_item",
    """
WITH c AS (
  SELECT o_custkey, o_orderkey, o_orderdate,
    CASE WHEN o_orderpriority = '1-URGENT' AND o_custkey % 3 = 0 THEN 1
      WHEN o_orderstatus = 'P' AND o_custkey % 2 = 0 THEN 2
      WHEN o_totalprice > 400000 THEN 3 ELSE 4 END AS r
  FROM orders),
best AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY r, o_orderdate DESC, o_orderkey) AS rn FROM c)
SELECT o_custkey AS session, o_orderkey AS item_id,
  (['path', 'topic', 'folder', 'recency'])[r] AS evidence, r = 4 AS uncertain
FROM best WHERE rn = 1
""",
)
def own_last_item(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    candidates = orders.select(
        F.col("o_custkey").alias("session"),
        F.col("o_orderkey").alias("item_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_custkey") % 3 == 0)).alias("by_path"),
        ((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 2 == 0)).alias("by_topic"),
        (F.col("o_totalprice") > 400000).alias("by_folder"),
    )
    return worklog.own_last_item(candidates, "session")


CHAIN_SQL = """
chain AS (
  SELECT o_orderkey AS item_id, o_orderstatus AS status,
    CASE WHEN o_orderkey % 50 = 0 THEN -1 - o_orderkey
      ELSE lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS successor
  FROM orders
)"""


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of a customer as a chain; every fiftieth names an unknown successor."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    linked = ordered.next_value(
        orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderkey"), "next", F.year("o_orderdate")
    )
    return linked.select(
        F.col("o_orderkey").alias("item_id"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"),
        F.when(F.col("o_orderkey") % 50 == 0, -1 - F.col("o_orderkey")).otherwise(F.col("next")).alias("successor"),
    )


@query(
    "supersession_audit",
    f"""WITH {CHAIN_SQL}
SELECT item_id, successor, status = 'O' AS open_predecessor,
  successor NOT IN (SELECT o_orderkey FROM orders) AS dangling
FROM chain WHERE successor IS NOT NULL""",
)
def supersession_audit(spark, sf_dir):
    return worklog.supersession_audit(chained(spark, sf_dir))


@query(
    "chain_tips",
    f"""WITH RECURSIVE {CHAIN_SQL}, walk AS (
  SELECT item_id AS tip, item_id, 0 AS steps FROM chain
    WHERE successor IS NULL OR successor < 0
  UNION ALL
  SELECT w.tip, c.item_id, w.steps + 1 FROM walk w JOIN chain c ON c.successor = w.item_id)
SELECT item_id, tip, steps, false AS cyclic FROM walk""",
)
def chain_tips(spark, sf_dir):
    return worklog.chain_tips(chained(spark, sf_dir))


@query(
    "collisions",
    """
WITH j AS (
  SELECT l_orderkey, l_suppkey % 4 AS author, l_shipdate FROM lineitem WHERE l_returnflag <> 'R'),
t AS (
  SELECT l_orderkey, count(*) FILTER (author <> 0) AS others,
    bool_or(author = 0) AS mine, bool_or(author = 0 AND l_shipdate <> o_orderdate) AS elsewhen
  FROM j JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT o_orderkey AS item_id, coalesce(others > 0, false) AS other_author,
  coalesce(elsewhen, false) AS other_window,
  coalesce(others > 0, false) OR coalesce(elsewhen, false) AS demoted
FROM orders LEFT JOIN t ON l_orderkey = o_orderkey
""",
)
def collisions(spark, sf_dir):
    """Shipments as the journal; a returned one has no author."""
    candidates = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("ts")
    )
    journal = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item_id"),
        F.when(F.col("l_returnflag") != "R", F.concat(F.lit("s"), F.col("l_suppkey") % 4)).alias("author"),
        F.col("l_shipdate").alias("ts"),
    )
    return worklog.collisions(candidates, journal, "s0").drop("ts")


@query(
    "stale_parents",
    """
WITH p AS (
  SELECT o_custkey, count(*) AS sessions, max(o_orderdate) AS latest FROM orders GROUP BY 1)
SELECT c_custkey AS topic, sessions,
  strftime(latest, '%Y-%m-%d') AS latest,
  strftime(TIMESTAMP '1999-01-01' + to_days(c_nationkey * 30), '%Y-%m-%d') AS edited
FROM p JOIN customer ON c_custkey = o_custkey
WHERE sessions >= 3 AND TIMESTAMP '1999-01-01' + to_days(c_nationkey * 30) < latest
""",
)
def stale_parents(spark, sf_dir):
    progress = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("topic"), F.to_date("o_orderdate").alias("ts")
    )
    parents = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("topic"),
        F.date_add(F.lit("1999-01-01").cast("date"), F.col("c_nationkey") * 30).alias("edited"),
    )
    found = worklog.stale_parents(progress, parents)
    return found.select(
        "topic", "sessions", F.col("latest").cast("string"), F.col("edited").cast("string")
    )


@query(
    "task_focus",
    """
WITH t AS (
  SELECT o_custkey AS board, o_orderkey AS task, o_orderpriority AS priority,
    CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'Done'
      WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'In Progress'
      WHEN o_orderstatus = 'P' THEN 'In Review' ELSE 'Todo' END AS status FROM orders),
g AS (
  SELECT *, CASE status WHEN 'In Progress' THEN 1 WHEN 'In Review' THEN 2 ELSE 3 END AS grp
  FROM t WHERE status <> 'Done'),
r AS (
  SELECT *, row_number() OVER (PARTITION BY board ORDER BY grp, priority, task) AS place,
    row_number() OVER (PARTITION BY board ORDER BY grp = 2, grp, priority, task) AS pick FROM g)
SELECT board, task, status, priority, place, pick = 1 AND grp <> 2 AS suggested FROM r
""",
)
def task_focus(spark, sf_dir):
    status = (
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW"), "Done")
        .when((F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 2 == 0), "In Progress")
        .when(F.col("o_orderstatus") == "P", "In Review")
        .otherwise("Todo")
    )
    tasks = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("board"), F.col("o_orderkey").alias("task"),
        status.alias("status"), F.col("o_orderpriority").alias("priority"),
    )
    return worklog.task_focus(tasks, "board")


SESSIONS_SQL = """
cut AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM cut)"""


@query(
    "activity_sessions",
    f"""WITH {SESSIONS_SQL}
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS prompts
FROM numbered GROUP BY user_id, s""",
)
def activity_sessions(spark, sf_dir):
    activity = table(spark, sf_dir, "events", "user_id", "ts")
    return seconds(worklog.activity_sessions(activity, "user_id", 6 * 3600))


@query(
    "interrupted_sessions",
    f"""WITH {SESSIONS_SQL}
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS prompts
FROM numbered GROUP BY user_id, s HAVING count(*) FILTER (event_type = 'purchase') = 0""",
)
def interrupted_sessions(spark, sf_dir):
    """A purchase is a save, every other event a prompt."""
    events = table(spark, sf_dir, "events", "user_id", "ts", "event_type")
    activity = events.filter(F.col("event_type") != "purchase")
    saves = events.filter(F.col("event_type") == "purchase")
    return seconds(worklog.interrupted_sessions(activity, saves, "user_id", 6 * 3600))


def seconds(df: DataFrame) -> DataFrame:
    for c in ("started", "ended"):
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df
