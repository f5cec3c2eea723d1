"""Prompt log queries on the conversations table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import keys, text
from galley.operators import prompts
from galley.plans import prompt_load
from galley.session import scratch_path
from galley.sources import sinks, transcripts
from workload.registry import query, table, texts


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as transcript events: a conversation is a session."""
    return table(spark, sf_dir, "conversations").select(
        F.format_string("conv-%d", "conv_id").alias("session_id"),
        F.col("turn").alias("line_no"),
        F.col("role").alias("type"),
        F.col("text").alias("content"),
        F.lit(True).alias("is_text"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("ts"),
        F.lit(None).cast("string").alias("cwd"),
    )


def doubled(df: DataFrame) -> DataFrame:
    """Every event again at a later line of the same session."""
    return df.unionByName(df.withColumn("line_no", F.col("line_no") + 1000))


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as raw JSON lines, with a broken, a blank and a list line for each."""
    turns = table(spark, sf_dir, "conversations")
    good = F.to_json(
        F.struct(
            F.col("role").alias("type"),
            F.struct(F.col("text").alias("content")).alias("message"),
            F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
        )
    )
    blocks = F.to_json(
        F.struct(
            F.col("role").alias("type"),
            F.struct(F.array(F.struct(F.col("text").alias("text"))).alias("content")).alias("message"),
        )
    )
    return turns.select(
        F.format_string("conv-%d", "conv_id").alias("session_id"),
        F.col("turn").alias("line_no"),
        F.explode(F.array(good, blocks, F.lit("{broken"), F.lit(" "))).alias("value"),
    )


# The text a prompt is judged by, as SQL: white space trimmed, two units at least.
TYPED_SQL = """
typed AS (
  SELECT 'conv-' || conv_id AS session_id, turn, conv_id,
         regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS content
  FROM conversations WHERE role = 'user'
), kept AS (
  SELECT * FROM typed
  WHERE length(content) >= 2 AND NOT starts_with(content, '<')
    AND NOT starts_with(content, 'Caveat:')
    AND NOT starts_with(content, '[Request interrupted')
    AND NOT starts_with(content, 'This session is being continued')
)"""

KEY_SQL = """concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4),
  substr(h, 17, 4), substr(h, 21, 12))"""


@query(
    "read_transcripts",
    """
WITH e AS (
  SELECT role, k FROM conversations, (VALUES ('text'), ('list')) v(k)
)
SELECT role AS type, k = 'text' AS is_text, count(*) AS events FROM e GROUP BY ALL
""",
)
def read_transcripts(spark, sf_dir):
    """JSON lines written to files, read back with bad lines skipped."""
    path = scratch_path(spark, "transcripts")
    lines = transcript_lines(spark, sf_dir)
    lines.select("value").write.text(path)
    return (
        transcripts.read_transcripts(spark, path)
        .groupBy("type", "is_text")
        .agg(F.count(F.lit(1)).alias("events"))
    )


@query(
    "typed_prompts",
    f"WITH {TYPED_SQL} SELECT session_id, turn AS line_no, content FROM kept",
)
def typed_prompts(spark, sf_dir):
    return prompts.typed_prompts(events(spark, sf_dir)).select("session_id", "line_no", "content")


@query(
    "turn_key",
    f"""WITH {TYPED_SQL}, hashed AS (
  SELECT session_id, turn, sha256(session_id || ':' || content) AS h FROM kept)
SELECT session_id, turn AS line_no, {KEY_SQL} AS turn_uuid FROM hashed""",
)
def turn_key(spark, sf_dir):
    kept = prompts.typed_prompts(events(spark, sf_dir))
    return kept.select(
        "session_id",
        "line_no",
        keys.turn_key(F.col("session_id"), F.col("content")).alias("turn_uuid"),
    )


@query(
    "valid_uuid",
    f"""WITH hashed AS (
  SELECT conv_id, turn, sha256(conv_id || ':' || text) AS h FROM conversations),
named AS (
  SELECT conv_id, turn, {KEY_SQL} AS u FROM hashed
  UNION ALL SELECT conv_id, turn, upper({KEY_SQL}) FROM hashed
  UNION ALL SELECT conv_id, turn, h FROM hashed)
SELECT conv_id, turn, u AS name,
  CASE WHEN length(u) = 36 AND length(replace(u, '-', '')) = 32 THEN u ELSE 'none' END AS session_uuid
FROM named""",
)
def valid_uuid(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    seed = turns.withColumn("u", keys.turn_key(F.col("conv_id").cast("string"), F.col("text")))
    digest = F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), "text"), 256)
    named = seed.select(
        "conv_id", "turn", F.explode(F.array("u", F.upper("u"), digest)).alias("name")
    )
    return named.withColumn("session_uuid", F.coalesce(keys.valid_uuid(F.col("name")), F.lit("none")))


@query(
    "preview",
    """
SELECT doc_id, substr(regexp_replace(text, '\\n+', ' ', 'g'), 1, 80) AS preview FROM documents
""",
)
def preview(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", text.preview(F.col("text")).alias("preview"))


@query(
    "first_occurrence",
    f"""WITH {TYPED_SQL}, twice AS (
  SELECT session_id, content, turn AS line_no FROM kept
  UNION ALL SELECT session_id, content, turn + 1000 FROM kept)
SELECT session_id, content, min(line_no) AS line_no FROM twice GROUP BY ALL""",
)
def first_occurrence(spark, sf_dir):
    kept = prompts.typed_prompts(doubled(events(spark, sf_dir)))
    first = prompts.first_occurrence(kept, ["session_id", "content"], ["line_no"])
    return first.select("session_id", "content", "line_no")


@query(
    "only_new",
    f"""WITH {TYPED_SQL}, hashed AS (
  SELECT DISTINCT session_id, conv_id, sha256(session_id || ':' || content) AS h FROM kept)
SELECT session_id, {KEY_SQL} AS turn_uuid FROM hashed WHERE conv_id % 3 <> 0""",
)
def only_new(spark, sf_dir):
    """Prompts of all sessions against a store that has every third session."""
    loaded = prompt_load.prompt_records(events(spark, sf_dir))
    in_store = F.element_at(F.split("session_id", "-"), 2).cast("int") % 3 == 0
    fresh = prompts.only_new(loaded, loaded.filter(in_store), "turn_uuid")
    return fresh.select("session_id", "turn_uuid")


@query(
    "load_counts",
    f"""WITH {TYPED_SQL}, u AS (
  SELECT DISTINCT session_id, content, conv_id FROM kept)
SELECT 2 * count(*) AS total,
  count(*) FILTER (conv_id % 3 <> 0) AS "new",
  2 * count(*) - count(*) FILTER (conv_id % 3 <> 0) AS existing,
  0 AS failed FROM u""",
)
def load_counts(spark, sf_dir):
    loaded = prompt_load.prompt_records(events(spark, sf_dir))
    in_store = F.element_at(F.split("session_id", "-"), 2).cast("int") % 3 == 0
    return prompts.load_counts(loaded.union(loaded), loaded.filter(in_store), "turn_uuid")


@query(
    "append_new",
    f"""WITH {TYPED_SQL}, hashed AS (
  SELECT DISTINCT session_id, content, sha256(session_id || ':' || content) AS h FROM kept)
SELECT {KEY_SQL} AS turn_uuid, content AS prompt_text, count(*) AS copies
FROM hashed GROUP BY ALL""",
)
def append_new(spark, sf_dir):
    """The store after the same load ran twice."""
    path = scratch_path(spark, "prompts")
    loaded = prompt_load.prompt_records(events(spark, sf_dir))
    for _ in range(2):
        sinks.append_new(loaded, path, "turn_uuid")
    return (
        spark.read.schema(loaded.schema)
        .parquet(path)
        .groupBy("turn_uuid", "prompt_text")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


@query(
    "prompts_per_session",
    f"""WITH {TYPED_SQL}, u AS (SELECT DISTINCT session_id, content FROM kept)
SELECT session_id, count(*) AS prompts, sum(length(content)) AS characters FROM u GROUP BY ALL""",
)
def prompts_per_session(spark, sf_dir):
    """The flagship: events to keyed prompts, counted per session."""
    return prompt_load.session_summary(prompt_load.prompt_records(doubled(events(spark, sf_dir))))
