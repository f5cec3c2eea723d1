"""Recall, dictionaries, routing, ranking and preference queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import text
from galley.operators import nearest as nearest_vectors
from galley.operators import prefs, recall, routing, rules
from galley.session import scratch_path
from galley.sources import sinks
from workload import sqltext as Q
from workload.registry import query, table, texts


def benchmark_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return recall.doc_tokens(items, "item_id", "text")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words of the benchmark items name the item they come from."""
    return (
        benchmark_tokens(spark, sf_dir)
        .filter(F.length("token") >= 9)
        .select("token", F.concat(F.lit("item-"), "item_id").alias("object_id"))
    )


MAPPED_SQL = f"""
objects AS (
  SELECT DISTINCT token, 'item-' || item_id AS object_id
  FROM (SELECT item_id, unnest({Q.tokens('text')}) AS token FROM benchmark) WHERE length(token) >= 9),
words AS (SELECT doc_id, unnest(list_distinct({Q.tokens('text')})) AS token FROM documents),
hits AS (SELECT DISTINCT doc_id, object_id FROM words JOIN objects USING (token)),
routed AS (
  SELECT d.doc_id, count(object_id) AS matched,
    CASE WHEN count(object_id) = 1 THEN min(object_id) ELSE 'none' END AS object_id,
    CASE WHEN count(object_id) = 1 THEN 'mapped' ELSE 'review' END AS route
  FROM documents d LEFT JOIN hits USING (doc_id) GROUP BY 1)"""


@query("map_objects", f"WITH {MAPPED_SQL} SELECT * FROM routed")
def map_objects(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return recall.map_objects(docs, objects(spark, sf_dir), "doc_id", "text")


@query(
    "fan_out",
    f"""WITH {MAPPED_SQL}
SELECT 'record' AS store, count(*) AS n FROM documents
UNION ALL SELECT 'search', count(*) FROM words
UNION ALL SELECT 'relation', count(*) FROM hits""",
)
def fan_out(spark, sf_dir):
    """Documents to a record, a search and a relation store, each read back."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    names = objects(spark, sf_dir)
    record, search, relation = (scratch_path(spark, n) for n in ("record", "search", "relation"))

    def relations(df: DataFrame) -> DataFrame:
        found = recall.doc_tokens(df, "doc_id", "text").join(names, "token")
        return found.select("doc_id", "object_id").distinct()

    sinks.fan_out(docs, record, {search: lambda df: recall.doc_tokens(df, "doc_id", "text"), relation: relations})
    counts = None
    for name, path in (("record", record), ("search", search), ("relation", relation)):
        part = spark.read.schema("doc_id long").parquet(path).agg(
            F.lit(name).alias("store"), F.count(F.lit(1)).alias("n")
        )
        counts = part if counts is None else counts.unionByName(part)
    return counts


DICTIONARY_SQL = f"""
dict AS (
  SELECT DISTINCT token, CASE WHEN length(token) < 5 THEN 'noise' ELSE 'place' END AS kind
  FROM (SELECT unnest({Q.tokens('text')}) AS token FROM benchmark)),
words AS (SELECT doc_id, unnest(list_distinct({Q.tokens('text')})) AS token FROM documents)"""


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = benchmark_tokens(spark, sf_dir).select("token").distinct()
    return words.withColumn("kind", F.when(F.length("token") < 5, "noise").otherwise("place"))


@query(
    "dictionary_match",
    f"WITH {DICTIONARY_SQL} SELECT doc_id, kind, count(*) AS words FROM words JOIN dict USING (token) GROUP BY ALL",
)
def dictionary_match(spark, sf_dir):
    words = recall.doc_tokens(texts(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    hits = recall.dictionary_match(words, dictionary(spark, sf_dir))
    return hits.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("words"))


@query(
    "dictionary_sides",
    f"""WITH {DICTIONARY_SQL}
SELECT doc_id, count(*) FILTER (token IN (SELECT token FROM dict)) AS inside,
  count(*) FILTER (token NOT IN (SELECT token FROM dict)) AS outside FROM words GROUP BY 1""",
)
def dictionary_sides(spark, sf_dir):
    """The semi and the anti form together: every word is on one side."""
    words = recall.doc_tokens(texts(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    known = dictionary(spark, sf_dir)
    both = recall.inside_dictionary(words, known).withColumn("side", F.lit("in")).unionByName(
        recall.outside_dictionary(words, known).withColumn("side", F.lit("out"))
    )
    return both.groupBy("doc_id").agg(
        F.count_if(F.col("side") == "in").alias("inside"), F.count_if(F.col("side") == "out").alias("outside")
    )


@query(
    "head_and_rest",
    """WITH r AS (
  SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank,
    count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, event_id, value, rank, n - 5 AS more FROM r WHERE rank <= 5""",
)
def head_and_rest(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_type", "event_id", "value")
    return recall.head_and_rest(events, ["event_type"], [F.desc("value"), "event_id"], 5)


@query("byte_order_sort", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey")
def byte_order_sort(spark, sf_dir):
    return recall.byte_order_sort(table(spark, sf_dir, "part", "p_partkey", "p_name"), "p_name")


NEAREST_SQL = """
nearest AS (
  SELECT vec_id, round(raw, 6) AS similarity FROM (
    SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]),
      CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) AS raw
    FROM embeddings ORDER BY raw DESC, vec_id LIMIT 8))"""


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    wanted = vectors.filter(F.col("vec_id") == 0).select("embedding").scalar()
    return recall.similar_top_k(vectors, wanted, "vec_id", "embedding", 8)


@query("similar_top_k", f"WITH {NEAREST_SQL} SELECT * FROM nearest")
def similar_top_k(spark, sf_dir):
    return nearest(spark, sf_dir)


@query(
    "nearest_join",
    """WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 12) AS similarity
  FROM u q, u v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, round(similarity, 6) AS similarity FROM r WHERE rank <= 8""",
)
def nearest_join(spark, sf_dir):
    """Every row whose id is divisible by 20 asks for its eight nearest among all rows."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    asked = vectors.filter(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id")
    found = nearest_vectors.nearest_join(asked, vectors, "query_id", "vec_id", "embedding", 8)
    return found.rows.withColumn("similarity", F.round("similarity", 6))


@query(
    "recall_union",
    f"""WITH {NEAREST_SQL}, k AS (
  SELECT doc_id, v FROM documents, (VALUES ('the th'), ('der e')) t(v) WHERE contains(lower(text), v)),
b AS (SELECT doc_id, 'keyword' AS source FROM k UNION ALL SELECT vec_id, 'vector' FROM nearest)
SELECT doc_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS hits FROM b GROUP BY 1""",
)
def recall_union(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    by_word = recall.keyword_hits(docs, "doc_id", "text", ["the th", "der e"])
    by_vector = nearest(spark, sf_dir).withColumnRenamed("vec_id", "doc_id")
    return recall.recall_union(by_word, by_vector, "doc_id")


@query(
    "with_category",
    """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'judgment' WHEN regexp_matches(text, '\\d{3}') THEN 'object'
  WHEN regexp_matches(text, 'tion') THEN 'judgment' ELSE 'knowledge' END AS category FROM documents""",
)
def with_category(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id", "text").withColumn(
        "category", F.when(F.col("doc_id") % 10 == 0, "judgment")
    )
    return routing.with_category(docs, {"object": r"\d{3}", "judgment": "tion"}).select("doc_id", "category")


@query(
    "tenant_guard",
    """WITH c AS (
  SELECT c_custkey, c_nationkey, n.n_name AS own, n.n_regionkey, CASE c_custkey % 4 WHEN 1 THEN n.n_name WHEN 2 THEN o.n_name END AS claimed
  FROM customer JOIN nation n ON n.n_nationkey = c_nationkey JOIN nation o ON o.n_nationkey = (c_nationkey + 1) % 25)
SELECT c_custkey, CASE WHEN n_regionkey = 4 THEN 'unknown_token'
  WHEN claimed IS NULL OR claimed = own THEN 'accepted' ELSE 'tenant_mismatch' END AS outcome FROM c""",
)
def tenant_guard(spark, sf_dir):
    """Nations are tenants; one region has no tokens, a quarter claims another tenant."""
    nations = table(spark, sf_dir, "nation")
    other = nations.select(((F.col("n_nationkey") + 24) % 25).alias("c_nationkey"), F.col("n_name").alias("_other"))
    own = nations.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("_own"))
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").join(own, "c_nationkey").join(other, "c_nationkey")
    rows = customers.withColumn(
        "tenant_claimed",
        F.when(F.col("c_custkey") % 4 == 1, F.col("_own")).when(F.col("c_custkey") % 4 == 2, F.col("_other")),
    )
    claims = nations.filter(F.col("n_regionkey") != 4).select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("tenant")
    )
    accepted, rejected = rules.tenant_guard(rows, claims, "c_nationkey")
    return accepted.select("c_custkey", F.lit("accepted").alias("outcome")).unionByName(
        rejected.select("c_custkey", F.col("reason").alias("outcome"))
    )


@query(
    "catalog_bucket",
    """WITH n AS (
  SELECT p_partkey, replace(p_name, ' ', '-') AS last, CASE WHEN p_size % 3 = 0 THEN p_type
    WHEN p_size % 3 = 1 THEN 'other-pack' END AS space FROM part)
SELECT p_partkey, CASE WHEN (space IS NULL OR space IN ('ECONOMY', 'SMALL')) AND starts_with(last, 'red-') THEN 'red'
  WHEN (space IS NULL OR space IN ('ECONOMY', 'SMALL')) AND starts_with(last, 'blue-') THEN 'blue'
  WHEN space = 'SMALL' THEN 'small' WHEN space = 'ECONOMY' THEN 'economy'
  WHEN space IS NOT NULL THEN 'foreign' WHEN last IN ('small-ring', 'hot-gear') THEN 'builtin'
  ELSE 'other' END AS bucket FROM n""",
)
def catalog_bucket(spark, sf_dir):
    last = F.replace("p_name", F.lit(" "), F.lit("-"))
    space = F.when(F.col("p_size") % 3 == 0, F.concat("p_type", F.lit(":"))).when(
        F.col("p_size") % 3 == 1, "other-pack:"
    )
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.coalesce(space, F.lit("")), last).alias("name"))
    found = rules.catalog_bucket(
        names, "name", {"blue-": "blue", "red-": "red"}, {"ECONOMY": "economy", "SMALL": "small"},
        builtin=("small-ring", "hot-gear"),
    )
    return found.select("p_partkey", "bucket")


PAIRS_SQL = """
scored AS (
  SELECT doc_id, quality, toxic, n_chars, length(lang || source) AS tag FROM labels JOIN documents USING (doc_id)),
pairs AS (
  SELECT l.doc_id AS l_id, r.doc_id AS r_id, CASE WHEN l.quality >= r.quality THEN l.doc_id ELSE r.doc_id END AS winner
  FROM scored l JOIN scored r ON r.doc_id = l.doc_id + 1),
feats AS (
  SELECT doc_id, 'chars' AS axis, CAST(n_chars AS DOUBLE) AS v FROM scored
  UNION ALL SELECT doc_id, 'toxic', toxic FROM scored
  UNION ALL SELECT doc_id, 'tag', tag FROM scored),
counts AS (
  SELECT f.axis, count(*) FILTER ((f.v > g.v) = (winner = l_id) AND f.v <> g.v) AS wins, count(*) FILTER (f.v <> g.v) AS n
  FROM pairs JOIN feats f ON f.doc_id = l_id JOIN feats g ON g.doc_id = r_id AND f.axis = g.axis GROUP BY 1)"""


@query(
    "preference_test",
    f"""WITH {PAIRS_SQL}, p AS (
  SELECT axis, wins, n, least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)))
    FROM (SELECT unnest(range(0, least(wins, n - wins) + 1)) AS k))) AS p FROM counts)
SELECT axis, wins, n, round(wins / n, 6) AS rate, round(p + 1e-9, 6) AS p,
  CASE WHEN p < 0.05 THEN 'preference' ELSE 'no_preference' END AS verdict FROM p""",
)
def preference_test(spark, sf_dir):
    """Labelled neighbours are pairs; the better label wins."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "n_chars", "lang", "source")
    scored = table(spark, sf_dir, "labels").join(docs, "doc_id")
    left = scored.select(F.col("doc_id").alias("left_id"), F.col("quality").alias("_l"))
    right = scored.select(
        F.col("doc_id").alias("right_id"), (F.col("doc_id") - 1).alias("left_id"), F.col("quality").alias("_r")
    )
    pairs = left.join(right, "left_id").select(
        F.col("left_id").alias("pair_id"), "left_id", "right_id",
        F.when(F.col("_l") >= F.col("_r"), F.col("left_id")).otherwise(F.col("right_id")).alias("winner"),
    )
    axes = F.array(
        F.struct(F.lit("chars").alias("axis"), F.col("n_chars").cast("double").alias("value")),
        F.struct(F.lit("toxic").alias("axis"), F.col("toxic").cast("double").alias("value")),
        F.struct(F.lit("tag").alias("axis"), F.length(F.concat("lang", "source")).cast("double").alias("value")),
    )
    features = scored.select(F.col("doc_id").alias("id"), F.explode(axes).alias("_a")).select("id", "_a.*")
    return (
        prefs.preference_test(pairs, features)
        .withColumn("rate", F.round("rate", 6))
        # p is a binary fraction: the small step keeps it off the rounding edge
        .withColumn("p", F.round(F.col("p") + 1e-9, 6))
    )
