"""Recall of past work, ranking and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions import stats, text
from galley.schema import require


def head_and_rest(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows per group, each with how many more there are.

    The row limit is pushed below the shuffle, and the counts are a partial
    aggregate, so a group of any size stays spread out.
    """
    require(df, *by)
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    return (
        ranked.filter(F.col("rank") <= n)
        .join(counts, list(by))
        .withColumn("more", F.greatest(F.lit(0).cast("long"), F.col("_all") - n))
        .drop("_all")
    )


def byte_order_sort(df: DataFrame, column: str) -> DataFrame:
    """Sorted by the bytes of the text, whatever the locale."""
    return require(df, column).orderBy(F.col(column).cast("binary"))


def similar_top_k(vectors: DataFrame, query: Column, key: str, vector: str, k: int = 8) -> DataFrame:
    """(key, similarity): the k nearest by exact cosine.

    Each task keeps its own best k; only those travel.
    """
    require(vectors, key, vector)
    scored = vectors.select(key, vector, query.alias("_query")).select(
        key, stats.cosine(F.col(vector), F.col("_query")).alias("similarity")
    )
    # Ranked on the raw value; only what is shown is rounded.
    best = scored.filter(F.col("similarity").isNotNull()).orderBy(F.desc("similarity"), key).limit(k)
    return best.withColumn("similarity", F.round("similarity", 6))


def keyword_hits(docs: DataFrame, key: str, body: str, variants: Sequence[str]) -> DataFrame:
    """(key, variant) for each query variant a text holds."""
    require(docs, key, body)
    low = F.lower(F.col(body))
    found = F.array_compact(F.array(*[F.when(low.contains(v.lower()), v) for v in variants]))
    return docs.select(key, F.explode(found).alias("variant"))


def recall_union(keyword: DataFrame, vector: DataFrame, key: str) -> DataFrame:
    """(key, sources, hits): both kinds of hits with their origin kept.

    A row is a hit when any variant or the vector side found it.
    """
    require(keyword, key)
    require(vector, key)
    both = keyword.select(key, F.lit("keyword").alias("source")).unionByName(
        vector.select(key, F.lit("vector").alias("source"))
    )
    return both.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.count(F.lit(1)).alias("hits"),
    )


def distinct_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def doc_tokens(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, token) with each token of a text once, made distinct inside the row."""
    require(docs, key, body)
    return docs.select(key, F.explode(F.array_distinct(text.tokens(F.col(body)))).alias("token"))


def dictionary_match(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Tokens with the kind the dictionary gives them.

    No hint: Spark broadcasts the dictionary while it is under its threshold
    and otherwise shuffles, splitting a token that is too frequent.
    """
    require(tokens, "token")
    require(dictionary, "token", "kind")
    return tokens.join(dictionary.select("token", "kind"), "token")


def inside_dictionary(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    return tokens.join(dictionary.select("token"), "token", "left_semi")


def outside_dictionary(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    return tokens.join(dictionary.select("token"), "token", "left_anti")


def map_objects(texts: DataFrame, objects: DataFrame, key: str, body: str) -> DataFrame:
    """(key, matched, object_id, route): one object is mapped, none or several go to review."""
    require(texts, key, body)
    require(objects, "token", "object_id")
    hits = doc_tokens(texts, key, body).join(objects.select("token", "object_id"), "token")
    per_object = hits.select(key, "object_id").distinct()
    counted = per_object.groupBy(key).agg(
        F.count(F.lit(1)).alias("matched"), F.min("object_id").alias("_one")
    )
    joined = texts.select(key).join(counted, key, "left")
    matched = F.coalesce("matched", F.lit(0))
    mapped = matched == 1
    return joined.select(
        key,
        matched.cast("long").alias("matched"),
        F.when(mapped, F.col("_one")).otherwise(F.lit("none")).alias("object_id"),
        F.when(mapped, "mapped").otherwise("review").alias("route"),
    )
