"""Writes that can be repeated safely."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galley.functions import keys
from galley.operators import prompts
from galley.schema import require


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored table, or an empty one before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def insert_new(df: DataFrame, path: str, key: str) -> None:
    """Add the rows whose key is not stored yet, one row per key, in one pass."""
    require(df, key)
    stored = read_or_empty(df.sparkSession, path, df.schema)
    fresh = prompts.only_new(df.filter(F.col(key).isNotNull()), stored, key)
    one_per_key = prompts.first_occurrence(fresh, [key], [c for c in df.columns if c != key])
    one_per_key.select(*df.columns).write.mode("append").parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """As `insert_new`, and returns the load counts. Running it again adds nothing.

    The counts are taken on the key column alone before the write, so they are
    exact even when tasks of the write are retried.
    """
    require(df, key)
    spark = df.sparkSession
    stored = read_or_empty(spark, path, df.schema)
    counts = prompts.load_counts(df, stored, key).collect()  # one row
    insert_new(df, path, key)
    return spark.createDataFrame(counts)


def changed_records(df: DataFrame, stored: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """Each key with its action and the payload that holds after the update.

    Only a changed payload counts as an update; a key that is no longer sent is kept.
    Of a key that is sent several times the row with the smallest payload counts.
    """
    require(df, key, *payload)
    require(stored, key, *payload)
    one_per_key = prompts.first_occurrence(df.select(key, *payload), [key], list(payload))
    new = one_per_key.select(key, F.struct(*payload).alias("_new"), keys.payload_hash(*[F.col(c) for c in payload]).alias("_nh"))
    old = stored.select(key, F.struct(*payload).alias("_old"), keys.payload_hash(*[F.col(c) for c in payload]).alias("_oh"))
    action = (
        F.when(F.col("_oh").isNull(), "insert")
        .when(F.col("_nh").isNull(), "kept")
        .when(F.col("_nh") == F.col("_oh"), "unchanged")
        .otherwise("update")
    )
    merged = F.when(action.isin("kept", "unchanged"), F.col("_old")).otherwise(F.col("_new"))
    return (
        new.join(old, key, "full_outer")
        .select(key, action.alias("action"), merged.alias("_m"))
        .select(key, "action", "_m.*")
    )


def upsert_changed(df: DataFrame, path: str, key: str, partition: str) -> None:
    """Rewrite only the partitions that hold an inserted or changed record.

    `partition` must follow from the key, so that a record never moves.
    """
    spark = df.sparkSession
    payload = [c for c in df.columns if c not in (key, partition)]
    stored = read_or_empty(spark, path, df.schema)
    merged = changed_records(df, stored, key, [*payload, partition])
    touched = merged.filter(F.col("action").isin("insert", "update")).select(partition).distinct()
    (
        merged.join(touched, partition, "left_semi")
        .select(*df.columns)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def fan_out(
    df: DataFrame, record_path: str, branches: dict[str, Callable[[DataFrame], DataFrame]]
) -> None:
    """Write the records once, then each derived store from the stored records.

    The later stores read what was written, so the input is computed once and a
    lost executor costs no recomputation of it.
    """
    df.write.mode("overwrite").parquet(record_path)
    stored = df.sparkSession.read.schema(df.schema).parquet(record_path)
    for path, derive in branches.items():
        derive(stored).write.mode("overwrite").parquet(path)


def append_snapshot(df: DataFrame, path: str, date_column: str = "survey_date") -> None:
    """Keep every survey; a repeated survey replaces only its own date."""
    require(df, date_column)
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(date_column)
        .parquet(path)
    )
