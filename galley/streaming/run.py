"""Starting streams whose result can be read again after any restart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from galley.sources import sinks

ACCOUNT = T.StructType().add("arrived", "long").add("late", "long").add("newest", "timestamp")


def for_each_batch(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Process what is available and stop; run again to go on."""
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def to_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write each micro-batch to a folder named by its number.

    A batch that is delivered again replaces its own folder, so the store has
    every row once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return for_each_batch(stream, write, checkpoint, mode)


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(with_batch).parquet(path)


@dataclass
class Accounted:
    """Rows of a batch under observation; `write` stores what one pass over them has seen."""

    rows: DataFrame
    observation: Observation
    path: str

    def write(self) -> None:
        seen = self.observation.get
        row = [(seen["arrived"], seen["late"], seen["newest"])]
        self.rows.sparkSession.createDataFrame(row, ACCOUNT).coalesce(1).write.mode("overwrite").parquet(self.path)


def accounted(batch: DataFrame, store: str, number: int, late: Column, ts: str) -> Accounted:
    """Observe how many rows of a batch arrived and how many are late, while they are written elsewhere."""
    observation = Observation()
    rows = batch.observe(
        observation, F.count(F.lit(1)).alias("arrived"), F.count_if(late).alias("late"), F.max(ts).cast("timestamp").alias("newest")
    )
    return Accounted(rows, observation, f"{store}/accounts/batch={number}")


def read_accounts(spark: SparkSession, store: str) -> DataFrame:
    """(arrived, late, newest, batch), one row per batch."""
    return sinks.read_or_empty(spark, f"{store}/accounts", T.StructType([*ACCOUNT.fields, T.StructField("batch", T.LongType())]))
