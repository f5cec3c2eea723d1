"""Order-dependent steps that do not put a whole group into one task.

A plain window over a group sends the group to one task, which fails when a
single source holds a third of all rows. Here a group is cut into blocks along
its order. Each block is worked on alone, one summary row per block carries
the state from block to block, and the two are joined on (group, block).

`block` is a Column that never decreases along the order within a group, for
example floor(line_no / 65536). Group and block values must not be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.session import scratch_path

_BLK = "_block"
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low bits


def line_block(order: str, rows: int = 65_536) -> Column:
    """Block number of a dense integer order column."""
    return F.floor(F.col(order) / rows)


def _attach(df: DataFrame, summary: DataFrame, group: Sequence[str]) -> DataFrame:
    return df.join(summary, [*group, _BLK], "left")


def carry_forward(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, out: str, block: Column
) -> DataFrame:
    """The last non-NULL value at or before each row."""
    blocked = df.withColumn("_v", value).withColumn(_BLK, block)
    inside = Window.partitionBy(*group, _BLK).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = blocked.withColumn("_local", F.last("_v", ignorenulls=True).over(inside))
    before = Window.partitionBy(*group).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        blocked.groupBy(*group, _BLK)
        .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_tail"))
        .select(*group, _BLK, F.last("_tail", ignorenulls=True).over(before).alias("_carried"))
    )
    return (
        _attach(local, summary, group)
        .withColumn(out, F.coalesce("_local", "_carried"))
        .drop("_v", "_local", "_carried", _BLK)
    )


def running_total(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, out: str, block: Column
) -> DataFrame:
    """Sum of value from the first row of the group to this one."""
    blocked = df.withColumn("_v", value).withColumn(_BLK, block)
    inside = Window.partitionBy(*group, _BLK).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = blocked.withColumn("_local", F.sum("_v").over(inside))
    before = Window.partitionBy(*group).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        blocked.groupBy(*group, _BLK)
        .agg(F.sum("_v").alias("_tail"))
        .select(*group, _BLK, F.coalesce(F.sum("_tail").over(before), F.lit(0)).alias("_carried"))
    )
    return (
        _attach(local, summary, group)
        .withColumn(out, F.coalesce("_local", F.lit(0)) + F.col("_carried"))
        .drop("_v", "_local", "_carried", _BLK)
    )


def numbered(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], out: str, block: Sequence[Column]
) -> DataFrame:
    """Row number from 1 within each group.

    `block` may hold several Columns; together they must not decrease along
    the order. The order itself must be unique for a stable result.
    """
    names = [f"_b{i}" for i in range(len(block))]
    blocked = df
    for name, col in zip(names, block):
        blocked = blocked.withColumn(name, col)
    inside = Window.partitionBy(*group, *names).orderBy(*order)
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        blocked.groupBy(*group, *names)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*group, *names, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_carried"))
    )
    return (
        blocked.withColumn("_local", F.row_number().over(inside))
        .join(summary, [*group, *names], "left")
        .withColumn(out, F.col("_local") + F.col("_carried"))
        .drop("_local", "_carried", *names)
    )


def in_ranges(df: DataFrame, group: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows range-partitioned and sorted along (group, order), with `_part` and `_at`, written once and read back.

    Spark samples the cut points, so a partition holds about equally many rows
    whatever the groups are, and rows of equal rank are dealt by the later order
    columns. Partitions follow each other along the order; `_at` counts the rows of one.
    """
    spark = df.sparkSession
    keys = [*group, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftrightunsigned("_at", _ROW_BITS))
    path = scratch_path(spark, "ranges")
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def range_numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], out: str) -> DataFrame:
    """Row number from 1 within each group along an order that is unique in the group.

    Each range partition numbers its own rows; a prefix sum over (group, partition)
    counts carries on. A group of any size, also one of equal ranks, spreads over
    as many tasks as its rows fill. Without a group the whole table is numbered.
    """
    placed = in_ranges(df, group, order)
    keys = [*group, "_part"]
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        placed.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
        .select(*keys, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    )
    same = F.col("r._part") == F.col("s._part")
    for name in group:
        same = same & F.col(f"r.{name}").eqNullSafe(F.col(f"s.{name}"))
    numbers = placed.alias("r").join(summary.alias("s"), same).select("r.*", (F.col("_at") + F.col("_shift")).alias(out))
    return numbers.drop("_at", "_part")


def next_value(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, out: str, block: Column
) -> DataFrame:
    """The value of the following row; NULL on the last row of the group."""
    blocked = df.withColumn("_v", F.struct(value.alias("v"))).withColumn(_BLK, block)
    inside = Window.partitionBy(*group, _BLK).orderBy(*order)
    local = blocked.withColumn("_local", F.lead("_v").over(inside))
    after = Window.partitionBy(*group).orderBy(_BLK)
    summary = (
        blocked.groupBy(*group, _BLK)
        .agg(F.min_by("_v", F.struct(*order)).alias("_head"))
        .select(*group, _BLK, F.lead("_head").over(after).alias("_carried"))
    )
    return (
        _attach(local, summary, group)
        .withColumn(out, F.coalesce("_local", "_carried")["v"])
        .drop("_v", "_local", "_carried", _BLK)
    )


def exact_quantile(df: DataFrame, group: Sequence[str], value: str, q: float, out: str) -> DataFrame:
    """Exact interpolated quantile per group, one row per group.

    Equal values are counted first. The counted values are written in range
    partitions, whose cut points Spark samples from the values themselves; each
    partition of a group tells its total, and only the one or two partitions that
    hold the wanted ranks are put in order. Dense, wide and very large groups
    are alike. NULL values are ignored; a group that has only NULLs gets no row.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = in_ranges(counts, group, [value]).drop("_at")
    keys = [*group, "_part"]
    whole = Window.partitionBy(*group)
    upto = F.sum("_sum").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = placed.groupBy(*keys).agg(F.sum("_n").alias("_sum")).withColumns({
        "_upto": upto, "_at": (F.sum("_sum").over(whole) - 1) * F.lit(q),
    })
    lower, upper = F.floor("_at"), F.ceil("_at")
    before = F.col("_upto") - F.col("_sum")
    holds = lambda rank: (before <= rank) & (rank < F.col("_upto"))
    wanted = parts.filter(holds(lower) | holds(upper)).select(*keys, before.alias("_before"), "_at")
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.join(wanted, keys).withColumn("_rank", F.col("_before") + F.sum("_n").over(inside))
    as_double = F.col(value).cast("double")
    return (
        ranked.groupBy(*group)
        .agg(
            F.min(F.when(F.col("_rank") > lower, as_double)).alias("_lo"),
            F.min(F.when(F.col("_rank") > upper, as_double)).alias("_hi"),
            F.first(F.col("_at") - lower).alias("_share"),
        )
        .select(*group, (F.col("_lo") + F.col("_share") * (F.col("_hi") - F.col("_lo"))).alias(out))
    )
