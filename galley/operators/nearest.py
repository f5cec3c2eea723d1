"""The k nearest vectors of many queries at once, exact, with bounds that spare whole blocks.

Vectors of unit length are tied to the nearest of a few pivots and cut, by their distance to it,
into rings of bounded size. A query first looks into the ring it would lie in itself; the k-th
distance found there is a bound. By the triangle inequality a ring whose distances to its pivot
differ from the query's by more than the bound holds nothing nearer and is never read for that query.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galley.operators import ordered
from galley.schema import require
from galley.session import scratch_path

PIVOTS, RING, QUERIES = 64, 2048, 512
DIGITS = 12  # similarities are compared to so many digits
SLACK = 3e-6  # more than a similarity of 12 digits can be off as a distance


class NearestJoin(NamedTuple):
    """`rows`: (query key, rank, vector key, similarity); `work`: one row (pairs, compared, pruned)."""

    rows: DataFrame
    work: DataFrame


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "nearest")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _units(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """(name, unit): vectors of length one as double bytes; those without a direction are left out."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for i, values in enumerate(batch.column(vector).to_pylist()):
                if values and None not in values:
                    v = np.array(values, dtype=np.float64)
                    size = np.linalg.norm(v)
                    if np.isfinite(size) and size > 0:
                        keep.append(i)
                        out.append((v / size).tobytes())
            if keep:
                same = batch.column(key).take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([same, pa.array(out, pa.binary())], names=[name, "unit"])

    return df.filter(F.col(key).isNotNull()).select(key, vector).mapInArrow(run, f"`{name}` {kind}, unit binary")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in column.to_pylist()])


def _tied(units: DataFrame, name: str, pivots: np.ndarray, nearest_only: bool) -> DataFrame:
    """Adds pivot and dist: the nearest pivot of each vector, or all pivots with an own row each."""
    kind = units.schema[name].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = np.sqrt(np.maximum(2 - 2 * (_matrix(batch.column("unit")) @ pivots.T), 0))
            if nearest_only:
                at = away.argmin(1)
                dist = away[np.arange(len(at)), at]
                rows = np.arange(len(at))
            else:
                rows, at, dist = np.repeat(np.arange(len(away)), len(pivots)), np.tile(np.arange(len(pivots)), len(away)), away.ravel()
            columns = [batch.column(c).take(pa.array(rows)) for c in (name, "unit")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at.astype(np.int32)), pa.array(dist)], names=[name, "unit", "pivot", "dist"])

    return units.mapInArrow(run, f"`{name}` {kind}, unit binary, pivot int, dist double")


def _best(k: int):
    """Compares the queries of a block with the vectors of a ring; the k best of each query go on, with all ties of the last."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        names = ("_q", "_v", "similarity")
        if not queries.num_rows or not vectors.num_rows:
            types = (queries.schema.field("_q").type, vectors.schema.field("_v").type, pa.float64())
            return pa.table({n: pa.array([], t) for n, t in zip(names, types)})
        same = np.round(_matrix(queries.column("unit")) @ _matrix(vectors.column("unit")).T, DIGITS)
        if same.shape[1] > k:
            last = np.partition(same, same.shape[1] - k, axis=1)[:, same.shape[1] - k]
        else:
            last = np.full(len(same), -np.inf)
        row, at = np.nonzero(same >= last[:, None])
        columns = [queries.column("_q").take(pa.array(row)), vectors.column("_v").take(pa.array(at)), pa.array(same[row, at])]
        return pa.table(dict(zip(names, columns)))

    return run


def _compared(asked: DataFrame, rings: DataFrame, k: int) -> DataFrame:
    """(_q, _v, similarity) of the queries with the rings they ask for; each group is a block of queries and one ring."""
    q_kind, v_kind = asked.schema["_q"].dataType.simpleString(), rings.schema["_v"].dataType.simpleString()
    needed = asked.select("pivot", "ring", "block").distinct()
    lent = rings.join(needed, ["pivot", "ring"]).select(
        F.col("pivot").alias("_p"), F.col("ring").alias("_r"), F.col("block").alias("_b"), "_v", "unit"
    )
    return (
        asked.select("pivot", "ring", "block", "_q", "unit")
        .groupBy("pivot", "ring", "block")
        .cogroup(lent.groupBy("_p", "_r", "_b"))
        .applyInArrow(_best(k), f"_q {q_kind}, _v {v_kind}, similarity double")
    )


def nearest_join(
    queries: DataFrame, vectors: DataFrame, q_key: str, v_key: str, vector: str, k: int = 8,
    pivots: int = PIVOTS, ring: int = RING, block: int = QUERIES,
) -> NearestJoin:
    """The k vectors of the largest cosine for each query; ties to the smaller key.

    Similarities count to 12 digits. Vectors and queries that are NULL, empty or
    zero, or hold a NULL or non-finite component, and those without a key, take no part; keys are
    unique on each side and all vectors have one length. A query that is also a vector finds itself. Only the
    pivots, a bounded number, pass the driver.
    """
    require(queries, q_key, vector)
    require(vectors, v_key, vector)
    spark = vectors.sparkSession
    units = _written(_units(vectors, v_key, vector, "_v"))
    asked = _units(queries, q_key, vector, "_q")
    chosen = units.orderBy(F.xxhash64("_v"), "_v").limit(pivots).select("unit").collect()
    q_kind, v_kind = asked.schema["_q"].dataType.simpleString(), units.schema["_v"].dataType.simpleString()
    if not chosen:
        rows = spark.createDataFrame([], f"`{q_key}` {q_kind}, rank int, `{v_key}` {v_kind}, similarity double")
        return NearestJoin(rows, spark.createDataFrame([(0, 0, 0)], "pairs long, compared long, pruned long"))
    centres = np.stack([np.frombuffer(bytes(r["unit"]), np.float64) for r in chosen])
    placed = ordered.range_numbered(_tied(units, "_v", centres, True), ["pivot"], ["dist", "_v"], "_n")
    rings = _written(placed.withColumn("ring", F.floor((F.col("_n") - 1) / ring).cast("int")).drop("_n"))
    bounds = rings.groupBy("pivot", "ring").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count(F.lit(1)).alias("size"))
    bounds = _written(bounds)

    blocks = F.greatest(F.lit(1), F.ceil(F.lit(asked.count()) / block)).cast("int")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("_q"), blocks).cast("int"))
    away = _tied(asked.select("_q", "unit"), "_q", centres, False).withColumn("block", F.pmod(F.xxhash64("_q"), blocks).cast("int"))
    away = _written(away)
    # How far a query is from every ring at least; the nearest ring of the nearest pivot comes first.
    short = away.select("_q", "block", "pivot", "dist").join(bounds, "pivot")
    short = _written(short.withColumn("least", F.greatest(F.lit(0.0), F.col("dist") - F.col("high"), F.col("low") - F.col("dist"))).drop("low", "high"))
    first = short.groupBy("_q").agg(F.min(F.struct("dist", "least", "pivot", "ring")).alias("_f")).select("_q", "_f.pivot", "_f.ring")
    home = asked.join(first, "_q")
    begun = _written(_compared(home, rings, k))

    worst = Window.partitionBy("_q").orderBy(F.desc("similarity"), "_v")
    kth = begun.withColumn("_n", F.row_number().over(worst)).filter(F.col("_n") == k)
    kth = kth.select("_q", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))).alias("bound"))
    open_rings = short.join(kth, "_q", "left").filter(F.col("bound").isNull() | (F.col("least") <= F.col("bound") + SLACK))
    open_rings = open_rings.join(first, ["_q", "pivot", "ring"], "left_anti")
    open_rings = _written(open_rings.select("_q", "pivot", "ring", "size"))
    further = _compared(asked.join(open_rings, "_q"), rings, k)

    best = Window.partitionBy("_q").orderBy(F.desc("similarity"), "_v")
    rows = begun.unionByName(further).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    rows = rows.select(F.col("_q").alias(q_key), "rank", F.col("_v").alias(v_key), "similarity")
    looked = open_rings.select("size").unionByName(first.join(bounds, ["pivot", "ring"]).select("size"))
    work = short.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("pairs")).select(
        "pairs", F.lit(looked.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar()).alias("compared")
    )
    return NearestJoin(rows, work.withColumn("pruned", F.col("pairs") - F.col("compared")))
