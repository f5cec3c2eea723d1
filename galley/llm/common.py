"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.session import apply_defaults, scratch_path, shared_dir


def prepare(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> SparkSession:
    """Session settings of the Arrow operators: batches bounded in rows and bytes."""
    apply_defaults(spark)
    shared_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back; later steps do not compute them again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null for null."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def block_pairs(df: DataFrame, key: str, size: str, member: str, block: int) -> DataFrame:
    """Rows of a group dealt to the pairs (_i, _j) of its blocks of about `block` members.

    A small group has the one pair (0, 0). Each pair of members meets in one
    block pair: in (b, b), or in (i, j) as _block i against _block j.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    df = df.withColumn("_blocks", blocks).withColumn("_block", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    df = df.withColumn("_other", other)
    return (
        df.withColumn("_i", F.least("_block", "_other"))
        .withColumn("_j", F.greatest("_block", "_other"))
        .drop("_other", "_blocks")
    )


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        changed = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            column = batch.column(k)
            if pa.types.is_integer(column.type):
                values = column.to_numpy(zero_copy_only=False)
                changed[1:] |= values[1:] != values[:-1]
            else:
                changed[1:] |= np.array(pa.compute.not_equal(column[1:], column[:-1]))
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        cuts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def append(df: DataFrame, fn, fields: list[tuple[str, str]], prefix: str = "") -> DataFrame:
    """Adds columns that a function of an Arrow batch gives as lists or arrays.

    An input column with the name of an added one is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    added = [StructField(prefix + name, _parse_datatype_string(kind)) for name, kind in fields]
    taken = {f.name.lower() for f in added}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    schema = StructType([StructField(f.name, f.dataType) for f in kept] + added)
    kinds = [f.type for f in to_arrow_schema(StructType(added))]
    keep = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in taken]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [pa.array(v, k, from_pandas=False) for v, k in zip(fn(batch), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + new, names=schema.names)

    return df.mapInArrow(run, schema)
