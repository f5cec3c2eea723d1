"""Scans of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows spread by key when the scan has fewer splits than there are cores.

    For heavy work inside the row on a table of few files. A table with at least
    as many splits as there are cores is returned as it is; one with fewer, also
    a large one on a larger cluster, is shuffled once with its texts. The rows are
    placed by key: later joins and groups on the key need no exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)
