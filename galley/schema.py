"""Declared input schemas and the column check every operator starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PROMPT = T.StructType(
    [
        T.StructField("turn_uuid", T.StringType(), False),
        T.StructField("session_id", T.StringType()),
        T.StructField("session_uuid", T.StringType()),
        T.StructField("prompt_text", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("project_hint", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

RULES = T.StructType(
    [
        T.StructField("metric", T.StringType(), False),
        T.StructField("comparator", T.StringType(), False),
        T.StructField("bound", T.DoubleType(), False),
        T.StructField("tolerance", T.DoubleType(), False),
        T.StructField("info_mode", T.StringType()),
        T.StructField("mandatory", T.BooleanType(), False),
        T.StructField("kind", T.StringType(), False),
    ]
)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fail before planning when an input column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; input has {df.columns}")
    return df
