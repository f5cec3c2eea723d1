"""Binary assets judged by their bytes, not by their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.schema import require

# Size limits and leading bytes of the accepted kinds.
MIN_BYTES = 12
MAX_BYTES = 6 * 1024 * 1024
LEADING = [
    ("png", "^89504E470D0A1A0A"),
    ("jpeg", "^FFD8FF"),
    ("gif", "^474946383(7|9)61"),
    ("webp", "^52494646.{8}57454250"),
]


def asset_kind(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(LEADING):
        kind = F.when(head.rlike(pattern), name).otherwise(kind)
    return kind


def judge_assets(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, bytes, kind, sha, status, same_as) of files given as path, length and content.

    A file over the limit is reported without reading its content. Files with
    equal content share one stored copy: `same_as` is the first path of it.
    """
    require(files, "path", "length", "content")
    usable = files.filter(F.col("length") <= max_bytes).select(
        "path", F.col("length").alias("bytes"), asset_kind(F.col("content")).alias("kind"),
        F.sha2("content", 256).alias("sha"),
    )
    oversize = files.filter(F.col("length") > max_bytes).select(
        "path", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("kind"),
        F.lit(None).cast("string").alias("sha"),
    )
    first = usable.groupBy("sha").agg(F.min("path").alias("same_as"))
    status = (
        F.when(F.col("bytes") > max_bytes, "too_large")
        .when(F.col("bytes") < MIN_BYTES, "too_small")
        .when(F.col("kind").isNull(), "unknown_kind")
        .when(F.col("same_as") != F.col("path"), "reused")
        .otherwise("accepted")
    )
    return (
        usable.unionByName(oversize)
        .join(first, "sha", "left")
        .select("path", "bytes", "kind", "sha", status.alias("status"), "same_as")
    )


def scan_assets(spark: SparkSession, path: str) -> DataFrame:
    """The files below a folder, judged; files over the limit are not opened."""
    return judge_assets(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
