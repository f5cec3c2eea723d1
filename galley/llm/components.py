"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.common import stored


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Ties the neighbours of a node to the smallest of them and the node.

    The smallest neighbour of each node is an aggregate that is combined before
    the shuffle, and is joined back, so a node with many links is not a group in
    one task.
    """
    if larger:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if larger:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return out.unionByName(own).where("a <> b").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of the links; component is its smallest reachable node.

    Nulls and links of a node to itself are no links. Any orderable type serves as a node.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    pairs = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        pairs = stored(_star(_star(pairs, True), False), "links")
        # Stars are the fixed point: every node has one link, and no node on the right has one itself.
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("b").alias("node")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
