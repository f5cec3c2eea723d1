"""Embedding near copies: random-hyperplane sign hashing in several tables, exact cosine, connected components.

Equal vectors of a label are one unit. Each unit has a code per table, the signs of its
products with that table's planes. Units of one label that share a code meet, and their
cosine is computed in double precision. A pair counts in the first table in which its codes
agree, so nothing is counted twice and no table of pairs is written. Buckets beyond
a block size are dealt to block pairs. A pair at 0.98 is missed with probability 5e-5.

Nulls and edge cases: vectors that are null, empty, zero or hold a null or non-finite
component link with nothing, neither do those without a label or an id. Vectors of different length do not
link. Rows that repeat an id are one vector (the smallest of them). Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import block_pairs, groups, prepare, stored
from galley.llm.components import components

THRESHOLD = 0.98
TABLES, BITS = 32, 20
BLOCK = 512


def planes(dimension: int) -> np.ndarray:
    """The planes of all tables for vectors of a length, the same in every task."""
    return np.random.default_rng([9, dimension]).standard_normal((dimension, TABLES * BITS))


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int, np.ndarray] = {}
    power = 1 << np.arange(BITS, dtype=np.int64)
    for batch in batches:
        vectors = [np.frombuffer(v, np.float64) for v in batch.column("vector").to_pylist()]
        out: list[bytes] = [b""] * len(vectors)
        sizes = np.array([len(v) for v in vectors])
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            if d not in known:
                known[d] = planes(int(d))
            sign = np.stack([vectors[i] for i in at]) @ known[d] > 0
            code = (sign.reshape(len(at), TABLES, BITS) @ power).astype(np.int32)
            for i, row in zip(at, code):
                out[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "codes"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as double bytes, null where they cannot link."""
    for batch in batches:
        out = []
        for values in batch.column("embedding").to_pylist():
            vector = None
            if values and None not in values:
                vector = np.array(values, dtype=np.float64)
                if not np.isfinite(vector).all() or not np.linalg.norm(vector) > 0:
                    vector = None
            out.append(None if vector is None else vector.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "vector"]
        )


def _links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["label", "size_of", "bucket", "_i", "_j"]):
            side = table.column("_block").to_numpy()
            i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
            left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
            if not len(left) or not len(right) or (i == j and len(left) < 2):
                continue
            unit = table.column("unit").to_numpy()
            vector = np.stack([np.frombuffer(v, np.float64) for v in table.column("vector").to_pylist()])
            code = np.stack([np.frombuffer(c, np.int32) for c in table.column("codes").to_pylist()])
            weight = table.column("copies").to_numpy()
            here = table.column("bucket")[0].as_py() >> 32
            norm = np.sqrt((vector * vector).sum(1))
            near = vector[left] @ vector[right].T / (norm[left][:, None] * norm[right][None, :]) >= threshold
            if i == j:
                np.fill_diagonal(near, False)
            a, b = np.nonzero(near)
            first = (code[left[a]] == code[right[b]]).argmax(1) == here
            near[a[~first], b[~first]] = False
            total = np.zeros(len(unit), dtype=np.int64)
            total[left] += near @ weight[right]
            if i != j:
                total[right] += near.T @ weight[left]
            root = np.arange(len(unit))
            while True:  # the smallest row number reachable inside this block pair
                low = root.copy()
                low[left] = np.minimum(low[left], np.where(near, root[right][None, :], len(root)).min(1))
                low[right] = np.minimum(low[right], np.where(near, low[left][:, None], len(root)).min(0))
                if (low == root).all():
                    break
                root = low
            linked = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(unit[linked]), pa.array(unit[root[linked]]), pa.array(total[linked])], names=["a", "b", "links"]
            )

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of a table of vec_id, label and embedding."""
    prepare(vectors.sparkSession)
    vectors = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding"
    )
    one = (
        vectors.where("vec_id is not null")
        .groupBy("vec_id")
        .agg(F.min(F.struct("label", "embedding")).alias("row"))
        .select("vec_id", F.col("row.label").alias("label"), F.col("row.embedding").alias("embedding"))
    )
    packed = stored(one.mapInArrow(_pack, "vec_id long, label long, vector binary"), "vectors")
    fit = packed.where("label is not null and vector is not null").withColumn("digest", F.md5("vector"))
    units = fit.groupBy("label", "digest").agg(
        F.min("vec_id").alias("unit"), F.count("*").alias("copies"), F.first("vector").alias("vector")
    )
    units = stored(
        units.mapInArrow(_codes, "label long, digest string, unit long, copies long, vector binary, codes binary"), "codes"
    )
    # A bucket is the table in the high bits and the code in the low ones.
    number = F.expr(
        "conv(hex(reverse(substring(codes, table * 4 + 1, 4))), 16, 10)"
    )
    banded = units.select("unit", "label", F.octet_length("vector").alias("size_of"), "codes", F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1))).alias("table"))
    banded = banded.select("unit", "label", "size_of", (F.col("table").cast("long") * (1 << 32) + number.cast("long")).alias("bucket"))
    keys = ["label", "size_of", "bucket"]
    full = banded.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1")
    met = block_pairs(banded.join(full, keys), "bucket", "size", "unit", BLOCK)
    met = met.join(units.select("unit", "copies", "vector", "codes"), "unit")
    dealt = [*keys, "_i", "_j"]
    links = stored(
        met.select(*dealt, "_block", "unit", "copies", "vector", "codes")
        .repartition(*dealt)
        .sortWithinPartitions(*dealt)
        .mapInArrow(_links(threshold), "a long, b long, links long"),
        "vector-links",
    )
    classes = components(links, "a", "b").withColumnRenamed("node", "unit")
    direct = links.groupBy(F.col("a").alias("unit")).agg(F.sum("links").alias("links"))
    named = (
        units.select("label", "digest", "unit", "copies")
        .join(classes, "unit", "left")
        .join(direct, "unit", "left")
        .select(
            "label",
            "digest",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "unit").alias("component_id"),
        )
    )
    every = packed.withColumn("digest", F.when(F.col("label").isNotNull(), F.md5("vector")))
    out = every.join(named, ["label", "digest"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    unnamed = vectors.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(unnamed).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN p ON p.a = r.b
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
