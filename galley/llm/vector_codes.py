"""Vector code compression: product codes of integer vectors, entries found through a GNAT.

Components become floor(1024 x); a vector is cut into four parts, and each part position has a
codebook of up to 256 entries, first the parts of the smallest ids. A round assigns all parts to
their nearest entries and moves each entry to the floor of its parts' mean. Tasks add up integer sums
per entry, Spark adds those of the tasks, and only the codebooks, whose size the parameters bound,
pass the driver. The nearest entry is found in a tree over the entries of a part (`gnat`), built once per task.

Edge cases: rows whose vector is null or holds a null, NaN or infinite component are dropped. Every other row
counts, also with a null or repeated id or a null label. For the first codebook null ids come last, and rows of one id
follow their components. With fewer than 256 rows the codebooks are shorter. The vector of the smallest id whose length is a
positive multiple of four sets the length; a vector of another length, or with a component too large for a
squared sum in 64 bits (about 2^20 / sqrt(length) times 2^10 before scaling), keeps its row with null code and error. label_error is null where a label has no
coded vector. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import prepare, stored
from galley.llm.gnat import Gnat

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4


def largest(length: int) -> int:
    """The largest absolute component for which the squared distance of two vectors fits 64 bits."""
    return math.isqrt((2**63 - 1) // max(length, 1)) // 2


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept rows with their components as int64 bytes; empty where a component is too large."""
    for batch in batches:
        keep, out = [], []
        for i, values in enumerate(batch.column("embedding").to_pylist()):
            if values is None or None in values:
                continue
            vector = np.array(values, dtype=np.float64)
            if not np.isfinite(vector).all():
                continue
            with np.errstate(over="ignore"):
                scaled = np.floor(vector * SCALE)
            fits = not len(scaled) or np.abs(scaled).max() <= largest(len(scaled))
            keep.append(i)
            out.append(scaled.astype(np.int64).tobytes() if fits else b"")
        if keep:
            at = pa.array(keep, pa.int64())
            columns = [batch.column(c).take(at) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], names=["vec_id", "label", "parts"])


def _matrix(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a batch with the common length, and their vectors."""
    rows = column.to_pylist()
    fit = np.array([len(v) == 8 * length for v in rows], dtype=bool)
    data = b"".join(v for v in rows if len(v) == 8 * length)
    return np.flatnonzero(fit), np.frombuffer(data, np.int64).reshape(-1, PARTS, length // PARTS)


def _moved(books: np.ndarray):
    """Sums and counts per entry and position over the rows of a task."""
    length = books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book) for book in books]
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)

        def flush() -> pa.RecordBatch:
            part, entry = np.nonzero(count)
            width = books.shape[2]
            slot = np.repeat(part * ENTRIES + entry, width)
            values = [slot, np.tile(np.arange(width), len(part)), total[part, entry].ravel(), np.repeat(count[part, entry], width)]
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], names=["slot", "position", "total", "count"])

        rows = 0
        for batch in batches:
            _, vectors = _matrix(batch.column("parts"), length)
            for p, tree in enumerate(trees):
                code, _ = tree.nearest(vectors[:, p])
                np.add.at(total[p], code, vectors[:, p])
                np.add.at(count[p], code, 1)
            rows += len(vectors)
            # The sums stay in 64 bits: a component is below 2^31, so 2^31 rows would be safe.
            if rows >= 1 << 30:
                yield flush()
                total[:], count[:], rows = 0, 0, 0
        if rows:
            yield flush()

    return run


def _coded(books: np.ndarray):
    length = books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book) for book in books]
        for batch in batches:
            at, vectors = _matrix(batch.column("parts"), length)
            codes, errors = np.zeros((len(at), PARTS), np.uint8), np.zeros(len(at), np.int64)
            for p, tree in enumerate(trees):
                code, error = tree.nearest(vectors[:, p])
                codes[:, p] = code
                errors += error
            text: list[str | None] = [None] * batch.num_rows
            error: list[int | None] = [None] * batch.num_rows
            for i, c, e in zip(at, codes, errors.tolist()):
                text[i], error[i] = c.tobytes().hex(), e
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def first_books(packed: DataFrame) -> np.ndarray | None:
    """(part, entry, position) of the first codebooks; None without a vector of a usable length."""
    usable = packed.where(f"octet_length(parts) > 0 and octet_length(parts) % {8 * PARTS} = 0")
    order = [F.asc_nulls_last("vec_id"), _key()]
    head = usable.orderBy(*order).limit(1).select(F.octet_length("parts").alias("n")).first()
    if head is None:
        return None
    rows = usable.where(F.octet_length("parts") == head["n"]).orderBy(*order).limit(ENTRIES).select("parts").collect()
    vectors = np.stack([np.frombuffer(bytes(r["parts"]), np.int64) for r in rows])
    return vectors.reshape(len(rows), PARTS, -1).transpose(1, 0, 2).copy()


def _key():
    """Orders rows of one id by their stored components; any fixed order serves, as only equal ids are ordered by it."""
    return F.col("parts")


def trained(packed: DataFrame, rounds: int = ROUNDS) -> np.ndarray | None:
    books = first_books(packed)
    for _ in range(rounds if books is not None else 0):
        moved = packed.mapInArrow(_moved(books), "slot long, position long, total long, count long")
        # At most one row per component of the codebooks.
        sums = moved.groupBy("slot", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("t"), F.sum("count").alias("n"))
        for r in sums.collect():
            books[r["slot"] // ENTRIES, r["slot"] % ENTRIES, r["position"]] = int(r["t"]) // r["n"]
    return books


def digest(books: np.ndarray | None) -> str:
    numbers = [] if books is None else books.ravel().tolist()
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def compressed(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector."""
    prepare(vectors.sparkSession)
    rows = vectors.select("vec_id", "label", "embedding")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:2])
    packed = stored(rows.mapInArrow(_quantised, f"{kinds}, parts binary"), "parts")
    books = trained(packed)
    if books is None:
        coded = packed.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    else:
        coded = stored(packed.mapInArrow(_coded(books), f"{kinds}, code string, error long"), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    both = coded.alias("v").join(sums.alias("s"), F.col("v.label").eqNullSafe(F.col("s.label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """Five assignments and four moves, each a step of the same form."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, part, entry, d FROM (
    SELECT v.rid, v.part, c.entry, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts v JOIN c{r} c ON c.part = v.part
  ) QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, entry) = 1
)""")
        if r < ROUNDS:
            steps.append(f"""
m{r} AS (
  SELECT part, entry, list(y ORDER BY i) AS x FROM (
    SELECT part, entry, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS y FROM (
      SELECT a.part, a.entry, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x FROM a{r} a JOIN parts v USING (rid, part)
    ) GROUP BY ALL
  ) GROUP BY ALL
), c{r + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (part, entry)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT rid, part, x[part * w + 1 : part * w + w] AS x FROM (SELECT *, len(x) // 4 AS w, unnest(range(4)) AS part FROM kept)
), c0 AS MATERIALIZED (
  SELECT part, rid - 1 AS entry, x FROM parts WHERE rid <= 256
),{",".join(steps)},
coded AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid
), books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (rid), books
"""


OP13_SQL = _sql()
