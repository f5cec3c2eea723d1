"""N-gram Jaccard join: MinHash values compared step by step with Bayesian pruning, then exact counts.

1. Every text gives its digest and a MinHash signature (one byte per function)
   over its distinct five-word shingles. Texts of one digest are one unit.
2. Units that share a band of the signature meet. Their signatures are compared
   a step at a time; a pair is dropped as soon as the posterior probability of
   reaching the threshold falls below the tolerance. The survivors only tie
   units into candidate groups, by star links.
3. Inside each candidate group every pair is verified with exact shingle sets,
   as a product of incidence matrices; only counts and star links leave a task.

Buckets and groups beyond a block size are dealt to block pairs, so no group has
to fit a task, and no table of pairs is written. 38 bands of 5 values miss a pair at
0.8 with probability 3e-7, and the tolerance of the posterior is 1e-7.

Nulls and edge cases: a null text counts as empty. Equal texts, empty ones too,
are copies and always linked. A text of fewer than five words has one shingle;
a text without words has none and links with its copies alone. Repeated rows are
copies; a null doc_id stays a row of its own and never names a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import block_pairs, groups, prepare, stored
from galley.llm.components import components
from galley.llm.words import mix, shingles, slices

THRESHOLD, WIDTH = 0.8, 5
BANDS, ROWS = 38, 5
TOLERANCE, STEP = 1e-7, 19
BUCKET_BLOCK, GROUP_BLOCK = 1024, 512
PRIOR_GRID = 2001


def posterior(matches: int, compared: int, threshold: float = THRESHOLD) -> float:
    """P(similarity >= threshold) after so many equal bytes, from a uniform prior.

    Two bytes agree when the values do, or by chance once in 256.
    """
    s = np.linspace(0, 1, PRIOR_GRID)
    p = np.clip(s + (1 - s) / 256, 1e-12, 1 - 1e-12)
    log = matches * np.log(p) + (compared - matches) * np.log1p(-p)
    weight = np.exp(log - log.max())
    return float(weight[s >= threshold - 1e-12].sum() / weight.sum())


def least_matches(threshold: float, tolerance: float, functions: int, step: int) -> list[tuple[int, int]]:
    """For each step: values compared so far, and the fewest equal ones with which a pair stays."""
    out = []
    for n in range(step, functions + 1, step):
        low = next(m for m in range(n + 1) if posterior(m, n, threshold) >= tolerance)
        out.append((n, low))
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = BANDS * ROWS
    rng = np.random.default_rng(20)
    factor = rng.integers(1, 1 << 62, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offset = rng.integers(1, 1 << 62, count, dtype=np.uint64)
    for batch in batches:
        parts = []
        for words in slices(batch.column("text")):
            gram, bounds = shingles(words, WIDTH)
            full = np.flatnonzero(np.diff(bounds))
            out = np.zeros((words.rows, count), dtype=np.uint8)
            if len(full):
                first = bounds[:-1][full]
                for k in range(count):
                    least = np.minimum.reduceat((gram ^ offset[k]) * factor[k] >> np.uint64(20), first)
                    out[full, k] = mix(least) & np.uint64(255)
            flags = np.zeros(words.rows, dtype=bool)
            flags[full] = True
            parts += [row.tobytes() if ok else None for row, ok in zip(out, flags)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), pa.array(parts, pa.binary())],
            names=["doc_id", "digest", "sig"],
        )


class _Survivors:
    def __init__(self, threshold: float, tolerance: float):
        self.steps = least_matches(threshold, tolerance, BANDS * ROWS, STEP)

    def near(self, sig: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
        matches, at = np.zeros(len(others), dtype=np.int32), 0
        for n, low in self.steps:
            matches += (sig[others, at:n] == sig[one, at:n]).sum(1, dtype=np.int32)
            keep = matches >= low
            others, matches, at = others[keep], matches[keep], n
            if not len(others):
                break
        return others

    def links(self, sig: np.ndarray, side: np.ndarray | None) -> Iterator[tuple[int, int]]:
        """Star links of the surviving pairs; pairs that are tied already are not compared."""
        n = len(sig)
        label = np.arange(n)
        for one in range(n):
            away = label != label[one]
            if side is not None:
                away &= side != side[one]
            away[:one] = False
            others = np.flatnonzero(away)
            if not len(others):
                if side is None and (label == label[0]).all():
                    return
                continue
            hit = self.near(sig, one, others)
            fresh, at = np.unique(label[hit], return_index=True)
            for old, i in zip(fresh, hit[at]):
                yield one, int(i)
                label[label == old] = label[one]


def _candidate_links(threshold: float, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        survivors = _Survivors(threshold, tolerance)
        a: list[bytes] = []
        b: list[bytes] = []
        for table in groups(batches, ["key", "_i", "_j"]):
            if table.num_rows < 2:
                continue
            digest = table.column("digest").to_pylist()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(digest), -1)
            split = table.column("_i")[0].as_py() != table.column("_j")[0].as_py()
            side = table.column("_block").to_numpy() if split else None
            for x, y in survivors.links(sig, side):
                a.append(digest[x])
                b.append(digest[y])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for words in slices(batch.column("text")):
            gram, bounds = shingles(words, WIDTH)
            parts += [gram[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "grams", pa.array(parts, pa.binary()))


def overlap(rows: list[np.ndarray], columns: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Shared shingles of every row set with every column set."""
    if len(rows) == len(columns) == 1:
        return np.array([[len(np.intersect1d(rows[0], columns[0], assume_unique=True))]])
    out = np.zeros((len(rows), len(columns)), dtype=np.float32)
    values, at = np.unique(np.concatenate(rows + columns), return_inverse=True)
    lengths = np.array([len(x) for x in rows + columns])
    owner = np.repeat(np.arange(len(lengths)), lengths)
    split = len(rows)
    left = np.bincount(at[owner < split], minlength=len(values)) > 0
    right = np.bincount(at[owner >= split], minlength=len(values)) > 0
    shared = np.cumsum(left & right) - 1
    keep = (left & right)[at]
    at, owner = shared[at[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    top = int(at[-1]) + 1 if len(at) else 0
    for low in range(0, top, width):
        x, y = np.searchsorted(at, [low, low + width])
        one = np.zeros((len(lengths), min(width, top - low)), dtype=np.float32)
        one[owner[x:y], at[x:y] - low] = 1
        out += one[:split] @ one[split:].T
    return out.astype(np.int64)


def _exact_links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["component", "_i", "_j"]):
            digest = np.array(table.column("digest").to_pylist(), dtype=object)
            grams = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
            weight = table.column("copies").to_numpy()
            side = table.column("_block").to_numpy()
            i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
            left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
            if not len(left) or not len(right) or (i == j and len(left) < 2):
                continue
            size = np.array([len(x) for x in grams])
            common = overlap([grams[k] for k in left], [grams[k] for k in right])
            union = size[left][:, None] + size[right][None, :] - common
            near = (common >= threshold * union - 1e-9) & (common > 0)
            if i == j:
                np.fill_diagonal(near, False)
            total = np.zeros(len(digest), dtype=np.int64)
            total[left] += near @ weight[right]
            if i != j:
                total[right] += near.T @ weight[left]
            root = np.arange(len(digest))
            while True:  # the smallest row number reachable inside this block pair
                low = root.copy()
                low[left] = np.minimum(low[left], np.where(near, root[right][None, :], len(root)).min(1))
                low[right] = np.minimum(low[right], np.where(near, low[left][:, None], len(root)).min(0))
                if (low == root).all():
                    break
                root = low
            linked = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(digest[linked], pa.binary()),
                    pa.array(digest[root[linked]], pa.binary()),
                    pa.array(total[linked], pa.int64()),
                ],
                names=["a", "b", "links"],
            )

    return run


def ngram_jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row per input row: doc_id, digest, class_id, rep_digest, n_links, kept.

    class_id is the smallest id that links reach, rep_digest the text that stays
    for the class; kept marks the rows of the smallest id with that text.
    """
    prepare(docs.sparkSession)
    docs = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("digest", F.unhex(F.md5("text")))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(docs.mapInArrow(_signatures, f"doc_id {id_type}, digest binary, sig binary"), "signatures")
    units = stored(
        rows.groupBy("digest").agg(
            F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("sig").alias("sig")
        ),
        "units",
    )
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    banded = (
        units.where("sig is not null")
        .select("digest", "sig", band)
        .select("digest", F.xxhash64("band", F.expr(f"substring(sig, band * {ROWS} + 1, {ROWS})")).alias("key"))
    )
    full = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = block_pairs(banded.join(full, "key").join(units.select("digest", "sig"), "digest"), "key", "size", "digest", BUCKET_BLOCK)
    dealt = ["key", "_i", "_j"]
    tied = (
        met.select(*dealt, "_block", "digest", "sig")
        .repartition(*dealt)
        .sortWithinPartitions(*dealt)
        .mapInArrow(_candidate_links(threshold, tolerance), "a binary, b binary")
    )
    members = components(tied, "a", "b").withColumnRenamed("node", "digest")
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    members = members.join(sizes, "component").join(units.select("digest", "first_id", "copies"), "digest")
    texts = (
        docs.join(
            members.withColumnRenamed("digest", "d"),
            (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("first_id")),
        )
        .dropDuplicates(["digest", "doc_id"])
        .select("digest", "component", "size", "copies", "text")
    )
    dealt = ["component", "_i", "_j"]
    grams = texts.mapInArrow(_grams, "digest binary, component binary, size long, copies long, grams binary")
    exact = stored(
        block_pairs(grams, "component", "size", "digest", GROUP_BLOCK)
        .select(*dealt, "_block", "digest", "copies", "grams")
        .repartition(*dealt)
        .sortWithinPartitions(*dealt)
        .mapInArrow(_exact_links(threshold), "a binary, b binary, links long"),
        "exact",
    )
    classes = components(exact, "a", "b").withColumnRenamed("node", "digest")
    links = exact.groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
    named = (
        units.select("digest", "first_id", "copies")
        .join(classes, "digest", "left")
        .join(links, "digest", "left")
        .withColumn("component", F.coalesce("component", "digest"))
    )
    heads = named.groupBy("component").agg(
        F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "digest")).alias("head")
    )
    named = named.join(heads, "component").select(
        "digest",
        F.col("head.first_id").alias("class_id"),
        F.col("head.digest").alias("rep_digest"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    return rows.select("doc_id", "digest").join(named, "digest").select(
        "doc_id",
        "digest",
        "class_id",
        "rep_digest",
        "n_links",
        (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("rep_digest"))).alias("kept"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each class the row of the smallest id stays, with all its columns.

    Rows that repeat both the id and the text leave one row.
    """
    found = ngram_jaccard_join(docs, id_col, text_col)
    kept = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_kept")).distinct()
    keyed = docs.withColumn("_digest", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return (
        keyed.join(kept, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_kept")), "left_semi")
        .dropDuplicates([id_col, "_digest"])
        .select(*docs.columns)
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ngram_jaccard_join(docs).select("doc_id", "class_id", "n_links", "kept")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    md5(coalesce(text, '')) AS digest
  FROM documents
), g AS (
  SELECT doc_id, digest, CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS grams
  FROM w
), u AS (
  SELECT digest, min(doc_id) AS first_id, count(*) AS copies, any_value(grams) AS grams FROM g GROUP BY digest
), e AS (SELECT first_id, len(grams) AS n, unnest(grams) AS gram FROM u),
pairs AS (
  SELECT a.first_id AS a, b.first_id AS b FROM e a JOIN e b ON a.gram = b.gram AND a.first_id <> b.first_id
  GROUP BY a.first_id, b.first_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9
), reach AS (
  SELECT first_id AS a, first_id AS b FROM u UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b
), cls AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
lk AS (SELECT p.a, sum(u.copies) AS links FROM pairs p JOIN u ON u.first_id = p.b GROUP BY p.a)
SELECT g.doc_id, c.class_id, CAST(u.copies - 1 + coalesce(lk.links, 0) AS BIGINT) AS n_links, g.doc_id = c.class_id AS kept
FROM g JOIN u USING (digest) JOIN cls c ON c.a = u.first_id LEFT JOIN lk ON lk.a = u.first_id
"""
