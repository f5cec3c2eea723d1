"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, a temperature.

Random indexing: each word has a sparse random index vector, and its word vector is the sum of
the index vectors around it over all documents of the training part. Words share a table
of fixed size by their hash, as do their shapes (letter case, digits and marks at the ends). A document is
the mean and the spread of the vectors of its words and shapes. The network is
fitted on a bounded sample of labelled documents; the temperature makes its probabilities
fit a part of the sample that the fit does not see.

Nulls and edge cases: a null text counts as empty; a text without words has zero
features and still gets a score. Without labelled rows every score is 0.5. Labels other than
0 and 1, or null, are not learned from. Texts of any length are read whole; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import append, crc_mod, prepare
from galley.llm.words import Words, mix, slices

ROW_BITS, DIMENSION = 15, 48  # the table of word vectors
SHAPE_BITS = 10
NONZERO = 4  # of an index vector
WINDOW = 2
PART_ROWS = 1024  # rows of the table that are summed together
SALTS = 16
SAMPLE = 4000  # labelled documents in the fit
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 64, 0.01, 1e-4
ACCEPT = 0.7

_WORDS, _SHAPES = 1 << ROW_BITS, 1 << SHAPE_BITS
ROWS = _WORDS + _SHAPES

_CLASS = np.full(256, 5, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[128:], _CLASS[48:58] = 1, 2, 1, 3
_CLASS[[33, 35, 36, 37, 38, 42, 63, 64]] = 4


def _rows(words: Words, original: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the words and of their shapes; the shape reads the text before lowering."""
    word = (words.key & np.uint64(_WORDS - 1)).astype(np.int64)
    kind = _CLASS[original].astype(np.uint64)
    first, last = words.start, words.end - 1
    shape = kind[first]
    for k in range(3):
        shape = shape * np.uint64(7) + np.where(last - k >= first, kind[np.maximum(last - k, 0)], np.uint64(0))
    return word, (mix(shape) & np.uint64(_SHAPES - 1)).astype(np.int64) + _WORDS


def _originals(column: pa.Array) -> Iterator[tuple[Words, np.ndarray]]:
    from galley.llm.words import raw

    data, offsets = raw(column)
    for words in slices(column):
        low = int(offsets[words.first])
        yield words, data[low : low + len(words.data)]


def _index_places() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of the index vector of each table row."""
    seed = mix(np.arange(ROWS * NONZERO, dtype=np.uint64) + np.uint64(10))
    return (seed % np.uint64(DIMENSION)).astype(np.int64).reshape(ROWS, NONZERO), np.where(
        seed >> np.uint64(63), 1.0, -1.0
    ).reshape(ROWS, NONZERO)


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = _index_places()
    total = np.zeros(ROWS * DIMENSION)
    for batch in batches:
        for words, original in _originals(batch.column("text")):
            word, shape = _rows(words, original)
            for k in range(1, WINDOW + 1):
                near = np.flatnonzero(words.row[k:] == words.row[:-k])
                for own, other in ((near, near + k), (near + k, near)):
                    for target, source in ((word, word), (shape, shape)):
                        for z in range(NONZERO):
                            flat = target[own] * DIMENSION + place[source[other], z]
                            total += np.bincount(flat, sign[source[other], z], minlength=ROWS * DIMENSION)
    yield from _parts(total.reshape(ROWS, DIMENSION), TaskContext.get().partitionId())


def _parts(total: np.ndarray, task: int) -> Iterator[pa.RecordBatch]:
    parts = [total[i : i + PART_ROWS].astype(np.float64).tobytes() for i in range(0, ROWS, PART_ROWS)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(len(parts)), pa.int32()), pa.array([task % SALTS] * len(parts), pa.int32()), pa.array(parts, pa.binary())],
        names=["part", "salt", "sums"],
    )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums of the parts a task meets; there are few parts."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for part, salt, sums in zip(*(batch.column(i).to_pylist() for i in range(3))):
            new = np.frombuffer(sums, np.float64)
            held[part, salt] = held[part, salt] + new if (part, salt) in held else new
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in held], pa.int32()),
            pa.array([k[1] for k in held], pa.int32()),
            pa.array([v.tobytes() for v in held.values()], pa.binary()),
        ],
        names=["part", "salt", "sums"],
    )


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors over all texts, rows of length 1; its size does not depend on the texts."""
    schema = "part int, salt int, sums binary"
    sums = docs.select("text").mapInArrow(_context_sums, schema)
    sums = sums.repartition("part", "salt").mapInArrow(_summed, schema).withColumn("salt", F.lit(0))
    table = np.zeros((ROWS, DIMENSION))
    for row in sums.repartition("part").mapInArrow(_summed, schema).collect():
        part = np.frombuffer(row["sums"], np.float64).reshape(-1, DIMENSION)
        table[row["part"] * PART_ROWS : row["part"] * PART_ROWS + len(part)] = part
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(length, 1e-9)).astype(np.float32)


FEATURES = 4 * DIMENSION + 2


def features(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Pooled vectors of texts: mean and spread over words and over shapes, and their number."""
    out = np.zeros((len(column), FEATURES))
    for words, original in _originals(column):
        bounds = words.bounds
        count = np.diff(bounds)
        full = np.flatnonzero(count)
        if not len(full):
            continue
        at = words.first + full
        n = count[full][:, None]
        for k, rows in enumerate(_rows(words, original)):
            vectors = table[rows]
            mean = np.add.reduceat(vectors, bounds[:-1][full], axis=0, dtype=np.float64) / n
            square = np.add.reduceat(vectors * vectors, bounds[:-1][full], axis=0, dtype=np.float64) / n
            base = 2 * k * DIMENSION
            out[at, base : base + DIMENSION] = mean
            out[at, base + DIMENSION : base + 2 * DIMENSION] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[at, -2] = np.log1p(count[full])
        order = np.lexsort((words.key, words.row))
        row, key = words.row[order], words.key[order]
        fresh = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])]
        out[at, -1] = np.bincount(row[fresh], minlength=words.rows)[full] / count[full]
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 10) -> Network | None:
    """Adam on the cross entropy of four fifths of the rows; the rest sets the temperature."""
    if not len(y):
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = order[: len(y) // 5]
    seen = order[len(y) // 5 :]
    mean, scale = x[seen].mean(0), x[seen].std(0) + 1e-3
    z = (x - mean) / scale
    theta = [
        rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]),
        np.zeros(HIDDEN),
        rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN),
        np.zeros(1),
    ]
    moment = [np.zeros_like(p) for p in theta]
    spread = [np.zeros_like(p) for p in theta]
    step = 0
    for _ in range(EPOCHS):
        for low in range(0, len(seen), BATCH):
            at = seen[low : low + BATCH]
            hidden = np.tanh(z[at] @ theta[0] + theta[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ theta[2] + theta[3], -40, 40)))
            error = (p - y[at]) / len(at)
            back = np.outer(error, theta[2]) * (1 - hidden * hidden)
            grads = [z[at].T @ back + DECAY * theta[0], back.sum(0), hidden.T @ error + DECAY * theta[2], error.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(grads):
                moment[k] = 0.9 * moment[k] + 0.1 * g
                spread[k] = 0.999 * spread[k] + 0.001 * g * g
                theta[k] = theta[k] - RATE * (moment[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.999**step)) + 1e-8)
        rng.shuffle(seen)
    net = Network(mean, scale, theta[0], theta[1], theta[2], float(theta[3][0]), 1.0)
    if len(held):
        net.temperature = min(np.geomspace(0.25, 8, 61), key=lambda t: _loss(net.logits(x[held]) / t, y[held]))
    return net


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0, logits) - y * logits).mean())


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(text, quality) of at most so many labelled documents outside the held-out part."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & (crc_mod(F.col("doc_id"), 4) != 2))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("text", "quality")


def trained(docs: DataFrame, labels: DataFrame):
    """The word vectors over all training documents, and the network; None without labels."""
    spark = docs.sparkSession
    table = word_vectors(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    shared = spark.sparkContext.broadcast(table)

    def pooled(batch):
        return [features(batch.column("text"), shared.value).tolist()]

    sample = append(labelled_sample(docs, labels), pooled, [("x", "array<double>")]).select("x", "quality").collect()
    # The order of rows from a cluster is not fixed; the fit must not depend on it.
    sample.sort(key=lambda r: (r["x"], r["quality"]))
    x = np.array([r["x"] for r in sample]).reshape(len(sample), FEATURES)
    return shared, fit(x, np.array([r["quality"] for r in sample], dtype=float))


def score_quality(docs: DataFrame, shared, net: Network | None, prefix: str = "") -> DataFrame:
    """Adds score, the calibrated probability of label 1, and predicted."""

    def run(batch):
        n = batch.num_rows
        score = np.full(n, 0.5) if net is None else net.probability(features(batch.column("text"), shared.value))
        return [score, (score >= ACCEPT).astype(np.int32)]

    return append(docs, run, [("score", "double"), ("predicted", "int")], prefix)


def op10_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark, 1500).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    shared, net = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, shared, net).select(
        "doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted"
    )
