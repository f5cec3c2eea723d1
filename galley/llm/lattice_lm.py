"""LM scoring: the likelihood of a text over all segmentations of its words into subwords.

A ready vocabulary gives each subword a weight; its BPE scores are ranks, so a piece of rank r has a
probability in proportion to 1 / (RANK_SHIFT + r), bytes come last. A word is generated as
pieces until a stop, and its probability sums over all segmentations by a
forward recursion in log space. The lattice has one more arc, the word as a whole,
whose weight is learned from the training documents: with count c of N tokens and V
distinct ones, P(w) = (c + V L(w)) / (N + V), where L is the lattice probability
(for the end of a text a constant). A text's score is the sum of the log10 P of its tokens.

Counting and scoring run on distinct words: a task reduces its texts to word numbers, the
words meet their counts and lattice values in one join, and go back to the part of the texts
that asked for them. What is gathered grows with the corpus and is never held in one place.

Nulls and edge cases: a null or empty text is the end alone. A null id is neither learned
from nor held out. Words of any length are read whole. Without training texts the
base has N = V = 0 and P is the lattice value alone. Repeated rows are scored and learned from each.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import prepare, scratch_path
from galley.llm.words import slices

VOCABULARY = "piece_bpe_32k.model"
RANK_SHIFT = 10.0
STOP = 1 / 3  # that a word ends after a piece
END_MASS = 0.001  # the constant for the end of a text
ALPHA = 0.1  # of the base
END = "\n"  # no word holds it
SLICE = 1 << 18  # bytes of text that are cut into words at once

Weights = tuple[dict[str, float], list[float], int]


def read_weights(path: str) -> Weights:
    """Log probabilities of the pieces and of the 256 bytes, and the longest piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces: dict[str, float] = {}
    for i in range(size):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = -math.log(RANK_SHIFT - model.get_score(i))
    each = -math.log(RANK_SHIFT + size)
    total = math.log(sum(math.exp(w) for w in pieces.values()) + 256 * math.exp(each))
    return {p: w - total for p, w in pieces.items()}, [each - total] * 256, max(map(len, pieces), default=1)


def lattice(word: str, weights: Weights) -> float:
    """Natural log of the probability that pieces spell the word, over all segmentations."""
    pieces, byte, longest = weights
    text = "▁" + word
    n = len(text)
    go, stop = math.log(1 - STOP), math.log(STOP)
    get = pieces.get
    alpha = [-math.inf] * (n + 1)
    alpha[0] = 0.0
    for j in range(1, n + 1):
        terms = []
        for i in range(max(0, j - longest), j):
            weight = get(text[i:j])
            if weight is not None:
                terms.append(alpha[i] + weight + go)
        # A character may also be spelled by its bytes.
        terms.append(alpha[j - 1] + sum(byte[b] + go for b in text[j - 1].encode()))
        top = max(terms)
        alpha[j] = top + math.log(sum([math.exp(t - top) for t in terms]))
    return alpha[n] - go + stop


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as a part: its distinct words with their training counts, and its texts as word numbers.

    A text row has place -1 and carries its word numbers and counts; a word row carries the word.
    """
    task, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        trains = np.array(batch.column("trains").to_pylist(), dtype=bool)
        keys, rows = [], []
        every = np.zeros(0, np.uint64)
        for words in slices(batch.column("text"), SLICE):
            distinct, first, back = np.unique(words.key, return_index=True, return_inverse=True)
            pair, count = np.unique(words.row.astype(np.int64) * len(distinct) + back, return_counts=True)
            # Only a word that is new to the batch is made a text.
            place = np.searchsorted(every, distinct)
            fresh = every[np.minimum(place, len(every) - 1)] != distinct if len(every) else np.ones(len(distinct), bool)
            every = np.insert(every, place[fresh], distinct[fresh])
            keys.append((distinct[fresh], [words.text(i) for i in first[fresh]]))
            width = max(len(distinct), 1)
            rows.append((pair // width + words.first, distinct, (pair % width).astype(np.int32), count.astype(np.int32)))
        names: list[str] = [""] * len(every)
        for distinct, text in keys:
            for i, t in zip(np.searchsorted(every, distinct).tolist(), text):
                names[i] = t
        # The end of each text is a word of its own.
        row = np.concatenate([*(r.astype(np.int32) for r, _, _, _ in rows), np.arange(n, dtype=np.int32)])
        number = np.concatenate([*(np.searchsorted(every, d).astype(np.int32)[at] for _, d, at, _ in rows), np.full(n, len(every), np.int32)])
        count = np.concatenate([*(c for _, _, _, c in rows), np.ones(n, np.int32)])
        del keys, rows, every
        names.append(END)
        learned = np.bincount(number, count * trains[row], minlength=len(names)).astype(np.int64)
        # Frequent words get small numbers, which pack better.
        rank = np.empty(len(names), dtype=np.int32)
        order = np.argsort(-np.bincount(number, minlength=len(names)), kind="stable")
        rank[order] = np.arange(len(names))
        number = rank[number]
        sort = np.lexsort((number, row))
        number, count, bounds = number[sort], count[sort], np.searchsorted(row[sort], np.arange(n + 1))
        packed = [
            zlib.compress(np.stack([number[a:b], count[a:b]]).astype(np.uint32).tobytes(), 1) for a, b in zip(bounds[:-1], bounds[1:])
        ]
        part = pa.array([(task << 32) + k] * n, pa.int64())
        empty = lambda kind, m: pa.nulls(m, kind)
        schema = ["part", "place", "doc_id", "held_out", "packed", "word", "learned"]
        yield pa.RecordBatch.from_arrays(
            [part, pa.array([-1] * n, pa.int32()), batch.column("doc_id"), batch.column("held_out"), pa.array(packed, pa.binary()), empty(pa.string(), n), empty(pa.int64(), n)],
            names=schema,
        )
        m = len(names)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([(task << 32) + k] * m, pa.int64()),
                pa.array(range(m), pa.int32()),
                empty(batch.column("doc_id").type, m),
                empty(pa.bool_(), m),
                empty(pa.binary(), m),
                pa.array([names[i] for i in order], pa.string()),
                pa.array(learned[order]),
            ],
            names=schema,
        )
        k += 1
        pa.default_memory_pool().release_unused()


def _lattices(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = [
                math.log(END_MASS) if w == END else math.log1p(-END_MASS) + lattice(w, weights)
                for w in batch.column("word").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.float64())], names=[*batch.schema.names, "lattice"])

    return run


def _score(n: int, v: int):
    """Scores the texts of one part with the values of its words; n tokens and v distinct ones were learned."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        place = words.column("place").to_numpy()
        count = np.zeros(len(place) and place.max() + 1)
        value = np.zeros(len(count))
        whole = np.zeros(len(count))
        count[place] = words.column("count").to_numpy()
        value[place] = words.column("lattice").to_numpy()
        base = np.log10(count + ALPHA)
        shift = math.log10(n + ALPHA * (v + 1))
        whole = value / math.log(10)
        if v:
            # log10 of c + V L, without leaving log space for rare words
            seen = count > 0
            both = math.log(v) + value
            both[seen] = np.logaddexp(np.log(count[seen]), both[seen])
            whole = (both - math.log(n + v)) / math.log(10)
        out: list[list] = [[], [], [], [], []]
        for packed in texts.column("packed").to_pylist():
            number, times = np.frombuffer(zlib.decompress(packed), np.uint32).reshape(2, -1).astype(np.int64)
            out[0].append(int(times.sum()))
            out[1].append(int(times[count[number] > 0].sum()))
            out[2].append(float((base[number] * times).sum() - shift * times.sum()))
            out[3].append(float((whole[number] * times).sum()))
            out[4].append(float((value[number] * times).sum() / math.log(10)))
        rows = texts.num_rows
        return pa.table(
            [texts.column("doc_id"), texts.column("held_out"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array([n] * rows, pa.int64()), *[pa.array(o, pa.float64()) for o in out[2:]]],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"],
        )

    return run


def _written(df: DataFrame, name: str) -> DataFrame:
    """Like `stored`, in row groups a fraction of the usual size, so that a writing task holds little."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def score_texts(docs: DataFrame, trains: str, held_out: str, weights: Weights) -> DataFrame:
    """Scores of all texts of (doc_id, text), learned from the rows where the expression `trains` holds."""
    spark = docs.sparkSession
    prepare(spark, 1800, 6 << 20)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select(
        "doc_id", "text", F.coalesce(F.expr(trains), F.lit(False)).alias("trains"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out")
    )
    rows = _written(
        docs.mapInArrow(
            _parts, f"part long, place int, doc_id {id_type}, held_out boolean, packed binary, word string, learned long"
        ),
        "parts",
    )
    words = rows.where("place >= 0").select("part", "place", "word", "learned")
    counted = words.groupBy("word").agg(F.sum("learned").alias("count"))
    valued = _written(counted.mapInArrow(_lattices(weights), "word string, count long, lattice double"), "words")
    totals = valued.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.col("count") > 0)).first()
    asked = words.drop("learned").join(valued, "word").drop("word")
    out = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"
    texts = rows.where("place < 0").select(F.col("part").alias("home"), "doc_id", "held_out", "packed")
    return texts.groupBy("home").cogroup(asked.groupBy("part")).applyInArrow(_score(*totals), out)


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    remainder = "pmod(crc32(cast(cast(doc_id as string) as binary)), 10)"
    return score_texts(docs, f"{remainder} <> 0", f"{remainder} = 0", read_weights(public_tokenizers.path(VOCABULARY)))
