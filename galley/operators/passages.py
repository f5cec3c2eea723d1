"""Passages that two collections of texts share, found through an index of fingerprints.

Comparing every text with every other would be a product. Instead each text gives a few fingerprints:
of every window of neighbouring k-grams the one with the smallest hash is chosen (winnowing), so a run
that is as long as the window and its grams has the same chosen gram in both texts, and one equal
fingerprint is enough to find it. Each text is fingerprinted once: those of the right are stored, those of
the left that the right has too are stored as they come. Equal ones meet in a join; frequent ones are dealt to
block pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import text
from galley.schema import require
from galley.session import scratch_path

BLOCK = 256  # members of one side of a frequent fingerprint that meet in one key
SEGMENT = 1 << 18  # grams of a text that are hashed at once
ROWS = 1 << 16  # fingerprints that leave a task together, or those of one text
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(n + 1, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _least(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest grams of all windows, ascending; the place settles equal upper bits, so the leftmost wins."""
    low = np.uint64((1 << len(grams).bit_length()) - 1)
    rank = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width < window:
        step = min(width, window - width)
        rank = np.minimum(rank[:-step], rank[step:])
        width += step
    place = (rank & low).astype(np.int64)
    return place[np.r_[True, place[1:] != place[:-1]]]


def winnow(body: str, gram: int, least: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position from 0) of the chosen grams of a text whose runs of `least` characters must be found.

    Grams with the same hash and the same surroundings of `reach` characters lead
    to the same runs, so only the first of them is kept: a text that repeats
    itself does not multiply its fingerprints.
    """
    points = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    window = least - gram + 1
    found: list[np.ndarray] = []
    size = min(SEGMENT, len(points)) + least + 2 * reach
    up, down = _powers(1 << size.bit_length())
    for first in range(0, len(points) - least + 1, SEGMENT):
        last = min(first + SEGMENT, len(points) - least + 1)  # windows of this segment
        low, high = max(0, first - reach), min(len(points), last + least - 1 + reach)
        here = points[low:high]
        total = np.zeros(len(here) + 1, np.uint64)
        np.cumsum((here + np.uint64(1)) * up[: len(here)], dtype=np.uint64, out=total[1:])

        start, stop = first - low, last + window - 1 - low
        grams = _mixed((total[start + gram : stop + gram] - total[start:stop]) * down[start:stop])
        chosen = _least(grams, window)
        spot = chosen + start
        a, b = np.maximum(spot - reach, 0), np.minimum(spot + gram + reach, len(here))
        around = _mixed((total[b] - total[a]) * down[a]) ^ _mixed((spot - a).astype(np.uint64) * np.uint64(reach + 1) + (b - spot).astype(np.uint64))
        found.append(np.stack([grams[chosen], around, (spot + low).astype(np.uint64)]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, around, spot = np.concatenate(found, axis=1)
    order = np.argsort(around)
    grams, around, spot = grams[order], around[order], spot[order]
    fresh = np.flatnonzero(np.r_[True, (grams[1:] != grams[:-1]) | (around[1:] != around[:-1])])
    return grams[fresh].view(np.int64), np.minimum.reduceat(spot, fresh).astype(np.int64)


def fingerprints(texts: DataFrame, key: str, body: str, gram: int, least: int, reach: int) -> DataFrame:
    """(key, hash, pos) of each text, read once and linear in its length."""
    kind = texts.schema[key].dataType.simpleString()

    def together(batch: pa.RecordBatch, held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        at, hashes, spots = zip(*held)
        same = batch.column(key).take(pa.array(np.repeat(at, [len(s) for s in spots])))
        return pa.RecordBatch.from_arrays([same, pa.array(np.concatenate(hashes)), pa.array(np.concatenate(spots))], names=[key, "hash", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, np.ndarray, np.ndarray]] = []
            rows = 0
            for i, value in enumerate(batch.column(body)):
                hashes, spots = winnow(value.as_py() or "", gram, least, reach)
                if held and rows + len(spots) > ROWS:
                    yield together(batch, held)
                    held, rows = [], 0
                if len(spots):
                    held.append((i, hashes, spots))
                    rows += len(spots)
            if held:
                yield together(batch, held)

    return texts.select(key, body).mapInArrow(run, f"`{key}` {kind}, hash long, pos long")


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "passages")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _surroundings(texts: DataFrame, spots: DataFrame, key: str, body: str, reach: int, gram: int, name: str) -> DataFrame:
    """(key, pos, before, after): the characters before a position of a collapsed text, reversed, and those from it on."""
    kind = texts.schema[key].dataType.simpleString()
    wanted = spots.select(key, "pos").distinct().groupBy(key).agg(F.collect_list("pos").alias("pos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (value, places) in enumerate(zip(batch.column(body).to_pylist(), batch.column("pos").to_pylist())):
                same = batch.column(key).take(pa.array(np.full(len(places), i)))
                before = [value[max(0, p - reach) : p][::-1] for p in places]
                after = [value[p : p + gram + reach] for p in places]
                arrays = [same, pa.array(places, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "pos", "before", "after"])

    with_hit = _written(spots.select(key).distinct())  # small, however many positions: other texts need not be shuffled
    found = texts.select(key, body).join(with_hit, key, "left_semi").join(wanted, key).withColumn(body, text.collapse(F.col(body)))
    cut = found.mapInArrow(run, f"`{key}` {kind}, pos long, before string, after string")
    return cut.select(
        F.col(key), F.col("pos").alias(f"_{name}_pos"), F.col("before").alias(f"_{name}_before"), F.col("after").alias(f"_{name}_after")
    )


def common_prefix(a: Column, b: Column, most: int) -> Column:
    """How many characters two short texts have in common at their beginning, by halving the range."""

    def probe(t: Column) -> Column:
        def narrow(state: Column, _: Column) -> Column:
            middle = F.ceil((state["low"] + state["high"]) / 2).cast("int")
            return text.bind(
                middle,
                lambda n: F.when(
                    F.substring(t["a"], F.lit(1), n) == F.substring(t["b"], F.lit(1), n),
                    F.struct(n.alias("low"), state["high"].alias("high")),
                ).otherwise(F.struct(state["low"].alias("low"), F.greatest(state["low"], n - 1).alias("high"))),
            )

        top = F.least(F.length(t["a"]), F.length(t["b"]), F.lit(most))
        steps = F.sequence(F.lit(1), F.lit(max(1, most.bit_length())))
        return F.aggregate(steps, F.struct(F.lit(0).alias("low"), top.alias("high")), narrow, lambda s: s["low"])

    return text.bind(F.struct(a.alias("a"), b.alias("b")), probe)


def _met(left: DataFrame, right: DataFrame, l_key: str, r_key: str, block: int) -> DataFrame:
    """Positions of equal fingerprints; those of a frequent one are dealt to pairs of blocks."""
    size = lambda df, name: df.groupBy("hash").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    blocks = size(left, "_ln").join(size(right, "_rn"), "hash")
    mine = F.pmod(F.xxhash64(l_key, "pos"), F.col("_ln")).cast("int").alias("_i")
    l = left.join(blocks, "hash").select(l_key, F.col("pos").alias("_l_pos"), "hash", mine, F.explode(F.expr("sequence(0, _rn - 1)")).alias("_j"))
    mine = F.pmod(F.xxhash64(r_key, "pos"), F.col("_rn")).cast("int").alias("_j")
    r = right.join(blocks, "hash").select(r_key, F.col("pos").alias("_r_pos"), "hash", mine, F.explode(F.expr("sequence(0, _ln - 1)")).alias("_i"))
    return l.join(r, ["hash", "_i", "_j"]).drop("hash", "_i", "_j")


def corpus_passages(
    left: DataFrame, right: DataFrame, l_key: str, r_key: str, body: str, min_len: int = 40, max_len: int = 80, block: int = BLOCK
) -> DataFrame:
    """(l_key, r_key, start, length, fragment): the longest run of each text on the left with each on the right.

    Runs count from `min_len` and up to `max_len` characters of the texts with
    white space collapsed; among longest ones the leftmost in the left text wins, `start`
    counts from 1. The keys must differ in name and be unique. Texts that are
    NULL or shorter than `min_len` share nothing. What meets in the joins are fingerprints and the characters
    around hits. Fingerprints, hits and the keys with a hit are stored when this is called: they are used several
    times, and Spark plans by their real size. So fingerprints of the left and texts without a hit cross the
    network only when what they meet is too large for a broadcast.
    """
    require(left, l_key, body)
    require(right, r_key, body)
    gram = min(min_len, max(8, min_len // 2))
    l_texts = left.select(l_key, text.collapse(F.col(body)).alias(body))
    r_texts = right.select(r_key, text.collapse(F.col(body)).alias(body))
    r_prints = _written(fingerprints(r_texts, r_key, body, gram, min_len, max_len))
    l_prints = fingerprints(l_texts, l_key, body, gram, min_len, max_len)
    l_prints = _written(l_prints.join(r_prints.select("hash").distinct(), "hash", "left_semi"))
    hits = _written(_met(l_prints, r_prints, l_key, r_key, block))
    l_spots = hits.select(l_key, F.col("_l_pos").alias("pos"))
    r_spots = hits.select(r_key, F.col("_r_pos").alias("pos"))
    near = hits.join(_surroundings(left, l_spots, l_key, body, max_len, gram, "l"), [l_key, "_l_pos"])
    near = near.join(_surroundings(right, r_spots, r_key, body, max_len, gram, "r"), [r_key, "_r_pos"])
    grown = near.withColumns({
        "_back": common_prefix(F.col("_l_before"), F.col("_r_before"), max_len),
        "_on": common_prefix(F.col("_l_after"), F.col("_r_after"), gram + max_len),
    }).filter(F.col("_on") >= gram)  # an equal hash of unequal grams is no hit
    runs = grown.select(
        l_key, r_key, (F.col("_l_pos") - F.col("_back") + 1).alias("start"),
        F.least(F.lit(max_len), F.col("_back") + F.col("_on")).alias("length"),
        F.concat(F.reverse(F.substring("_l_before", F.lit(1), F.col("_back"))), F.col("_l_after")).alias("_run"),
    ).filter(F.col("length") >= min_len)
    best = F.max_by(F.struct("start", "length", F.substring("_run", F.lit(1), F.col("length")).alias("fragment")), F.struct("length", -F.col("start")))
    return runs.groupBy(l_key, r_key).agg(best.alias("_b")).select(l_key, r_key, "_b.*")
