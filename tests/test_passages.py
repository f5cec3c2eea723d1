"""Shared passages of two collections against a search of every pair."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from galley.operators import passages


def plain(left, right, least, most):
    """Longest common run of two texts, clamped, leftmost first; by dynamic programming over run ends."""
    best = (0, 0)
    before = [0] * (len(right) + 1)
    for i, c in enumerate(left):
        row = [0] * (len(right) + 1)
        for j, d in enumerate(right):
            if c == d:
                row[j + 1] = before[j] + 1
        before = row
        top = min(max(row), most)
        if top > best[0]:
            best = (top, i - top + 2)
    return best if best[0] >= least and len(left) >= least and len(right) >= least else None


def collapsed(t):
    return " ".join((t or "").split())


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_every_pair(spark, seed):
    rng = random.Random(seed)
    words = ["ab", "abc", "é", "日本語", "x", "aaaa", "z z"]
    phrase = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [phrase(9) for _ in range(4)]

    def one():
        parts = [phrase(rng.randint(0, 6)) if rng.random() < 0.6 else rng.choice(shared) for _ in range(rng.randint(0, 6))]
        return " ".join(parts)

    left = [(i, one()) for i in range(25)] + [(25, None), (26, ""), (27, "a" * 300), (28, "short"), (29, "ab " * 100)]
    right = [(i, one()) for i in range(12)] + [(12, None), (13, "a" * 90), (14, "\n" + shared[0] + "\t"), (15, "ab " * 40)]
    got = passages.corpus_passages(
        spark.createDataFrame(left, "l long, t string").repartition(4), spark.createDataFrame(right, "r long, t string"), "l", "r", "t", 12, 30, block=3
    )
    wanted = []
    for l, a in left:
        for r, b in right:
            a_, b_ = collapsed(a), collapsed(b)
            found = plain(a_, b_, 12, 30)
            if found:
                n, start = found
                wanted.append((l, r, start, n, a_[start - 1 : start - 1 + n]))
    assert sorted(map(tuple, got.collect())) == sorted(wanted) and len(wanted) > 50


def test_windows_share_their_chosen_gram(monkeypatch):
    """Any common run of the least length gives both texts an equal fingerprint, also across segments."""
    monkeypatch.setattr(passages, "SEGMENT", 64)
    rng = random.Random(1)
    for _ in range(200):
        run = "".join(rng.choice("abcd") for _ in range(24))
        texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 200))) + run + "".join(rng.choice("efg") for _ in range(rng.randint(0, 200))) for _ in range(2)]
        prints = [{h for h in passages.winnow(t, 10, 24, 40)[0].tolist()} for t in texts]
        assert prints[0] & prints[1]


def test_long_texts_take_linear_time():
    rng = random.Random(2)
    unit = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    passages.winnow(unit, 20, 40, 80)

    def seconds(t):
        start = time.perf_counter()
        passages.winnow(t, 20, 40, 80)
        return time.perf_counter() - start

    assert seconds(unit * 16) < 40 * seconds(unit) + 0.5
    assert len(passages.winnow("ab" * 500_000, 20, 40, 80)[0]) < 400  # repeats of a text are one fingerprint


def test_empty_tables(spark):
    none = spark.createDataFrame([], "l long, t string")
    some = spark.createDataFrame([(1, "w " * 50)], "r long, t string")
    assert passages.corpus_passages(none, some, "l", "r", "t").count() == 0
    assert passages.corpus_passages(some.withColumnRenamed("r", "l"), none.withColumnRenamed("l", "r"), "l", "r", "t").count() == 0


def test_each_text_is_read_twice_at_most(spark):
    """Once for its fingerprints, once for the characters around its hits, whatever the number of hits."""
    reads = spark.sparkContext.accumulator(0)

    def seen(t):
        reads.add(1)
        return t

    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdef ") for _ in range(300)) for _ in range(40)]
    left = spark.createDataFrame(list(enumerate(texts)), "l long, t string").repartition(4)
    right = spark.createDataFrame([(i, texts[i][50:200]) for i in range(0, 40, 4)], "r long, t string")
    found = passages.corpus_passages(left.withColumn("t", F.udf(seen, "string")("t")), right, "l", "r", "t").collect()
    assert {(x.l, x.r) for x in found} == {(i, i) for i in range(0, 40, 4)}
    assert reads.value <= 2 * len(texts)


def test_smallest_gram_of_each_window():
    rng = random.Random(5)
    for window in (1, 2, 5, 21, 32):
        grams = np.array([rng.randrange(6) << 60 for _ in range(500)], np.uint64)
        plain = [i + int(grams[i : i + window].argmin()) for i in range(len(grams) - window + 1)]
        assert passages._least(grams, window).tolist() == sorted(set(plain))
