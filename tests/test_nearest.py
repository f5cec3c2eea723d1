"""The join of nearest vectors against all pairs."""

import math
import random

import pytest

from galley.operators import nearest

SCHEMA = "id long, v array<double>"


def plain(queries, vectors, k):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        size = math.sqrt(sum(x * x for x in v))
        return [x / size for x in v]

    out = []
    known = [(i, unit(v)) for i, v in vectors if i is not None and unit(v)]
    for q, v in queries:
        if q is None or not unit(v):
            continue
        scored = sorted((-round(sum(a * b for a, b in zip(unit(v), w)), 12), i) for i, w in known)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed,k", [(0, 1), (1, 5), (2, 40)])
def test_equals_all_pairs_and_prunes(spark, seed, k):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    near = lambda c: [x + rng.gauss(0, 0.02) for x in c]
    vectors = [(i, near(rng.choice(centres))) for i in range(400)]
    vectors += [(400 + i, list(vectors[i][1])) for i in range(30)]  # ties
    vectors += [(500, None), (501, []), (502, [0.0] * 6), (503, [math.nan] * 6), (504, [1.0, None] + [0.0] * 4), (None, [1.0] * 6)]
    queries = vectors[::7] + [(900, [rng.gauss(0, 1) for _ in range(6)]), (901, None), (None, [1.0] * 6)]
    found = nearest.nearest_join(
        spark.createDataFrame(queries, "q long, v array<double>").filter("true"), spark.createDataFrame(vectors, SCHEMA), "q", "id", "v", k,
        pivots=12, ring=16, block=7,
    )
    got = sorted((r.q, r["rank"], r.id, r.similarity) for r in found.rows.collect())
    wanted = plain(queries, vectors, k)
    assert [g[:3] for g in got] == [w[:3] for w in wanted]
    assert all(abs(g[3] - w[3]) < 1e-11 for g, w in zip(got, wanted))
    work = found.work.first()
    assert work.pairs == work.compared + work.pruned and work.compared > 0
    if k < 40:
        assert work.pruned > work.pairs / 2


def test_nothing_to_find(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA)
    ask = lambda q, v: nearest.nearest_join(q.withColumnRenamed("id", "q"), v, "q", "id", "v").rows.collect()
    assert ask(none, some) == [] and ask(some, none) == []
    assert [tuple(r) for r in ask(some, some)] == [(1, 1, 1, 1.0)]
