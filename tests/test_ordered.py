import random
import statistics

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galley.functions import stats
from galley.operators import drift, ordered, prefs

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
ROWS = st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.none() | st.integers(0, 9)), max_size=40, unique_by=lambda r: (r[0], r[1]))


def grouped(rows):
    groups = {}
    for g, n, v in sorted(rows, key=lambda r: (r[0], r[1])):
        groups.setdefault(g, []).append((n, v))
    return groups


@FEW
@given(ROWS)
def test_blocks_equal_a_plain_pass(spark, rows):
    df = spark.createDataFrame(rows, "g string, n int, v int")
    block = ordered.line_block("n", 7)
    carried = {(r.g, r.n): r.c for r in ordered.carry_forward(df, ["g"], ["n"], F.col("v"), "c", block).collect()}
    total = {(r.g, r.n): r.t for r in ordered.running_total(df, ["g"], ["n"], F.col("v"), "t", block).collect()}
    place = {(r.g, r.n): r.p for r in ordered.numbered(df, ["g"], ["n"], "p", [block]).collect()}
    ahead = {(r.g, r.n): r.a for r in ordered.next_value(df, ["g"], ["n"], F.col("v"), "a", block).collect()}
    for g, items in grouped(rows).items():
        last, so_far = None, 0
        for i, (n, v) in enumerate(items):
            last = v if v is not None else last
            so_far += v or 0
            assert carried[(g, n)] == last and total[(g, n)] == so_far and place[(g, n)] == i + 1
            assert ahead[(g, n)] == (items[i + 1][1] if i + 1 < len(items) else None)


def test_exact_quantile(spark):
    rng = random.Random(3)
    rows = [(g, float(rng.randint(0, 50))) for g in "abc" for _ in range(rng.randint(1, 30))] + [("n", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.m for r in ordered.exact_quantile(df, ["g"], "v", 0.5, "m").collect()}
    assert got == {g: statistics.median([v for h, v in rows if h == g]) for g in "abc"}


def test_exact_quantile_of_a_dense_and_a_wide_group(spark):
    """No width fits both: a million apart and a millionth apart."""
    rng = random.Random(9)
    dense = [("dense", rng.randint(0, 3000) * 1e-6) for _ in range(4000)]
    wide = [("wide", rng.uniform(-1e15, 1e15)) for _ in range(3001)] + [("one", 7.0), ("same", 2.5), ("same", 2.5)]
    df = spark.createDataFrame(dense + wide, "g string, v double")
    for q in (0.0, 0.25, 0.5, 1.0):
        got = {r.g: r.m for r in ordered.exact_quantile(df, ["g"], "v", q, "m").collect()}
        for g in ("dense", "wide", "one", "same"):
            values = sorted(v for h, v in dense + wide if h == g)
            at = (len(values) - 1) * q
            low, high = values[int(at)], values[min(int(at) + (at > int(at)), len(values) - 1)]
            assert abs(got[g] - (low + (at - int(at)) * (high - low))) <= 1e-12 * max(1, abs(low), abs(high))


def test_range_numbers_equal_a_window(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 3), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = {r.id: r.n for r in ordered.range_numbered(df, ["g"], [F.desc("v"), "id"], "n").collect()}
    for g in ("a", "b", None):
        for place, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            assert got[i] == place
    alone = ordered.range_numbered(df, [], ["id"], "n").filter("n <> id + 1")
    assert alone.count() == 0 and ordered.range_numbered(df.limit(0), ["g"], ["id"], "n").count() == 0


def test_a_hot_group_of_equal_rank_is_dealt_to_many_tasks(spark):
    """A third of all rows on one board with one status and priority; the later order deals them."""
    rows = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("int").alias("board"), F.lit(1).alias("p"), "id"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows are few
    try:
        placed = ordered.in_ranges(rows, ["board"], ["p", "id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    hot = placed.filter("board = 0").select("_part").distinct().count()
    assert len(sizes) >= 6 and max(sizes) < 2 * 90_000 / len(sizes) and hot >= len(sizes) // 3


def test_merge_runs(spark):
    df = spark.createDataFrame([("d", p) for p in (1, 2, 3, 3, 7, 9, 10)], "d string, p int")
    assert {(r.start, r.length) for r in drift.merge_runs(df, ["d"], "p").collect()} == {(1, 3), (7, 1), (9, 2)}


def test_sign_test(spark):
    from math import comb

    cases = [(8, 10), (5, 10), (0, 1), (122, 149), (0, 0), (500, 1000), (499_000, 1_000_000)]
    df = spark.createDataFrame(cases, "wins long, n long").select("wins", "n", stats.sign_test_p(F.col("wins"), F.col("n")).alias("p"))
    got = {(r.wins, r.n): r.p for r in df.collect()}
    assert got[(0, 0)] is None
    for wins, n in cases[:-1]:
        if n:
            exact = min(1.0, 2 * sum(comb(n, k) for k in range(min(wins, n - wins) + 1)) / 2**n)
            assert abs(got[(wins, n)] - exact) < 1e-9 * max(exact, 1e-3)
    assert abs(got[(8, 10)] - 0.109375) < 1e-11
    assert 0.045 < got[(499_000, 1_000_000)] < 0.046


def test_preferences(spark):
    pairs = spark.createDataFrame([(1, "a", "b", "a"), (2, "a", "c", "c"), (3, "b", "c", "b"), (4, "a", "b", "b")], "pair_id int, left_id string, right_id string, winner string")
    rows = [("a", "face", 2.0), ("b", "face", 1.0), ("c", "face", 1.0), ("a", "same", 1.0), ("b", "same", 1.0), ("c", "same", 1.0)]
    got = {r.axis: r for r in prefs.preference_test(pairs, spark.createDataFrame(rows, "id string, axis string, value double")).collect()}
    # pair 3 is equal on the axis and says nothing
    assert (got["face"].wins, got["face"].n) == (1, 3)
    assert got["same"].n == 0 and got["same"].rate is None and got["same"].verdict == "not_measured"


def test_cosine(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>").select(
        stats.cosine(F.col("a"), F.col("b")).alias("c"), stats.cosine(F.col("a"), F.col("z")).alias("n")
    ).first()
    assert abs(row.c - 0.5**0.5) < 1e-9 and row.n is None
