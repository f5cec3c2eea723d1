"""The script of changes turns the old version into the new one and keeps what it can."""

import random

import pytest

from galley.operators import linediff


def applied(old, new, steps):
    gone = {n for c, n in steps if c == "removed"}
    come = {n: new[n - 1] for c, n in steps if c == "added"}
    stay = iter([l for i, l in enumerate(old, 1) if i not in gone])
    return [come[i] if i in come else next(stay) for i in range(1, len(old) - len(gone) + len(come) + 1)]


def test_any_pair_of_texts():
    rng = random.Random(6)
    for _ in range(3000):
        pool = "abcdefghijkl"[: rng.randint(1, 12)]
        old = [rng.choice(pool) for _ in range(rng.randint(0, 14))]
        new = list(old) if rng.random() < 0.6 else [rng.choice(pool) for _ in range(rng.randint(0, 14))]
        for _ in range(rng.randint(0, 4)):
            if new and rng.random() < 0.5:
                new.pop(rng.randrange(len(new)))
            else:
                new.insert(rng.randint(0, len(new)), rng.choice(pool + "XYZ"))
        stay = linediff.matched_lines(old, new)
        assert all(old[i] == new[j] for i, j in stay)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(stay, stay[1:]))
        steps = linediff.script(old, new)
        assert applied(old, new, steps) == new
        assert len(steps) == len(old) + len(new) - 2 * len(stay)


def lcs(old, new):
    row = [0] * (len(new) + 1)
    for a in old:
        up = row[:]
        for j, b in enumerate(new):
            row[j + 1] = up[j] + 1 if a == b else max(up[j + 1], row[j])
    return row[-1]


def test_lines_that_occur_once_are_kept_as_far_as_possible():
    """Without repeated lines the chain of anchors is a longest common subsequence."""
    rng = random.Random(7)
    for _ in range(500):
        old = rng.sample(range(30), rng.randint(0, 20))
        new = rng.sample(range(30), rng.randint(0, 20)) if rng.random() < 0.5 else [x for x in old if rng.random() < 0.8] + [99]
        assert len(linediff.matched_lines(list(map(str, old)), list(map(str, new)))) == lcs(old, new)


@pytest.mark.parametrize("pairs", [[], [(0, 5)], [(0, 3), (1, 1), (2, 2), (3, 0), (4, 4)]])
def test_longest_chain(pairs):
    chain = linediff.longest_chain(pairs)
    assert len(chain) == {0: 0, 1: 1, 5: 3}[len(pairs)] and chain == sorted(chain, key=lambda p: p[1])


def test_a_moved_block_and_long_texts():
    old = [f"line {i}" for i in range(20_000)]
    new = old[:5000] + ["new"] + old[6000:] + old[5000:6000]
    steps = linediff.script(old, new)
    assert applied(old, new, steps) == new and len(steps) == 2001
    same = ["x"] * 50_000
    assert linediff.script(same, same[:-1]) == [("removed", 50_000)]


def test_on_tables(spark):
    base = [(1, "a\nb\nc"), (2, "same\n"), (3, None), (4, "gone"), (6, ""), (7, "p\r\nq")]
    new = [(1, "a\nX\nc\nd"), (2, "same\n"), (3, "now"), (5, "fresh\nfresh"), (6, ""), (7, "q")]
    schema = "k long, t string"
    b, n = spark.createDataFrame(base, schema), spark.createDataFrame(new, schema)
    got = linediff.ordered_changes(n, b, "k", "t")
    assert sorted(map(tuple, got.collect())) == [
        (1, 1, "removed", 2, "b"), (1, 2, "added", 2, "X"), (1, 3, "added", 4, "d"), (3, 1, "added", 1, "now"),
        (4, 1, "removed", 1, "gone"), (5, 1, "added", 1, "fresh"), (5, 2, "added", 2, "fresh"), (7, 1, "removed", 1, "p"),
    ]
    out = {r.k: r.t for r in linediff.apply_changes(b, got, "k", "t").collect()}
    assert out == {1: "a\nX\nc\nd", 2: "same\n", 3: "now", 4: "", 5: "fresh\nfresh", 6: "", 7: "q"}
    assert linediff.ordered_changes(b.limit(0), n.limit(0), "k", "t").count() == 0
