"""Phrase mining, source mixing and vector codes against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from galley.llm import language_crf, phrase_tiles, pii_semicrf, source_mix, vector_codes
from galley.llm.gnat import Gnat, squared

TABLES = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"


# ---- 11, phrases


def plain_phrases(rows, least, top):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    count[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in count.items():
        found = []
        threes = {p: a for p, a in f.items() if len(p) == 3 and a >= least}
        for phrase, a in f.items():
            if len(phrase) == 1 or a < least:
                continue
            if len(phrase) == 2 and any(phrase in (p[:2], p[1:]) and 100 * b >= 50 * a for p, b in threes.items()):
                continue
            cuts = [(1_000_000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_phrases_equal_a_plain_count(spark, monkeypatch, seed):
    monkeypatch.setattr(phrase_tiles, "CHUNK", 300)  # several chunks, texts cut at pieces
    rng = random.Random(seed)
    vocabulary = ["The", "cat", "é", "sat", "on", "MAT", "x" * 40, "日本"]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", "\n", "!?", "\t"]) for _ in range(rng.randint(0, 90))]
        rows.append((i // 2, " ".join(words) if i % 9 else None, rng.choice(["en", None, "und"]), None))
    got = phrase_tiles.collocations(spark.createDataFrame(rows, SCHEMA), least=3, top=25)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases([(r[1], r[2]) for r in rows], 3, 25)


def test_tiles_dense_and_sparse(monkeypatch):
    rng = np.random.default_rng(3)
    left, right = (np.minimum(rng.zipf(1.3, 20_000), 10**6) for _ in range(2))
    want = sorted(Counter(zip(left.tolist(), right.tolist())).items())
    for dense in (1, 500, 1 << 30):
        monkeypatch.setattr(phrase_tiles, "DENSE", dense)
        a, b, n = phrase_tiles.tile_counts(left.astype(np.int64), right.astype(np.int64))
        assert sorted(zip(zip(a.tolist(), b.tolist()), n.tolist())) == want
    none = np.zeros(0, np.int64)
    assert [len(x) for x in phrase_tiles.tile_counts(none, none)] == [0, 0, 0]


def test_long_text_without_a_piece_end_stays_whole(monkeypatch):
    monkeypatch.setattr(phrase_tiles, "CHUNK", 100)
    data = np.frombuffer(b"a b " * 80 + b". c." + b"d e, " * 60, np.uint8)
    parts = [bytes(t) for _, t in phrase_tiles._parts(data, np.array([0, len(data)]))]
    assert b"".join(parts) == bytes(data) and len(parts[0]) == 321 and all(len(p) <= 100 for p in parts[1:])


def test_filter_lets_every_pair_pass(spark):
    rows = [(i * 7 % 1000, i * 13 % 977) for i in range(500)]
    known = phrase_tiles.pair_filter(spark.createDataFrame(rows, "left long, right long").repartition(3))
    left, right = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1))
    bits = phrase_tiles._bits(left, right)
    assert ((known[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1).all()
    assert np.unpackbits(known).sum() <= 500


def test_phrase_edges(spark):
    assert phrase_tiles.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, None, None), (1, "", "en", None), (1, " \t.\n", "en", "a"), (2, "a b c", None, None)]
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS chunk", "2 AS word", "3 AS id", "4 AS count", "5 AS f")
    assert phrase_tiles.collocations(clash).count() == 0
    got = [tuple(r) for r in phrase_tiles.collocations(clash, least=1).orderBy("rank").collect()]
    assert got == [("und", 1, "a b c", 1, 1, 1, 3, 1_000_000)]
    giant = spark.createDataFrame([(1, "p q " * 300_000, "en", None)], SCHEMA)
    got = [tuple(r) for r in phrase_tiles.collocations(giant).orderBy("rank").collect()]
    assert [g[2] for g in got] == ["p q p", "q p q"] and got[0][3] == 299_999


# ---- 12, mixing


def plain_seats(weights, limits, seats):
    given = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if given[i] < limits[i]]
        if not open_:
            break
        given[max(open_, key=lambda i: (Fraction(weights[i], 2 * given[i] + 1), -i))] += 1
    return given


@pytest.mark.parametrize("seed", range(4))
def test_seats_equal_dealing_them_one_by_one(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(1, 12)
    weights = [rng.choice([1, 2, 3, rng.randint(1, 500)]) for _ in range(n)]
    limits = [rng.choice([0, 1, rng.randint(0, 40), 10_000]) for _ in range(n)]
    seats = rng.choice([0, 1, n, rng.randint(0, 300)])
    rows = [(0, i, w, c, seats, n, sum(weights)) for i, (w, c) in enumerate(zip(weights, limits))]
    parties = spark.createDataFrame(rows, "g int, i int, weight long, seat_limit long, seats long, n_parties long, all_weights long")
    got = [r["quota"] for r in source_mix.apportion(parties, ["g"], ["i"]).orderBy("i").collect()]
    assert got == plain_seats(weights, limits, seats)


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = budget - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        if not above:
            return {s: share.get(s, Fraction(2 * sizes[s])) for s in names}
        full |= above


def test_mix_meets_targets_and_limits(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "B", "é", "", None, "one"])
        rows.append((rng.choice([i, 7, None]), " w" * rng.choice([0, 1, 5, 60, 900]) if i % 11 else None, None, source))
    rows.append((1000, "only", None, "tiny"))
    docs = spark.createDataFrame(rows, SCHEMA)
    mix = [source_mix.mixed(docs.repartition(n), block=32, shard=3000).collect() for n in (1, 7)]
    assert sorted(map(str, mix[0])) == sorted(map(str, mix[1]))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = plain_targets(sizes)
    assert len(mix[0]) == len(rows)
    taken = Counter()
    by_size = {(n, float(t)): s for s, n in sizes.items() for t in [want[s]]}
    for r in mix[0]:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[by_size[r["source_size"], r["target"]]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= Fraction(1, 2), s


def test_mix_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert source_mix.mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, None), (1, " \t\r", None, "a")], SCHEMA)
    assert [(r["size"], r["target"], r["taken"]) for r in source_mix.mixed(blank).collect()] == [(0, 0.0, 0)] * 2
    clash = spark.createDataFrame([(1, "a\x0bb c", None, "s")], SCHEMA).selectExpr("*", "9 AS size", "9 AS place", "9 AS shard")
    (r,) = source_mix.mixed(clash).collect()
    assert (r["size"], r["source_size"], r["target"], r["taken"]) == (3, 3, 4.5, 5)
    long = spark.createDataFrame([(1, "w " * 500_000, None, "s"), (2, "v", None, "s")], SCHEMA)
    got = {r["doc_id"]: (r["size"], r["taken"]) for r in source_mix.mixed(long).collect()}
    assert got[1][0] == 500_000 and sum(t for _, t in got.values()) == math.floor(1.5 * 500_001 + 0.5)


# ---- 13, vector codes


@pytest.mark.parametrize("n,k,scale", [(256, 16, 250), (256, 2, 4), (300, 1, 2), (9, 3, 0), (1, 4, 9), (256, 16, 1 << 27)])
def test_tree_equals_all_distances(n, k, scale):
    rng = np.random.default_rng([n, k])
    points, queries = rng.integers(-scale, scale + 1, (n, k)), rng.integers(-scale, scale + 1, (400, k))
    exact = sum((queries[:, i, None].astype(object) - points[None, :, i].astype(object)) ** 2 for i in range(k))
    assert (squared(queries, points) == exact).all()
    tree = Gnat(points)
    index, best = tree.nearest(queries)
    assert (index == exact.argmin(1)).all() and (best == exact.min(1)).all()
    if (n, k) == (256, 2):
        assert tree.eliminated > 2 * tree.visited


def plain_codes(rows, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    vectors = np.array([[math.floor(1024 * x) for x in r[1]] for r in kept], dtype=object)
    width = vectors.shape[1] // 4
    parts = vectors.reshape(len(kept), 4, width)
    first = sorted(range(len(kept)), key=lambda i: kept[i][0])[:entries]
    books = [[list(parts[i, p]) for i in first] for p in range(4)]

    def assign():
        out = []
        for i in range(len(kept)):
            best = [min((sum((a - b) ** 2 for a, b in zip(parts[i, p], e)), j) for j, e in enumerate(books[p])) for p in range(4)]
            out.append(best)
        return out

    for _ in range(rounds):
        mine = assign()
        for p in range(4):
            for j in range(len(books[p])):
                members = [parts[i, p] for i in range(len(kept)) if mine[i][p][1] == j]
                if members:
                    books[p][j] = [sum(m[x] for m in members) // len(members) for x in range(width)]
    mine = assign()
    text = ",".join(str(x) for book in books for e in book for x in e)
    total = Counter()
    for r, best in zip(kept, mine):
        total[r[2]] += sum(b[0] for b in best)
    sha = hashlib.sha256(text.encode()).hexdigest()
    return sorted(
        (r[0], "".join(f"{b[1]:02x}" for b in best), sum(b[0] for b in best), total[r[2]], sha) for r, best in zip(kept, mine)
    )


VECTORS = "vec_id long, embedding array<float>, label int"


def test_codes_equal_a_plain_run(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(320):
        v = [float(np.float32(x)) for x in rng.normal(0, 0.02, 8)]
        if i % 40 == 3:
            v = [None, v[:3] + [None] + v[4:], v[:7] + [math.inf], [math.nan] * 8][i // 40 % 4]
        rows.append((i * 7 % 320, v, None if i % 5 == 0 else i % 3))
    rows[50] = (rows[50][0], rows[51][1], 1)
    got = vector_codes.compressed(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    assert sorted(map(tuple, got)) == plain_codes(rows)


def test_code_edges(spark):
    assert vector_codes.compressed(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(None, [1.0] * 4, None), (3, [0.5] * 4, 1), (3, [0.5] * 4, 1), (2, [1.0, 2.0], 1), (1, [], 2), (0, [3e38] * 4, 2), (9, None, 4)]
    clash = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS code", "2 AS error", "3 AS parts")
    got = sorted(map(tuple, vector_codes.compressed(clash).collect()), key=str)
    sha = hashlib.sha256(",".join(map(str, [512, 512, 1024] * 4)).encode()).hexdigest()
    assert [g[:4] for g in got] == [
        (0, None, None, None), (1, None, None, None), (2, None, None, 0), (3, "00000000", 0, 0), (3, "00000000", 0, 0), (None, "02020202", 0, 0)
    ]
    assert {g[4] for g in got} == {sha}
    only = spark.createDataFrame([(1, [1.0, 2.0], 1)], VECTORS)
    assert [tuple(r)[:4] for r in vector_codes.compressed(only).collect()] == [(1, None, None, None)]


# ---- 8, what the language field learns from


def test_language_sample_keeps_its_places(spark):
    """Nulls, texts without a letter and repeated rows take no places; long texts are not cut to their beginning."""
    rows = [(i, None if i % 2 else "12 34 !", "de", None) for i in range(300)]
    rows += [(1000 + i, f"ein kurzer text nummer {i}", "de", None) for i in range(30)]
    rows += [(1000, "ein kurzer text nummer 0", "de", None)] * 50 + [(1001, "zweite fassung", "de", None)]
    rows += [(2000 + i, "kopf " * 1000 + "ende " * 4000, "fr", None) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    texts, langs = language_crf.labelled_sample(docs, texts=15, chars=2000)
    assert Counter(langs) == {"de": 15, "fr": 15}
    assert all(len(t) == 2000 for t, lang in zip(texts, langs) if lang == "fr")
    assert sum("kopf" not in t for t, lang in zip(texts, langs) if lang == "fr") >= 8
    assert (texts, langs) == language_crf.labelled_sample(docs.repartition(2), texts=15, chars=2000)
    assert language_crf.labelled_sample(docs.limit(0)) == ([], [])


# ---- 1, places that spans take


def test_taken_places_equal_a_plain_search():
    rng = random.Random(3)
    for _ in range(300):
        taken, plain = pii_semicrf.Taken(), []
        for _ in range(rng.randint(1, 30)):
            a = rng.randint(0, 60)
            b = a + rng.randint(1, 9)
            free = not any(a < y and x < b for x, y in plain)
            assert taken.free(a, b) == free
            if free or rng.random() < 0.3:
                taken.join(a, b)
                plain.append((a, b))
        assert all(x < y for x, y in zip(taken.starts, taken.ends)) and taken.ends[:-1] <= taken.starts[1:]


def test_many_spans_take_linear_time():
    finder = pii_semicrf.Finder(pii_semicrf.trained())
    unit = "write to jane at example dot org or call 743 555 3824, card 4111 1111 1111 1111; "
    finder.spans(unit * 300)

    def seconds(n):
        start = time.perf_counter()
        finder.spans(unit * n)
        return time.perf_counter() - start

    assert seconds(2400) < 16 * seconds(300) + 0.5
