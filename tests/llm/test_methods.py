"""The methods against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from galley.llm import (
    byte_bpe,
    edit_match,
    html_lstm,
    language_crf,
    lattice_lm,
    ngram_join,
    passage_dedup,
    pii_semicrf,
    quality_net,
    vector_dedup,
    words,
)
from galley.llm.components import components
from galley.llm.run_index import RunIndex
from tests.oracle import compare, connect

TABLES = "/root/testdata/sf0.001"


# ---- words


def test_words_and_shingles():
    texts = ["The  cat\tsat ON the mat", None, "", "one two", "a b c d e f a b c d e"]
    (got,) = words.slices(pa.array(texts))
    assert [got.text(i) for i in range(len(got.key))] == " ".join(t.lower() for t in texts if t).split()
    gram, bounds = words.shingles(got)
    assert np.diff(bounds).tolist() == [2, 0, 0, 1, 6]


# ---- 1, personal data

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = (
                kind == 0
                or kind == 1 and all(int(p) <= 255 for p in m.group().split("."))
                or kind == 2 and 16 <= len(digits) <= 19 and pii_semicrf.luhn(digits)
                or kind == 3 and 8 <= len(digits) <= 15
            )
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    parts = ["a@b.c", "x.y@", "@", "12", "1.2.3.4", "255", ".", "+", "-", " ", "(", ")", "4111111111111111", "é", "0", "+49 30 1234567", "b"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert pii_semicrf.base_spans(text) == plain_spans(text), text


def test_field_finds_forms_beyond_the_patterns():
    finder = pii_semicrf.Finder(pii_semicrf.trained())
    found = missed = wrong = 0
    for text, gold in pii_semicrf.examples(200, seed=99):
        base, added = finder.spans(text)
        got = {s[:3] for s in added} | set(base)
        found += len(set(gold) & got)
        missed += len(set(gold) - got)
        wrong += len({s[:3] for s in added} - set(gold))
    assert found / (found + missed) > 0.8 and wrong <= 4


def test_stretches_lose_no_candidate():
    model = pii_semicrf.trained()
    finder = pii_semicrf.Finder(model)
    rng = random.Random(5)
    parts = ["at", "AT", "At", "@", "[at]", "(dot)", "Dot", " ", " ", "  ", "\n", "8", "12", "[.]", ".", "-", "name", "host", "x²", "²", "é", "中", "٣", "4111", "+", ",", "_", "/"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for text in [*texts, *(text for text, _ in pii_semicrf.examples(100, seed=5))]:
        tokens, starts = pii_semicrf.tokenize(text)
        wanted = {(starts[i], starts[j]) for i, j in pii_semicrf.candidates(tokens)}
        got, added = set(), []
        for low, high in finder.stretches(text):
            part, at = pii_semicrf.tokenize(text[low:high])
            got |= {(low + at[i], low + at[j]) for i, j in pii_semicrf.candidates(part)}
            added += [(kind, low + a, low + b) for kind, a, b, _ in finder.scored(text[low:high])]
        assert got == wanted, text
        edges = model.lattice(tokens)
        sure = [(int(p.argmax()) - 1, starts[i], starts[j]) for (i, j, _, _), p in zip(edges, model.posteriors(tokens, edges)) if p.argmax() and p.max() >= pii_semicrf.ADD_AT]
        assert added == sure, text
    assert pii_semicrf.masked("name [AT] host [DOT] com", finder) == "<EMAIL>"
    assert pii_semicrf.masked("dns is 8[.]8[.]8[.]8 here", finder) == "dns is <IP> here"
    long = "firstname.middlename.lastname-department (at) example (dot) org"
    assert finder.stretches(long) == [(0, len(long))]


def test_masking():
    finder = pii_semicrf.Finder(pii_semicrf.trained())
    assert pii_semicrf.masked("write to a.b@c.org or 10.0.0.1 now", finder) == "write to <EMAIL> or <IP> now"
    assert pii_semicrf.masked("nothing here in 2024", finder) == "nothing here in 2024"


# ---- 2, byte BPE


@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers
    import tiktoken

    ranks, pattern = byte_bpe.given_ranks()
    assert pattern == public_tokenizers.PATTERN
    return ranks, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_the_library(tokens):
    ranks, pattern, library = tokens
    coder = byte_bpe.Codec(ranks, pattern)
    rng = random.Random(2)
    parts = [*"ab 'stS  \n\n\t.,!19é漢　 \u0085\x1c\r\x0b​½Ⅷ😀", " ", " ", "\n", " the", "'ll", "<|endoftext|>", "x" * 120]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    ids, counts = coder.encode_column(pa.array(texts))
    for text, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert part.tolist() == library.encode_ordinary(text), repr(text)
        assert coder.decode(part) == text.encode()
    forms, _ = coder.ids_texts(pa.array(texts))
    assert forms.to_pylist()[5] == ",".join(map(str, library.encode_ordinary(texts[5])))


def test_chunks_are_stitched(spark, tokens):
    ranks, pattern, library = tokens
    rng = random.Random(3)
    texts = ["".join(rng.choice(["word ", "a\n\n", "   ", "été", "12", "x" * 50]) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in byte_bpe.encode_texts(frame, ranks, pattern, chunk=64, overlap=24).collect():
        ids = library.encode_ordinary(row["text"])
        assert row["ids"] == ",".join(map(str, ids)) and row["n_tokens"] == len(ids)


# ---- 3, passages


def naive_marks(strings, owners, depth):
    seen = {}
    for s, o in zip(strings, owners):
        for p in range(len(s) - depth + 1):
            seen[s[p : p + depth]] = min(o, seen.get(s[p : p + depth], o))
    return [[p for p in range(len(s) - depth + 1) if seen[s[p : p + depth]] < o] for s, o in zip(strings, owners)]


def test_run_index_streams_matching_statistics():
    rng = random.Random(5)
    for _ in range(20):
        indexed = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))).encode() for _ in range(12)]
        others = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))).encode() for _ in range(8)]
        depth = 8
        index = RunIndex(np.frombuffer(b"".join(indexed), np.uint8), np.array([len(s) for s in indexed]), np.arange(12), depth)
        for strings, own in ((indexed, True), (others, False)):
            size = np.array([len(s) for s in strings])
            begin = np.cumsum(size) - size
            for lane, place, match, row in index.stream(np.frombuffer(b"".join(strings), np.uint8), size, own):
                for k, p, m, r in zip(lane, place - begin[lane], match, row):
                    rest = strings[k][p:]
                    best = max((n for n in range(len(rest) + 1) if any(rest[:n] in s for s in indexed)), default=0)
                    assert m == best
                    if m >= depth:
                        assert index.least_of(np.array([r]))[0] == min(i for i, s in enumerate(indexed) if rest[:depth] in s)


def test_windows_in_blocks(monkeypatch):
    rng = random.Random(6)
    base = "".join(rng.choice("abcd ") for _ in range(400))
    strings = [base[(a := rng.randint(0, 300)) : a + rng.randint(50, 80)].encode() for _ in range(60)]
    size = np.array([len(s) for s in strings])
    owner = np.array([rng.randint(0, 9) for _ in strings])
    want = naive_marks(strings, owner, passage_dedup.LENGTH)
    data = np.frombuffer(b"".join(strings), np.uint8)
    for limit in (200, 1 << 20):
        monkeypatch.setattr(passage_dedup, "INDEX_BYTES", limit)
        mask = passage_dedup._windows(data, np.cumsum(size) - size, size, np.zeros(60, np.uint64), owner)
        assert [[p for p in range(31) if m >> p & 1] for m in mask.tolist()] == want


def test_passages_equal_brute_force(spark):
    rng = random.Random(7)
    pool = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(20, 90))) for _ in range(30)]
    docs = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in rng.sample(range(1000), 60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in passage_dedup.remove_repeats(frame, 5).collect()}
    seen: dict[bytes, int] = {}
    for i, text in sorted(docs):
        data = text.encode()
        gone = np.zeros(len(data), dtype=bool)
        for p in range(len(data) - 49):
            if seen.setdefault(data[p : p + 50], i) < i:
                gone[p : p + 50] = True
        assert bytes(got[i]["kept"]) == bytes(np.frombuffer(data, np.uint8)[~gone])
        assert got[i]["n_removed"] == gone.sum()


# ---- 4, n-gram join


def test_posterior_falls_and_rises():
    assert ngram_join.posterior(190, 190) > 0.999 > ngram_join.posterior(100, 190)
    assert ngram_join.posterior(152, 190) == pytest.approx(0.5, abs=0.1)
    low = ngram_join.least_matches(0.8, 1e-7, 190, 19)
    assert [n for n, _ in low] == list(range(19, 191, 19)) and all(m < 0.8 * n for n, m in low)


def test_join_equals_its_sql(spark):
    assert compare(spark, connect(TABLES), TABLES, ngram_join.op4_ngram_join, ngram_join.OP4_SQL) is None


def test_join_in_blocks_equals_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    base = [rng.choice("abcdefghijklmnop") * 2 for _ in range(120)]
    docs = []
    for i in range(70):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(120)] = f"w{rng.randint(0, 5)}"
        docs.append((i, " ".join(text)))
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", 8)
    grams = [{tuple(t.split()[k : k + 5]) for k in range(116)} for _, t in docs]
    want = [sum(i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(grams)) for i, a in enumerate(grams)]
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [r["n_links"] for r in sorted(got)] == want


def test_components_equal_union_find(spark):
    rng = random.Random(9)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    root = {x: x for pair in links for x in pair}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = dict(components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())
    assert got == {x: top(x) for x in root if any(x in p and p[0] != p[1] for p in links)}


# ---- 5, lattice


def test_lattice_sums_all_segmentations():
    weights = ({"▁": -1.0, "▁a": -2.0, "a": -1.5, "ab": -2.5, "b": -1.2, "▁ab": -4.0}, [-7.0] * 256, 3)

    def brute(text):
        if not text:
            return [[]]
        out = []
        for n in range(1, len(text) + 1):
            options = [weights[0][text[:n]]] if text[:n] in weights[0] else []
            if n == 1:
                options.append(tuple([-7.0] * len(text[0].encode())))
            for o in options:
                out += [[o, *rest] for rest in brute(text[n:])]
        return out

    for word in ("a", "ab", "abé", "ba"):
        total = 0.0
        for parts in brute("▁" + word):
            flat = [x for p in parts for x in (p if isinstance(p, tuple) else (p,))]
            total += math.exp(sum(flat)) * (1 - lattice_lm.STOP) ** (len(flat) - 1) * lattice_lm.STOP
        assert lattice_lm.lattice(word, weights) == pytest.approx(math.log(total))


def test_scores_equal_brute_force(spark):
    import public_tokenizers

    got = {r["doc_id"]: r for r in lattice_lm.op5_lattice_lm(spark, TABLES).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(lower)) if w] + ["\n"] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    count: dict[str, int] = {}
    for i, ts in tokens.items():
        for t in ts if not held[i] else ():
            count[t] = count.get(t, 0) + 1
    n, v = sum(count.values()), len(count)
    weights = lattice_lm.read_weights(public_tokenizers.path(lattice_lm.VOCABULARY))
    assert set(got) == set(docs)
    for i, ts in tokens.items():
        row = got[i]
        base = sum(math.log10((count.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        low = [lattice_lm.END_MASS if t == "\n" else (1 - lattice_lm.END_MASS) * math.exp(lattice_lm.lattice(t, weights)) for t in ts]
        full = sum(math.log10((count.get(t, 0) + v * x) / (n + v)) for t, x in zip(ts, low))
        assert row["held_out"] == held[i] and row["n_tokens"] == len(ts) and row["train_tokens"] == n
        assert row["n_known"] == sum(t in count for t in ts)
        assert row["base_score"] == pytest.approx(base) and row["score"] == pytest.approx(full)


# ---- 6, edit matching


def distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_matches_equal_full_edit_distance():
    rng = random.Random(10)
    items = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(40, 90))).strip() for _ in range(6)]
    items = [edit_match.fold(x) for x in items]
    matcher = edit_match.Matcher(list(enumerate(items)), 0.1)
    for _ in range(60):
        i = rng.randrange(6)
        noisy = list(items[i])
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(noisy))
            noisy[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "b"])
        text = edit_match.fold("xx " * rng.randint(0, 5) + "".join(noisy) + " yy")
        got = {k: (d, text[a:b]) for k, d, a, b in matcher.find(text)}
        for k, item in enumerate(items):
            want = distance_in(item, text)
            if want <= len(item) // 10:
                assert got[k][0] == want and distance_in(got[k][1], item) <= want
            else:
                assert k not in got


# ---- 7, pages


def test_blocks():
    page = "<head><title>t</title></head><body><nav><a href=x>Home</a></nav><p>one <b>two</b>&amp;<br>three<p>four<script>no()</script></body>"
    assert [b[0] for b in html_lstm.blocks(page)] == ["Home", "one two&", "three", "four"]


def test_blocks_after_skipped_elements_left_open():
    texts = lambda page: [b[0] for b in html_lstm.blocks(page)]
    article = "<article><p>one<p>two</article>"
    for head in ("<title>t</title>", "<title>t", "<noscript><link>", "<script>x = '</head>'</script>", "<style>x</style>\n<meta a=b>"):
        assert texts(f"<html><head>{head}<body>{article}</html>") == ["one", "two"], head
    assert texts(f"<head><title>t</title>{article}") == ["one", "two"]
    assert texts("<head><title>t</title> plain text") == ["plain text"]
    for tag in ("noscript", "template", "svg", "object", "iframe"):
        assert texts(f"<div>a<{tag}>no</div>{article}<{tag}>no</{tag}>") == ["a", "one", "two"], tag
        assert texts(f"<ul><li>a<{tag}>no<li>b</ul>{article}") == ["a", "b", "one", "two"], tag
        assert texts(f"<body><{tag}>no{article}</body>") == ["one", "two"], tag
        assert texts(f"<p>a<{tag}><style>no</{tag}>b</p>{article}") == ["ab", "one", "two"], tag
    for tag in ("script", "style"):
        assert texts(f"<p>a</p><{tag}>no{article}") == ["a"], tag


def test_extraction_on_the_tables(spark):
    rows = html_lstm.op7_html_lstm(spark, TABLES).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{TABLES}/pages.parquet").collect()}
    right = 0
    for row in rows:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[row["page_id"]], re.DOTALL).group(1)
        right += row["text"] == " ".join(b[0] for b in html_lstm.blocks(inner))
    assert right >= 0.98 * len(rows)


def test_extraction_on_unseen_layouts():
    data = html_lstm.examples(80, seed=123)
    labels = html_lstm.trained().label([html_lstm.vectors(found) for found, _ in data])
    wrong = sum(int(((p >= 0.5) != (y > 0.5)).sum()) for p, (_, y) in zip(labels, data))
    assert wrong <= 0.02 * sum(len(y) for _, y in data)


def test_lstm_gradient():
    rng = np.random.default_rng(1)
    model = html_lstm.Lstm(3)
    x, mask = rng.standard_normal((4, 2, html_lstm.SIZE)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], dtype=float)
    y = rng.integers(0, 2, (4, 2)).astype(float)

    def loss():
        p = model.forward(x, mask)[0]
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    grads = model.gradients(x, mask, y)
    for k, theta in enumerate(model.theta):
        at = tuple(rng.integers(0, s) for s in theta.shape)
        theta[at] += 1e-5
        up = loss()
        theta[at] -= 2e-5
        down = loss()
        theta[at] += 1e-5
        assert grads[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


# ---- 8, language


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    emission, transition, start = rng.standard_normal((5, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    bounds = np.array([0, 3, 3, 5])
    got = language_crf.forward_backward(emission, bounds, transition, start)
    for low, high in ((0, 3), (3, 5)):
        total = np.zeros((high - low, 3))
        for path in np.ndindex(*[3] * (high - low)):
            score = start[path[0]] + sum(emission[low + t, y] for t, y in enumerate(path))
            score += sum(transition[a, b] for a, b in zip(path, path[1:]))
            for t, y in enumerate(path):
                total[t, y] += math.exp(score)
        assert np.allclose(got[low:high], total / total.sum(1, keepdims=True))


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "lang")
    rows = language_crf.op8_language_crf(spark, TABLES).join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


# ---- 9, vectors


def test_vectors_equal_their_sql(spark):
    assert compare(spark, connect(TABLES), TABLES, vector_dedup.op9_vector_dedup, vector_dedup.OP9_SQL) is None


# ---- 10, quality


def test_quality_separates(spark):
    tables = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{tables}/labels.parquet").select("doc_id", "quality")
    rows = quality_net.op10_quality_net(spark, tables).join(labels, "doc_id").where("held_out").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert sum(g > b for g in good for b in bad) >= 0.9 * len(good) * len(bad)


def test_digest_of_no_ids(spark, tokens):
    row = byte_bpe.round_trip(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert hashlib.sha256(row["ids"].encode()).hexdigest() == hashlib.sha256(b"").hexdigest()
