"""Language identification by a linear-chain CRF over the words of a text.

Words are labelled by forward-backward, so a text may switch language. Features
of a word are its affixes, its byte n-grams and itself (the lexicon), all hashed;
transitions are learned with them. The fit runs on a bounded sample of labelled
texts whose segments are mixed, so that switches are seen in training.

Nulls and edge cases: a null or empty text, and one without a letter, gets `und`
and score 0. Words of any length are read whole. Without labelled rows every
text is `und`. Ties go to the label that sorts first. Repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from galley.llm.common import append, crc_mod, prepare
from galley.llm.words import Words, mix, powers, slices

UNKNOWN = "und"
HASH_BITS = 15
NGRAMS = (2, 3)
AFFIXES = (1, 2, 3)
NGRAM_SCALE = 3.0
SAMPLE_TEXTS, SAMPLE_CHARS = 80, 2000  # labelled texts per language in the fit, and characters of each
EPOCHS, RATE, DECAY = 40, 0.25, 1e-5
SEQUENCE = 48
RESCALE = 8  # steps between two rescalings of the recursion
FLOOR = -30.0  # least log weight of a label against the best one at a word


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # hashed feature x label
    transition: np.ndarray  # log weights, from x to
    start: np.ndarray


def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray):
    """Hashed features of words: fixed slots (affixes and lexicon), and n-grams with their words."""
    n = len(data)
    up, down = powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64, out=total[1:])
    mask = np.uint64((1 << HASH_BITS) - 1)

    def hashed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        return (mix((total[b] - total[a]) * down[a] + np.uint64(salt)) & mask).astype(np.int32)

    fixed = [(mix(key + np.uint64(99)) & mask).astype(np.int32)]
    for k in AFFIXES:
        fixed.append(hashed(start, np.minimum(start + k, end), 10 + k))
        fixed.append(hashed(np.maximum(end - k, start), end, 20 + k))
    grams, owners = [], []
    for k in NGRAMS:
        count = np.maximum(end - start - k + 1, 0)
        owner = np.repeat(np.arange(len(start)), count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + start[owner]
        grams.append(hashed(at, at + k, 30 + k))
        owners.append(owner)
    return np.stack(fixed, 1), np.concatenate(grams), np.concatenate(owners)


def _emission(weights: np.ndarray, features) -> np.ndarray:
    fixed, gram, owner = features
    n, labels = len(fixed), weights.shape[1]
    out = weights[fixed].sum(1, dtype=np.float64)
    share = np.zeros(n)
    if len(gram):
        share = NGRAM_SCALE / np.maximum(np.bincount(owner, minlength=n), 1)
        for c in range(labels):
            out[:, c] += share * np.bincount(owner, weights[gram, c], minlength=n)
    return out


def _across(op: np.ufunc, x: np.ndarray) -> np.ndarray:
    """A reduction over the few labels, by columns."""
    out = x[:, 0].copy()
    for c in range(1, x.shape[1]):
        op(out, x[:, c], out=out)
    return out[:, None]


def forward_backward(emission: np.ndarray, bounds: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of every word; row r has the words bounds[r] .. bounds[r + 1]."""
    length = np.diff(bounds)
    n, labels = emission.shape
    if n == 0:
        return np.zeros((0, labels))
    rank = np.empty(len(length), dtype=np.int64)
    rank[np.argsort(-length, kind="stable")] = np.arange(len(length))
    sorted_length = np.sort(length)[::-1]
    top = int(sorted_length[0])
    active = np.searchsorted(-sorted_length, -np.arange(top), "left").tolist()  # rows longer than t
    offset = np.cumsum([0, *active])
    row = np.repeat(np.arange(len(length)), length)
    time = np.arange(n) - np.repeat(bounds[:-1], length)
    place = offset[time] + rank[row]  # all first words, then all second words, longest rows first
    weight = np.empty((n, labels))
    weight[place] = np.exp(np.maximum(emission - _across(np.maximum, emission), FLOOR))
    step = np.exp(transition)
    alpha = np.empty_like(weight)
    offset = offset.tolist()
    state = np.multiply(weight[: active[0]], np.exp(start), out=alpha[: active[0]])
    for t in range(1, top):
        low, high = offset[t], offset[t + 1]
        state = np.matmul(state[: high - low], step, out=alpha[low:high])
        state *= weight[low:high]
        if t % RESCALE == 0:  # only ratios count
            state /= state.sum(1, keepdims=True)
    back = np.ones((active[top - 1], labels))
    turned = np.ascontiguousarray(step.T)
    for t in range(top - 1, 0, -1):
        low, high = offset[t], offset[t + 1]
        alpha[low:high] *= back
        back *= weight[low:high]
        back = back @ turned
        if t % RESCALE == 0:
            back /= back.sum(1, keepdims=True)
        if active[t - 1] > len(back):  # rows that end before t
            back = np.concatenate([back, np.ones((active[t - 1] - len(back), labels))])
    alpha[: active[0]] *= back
    alpha /= _across(np.add, alpha)
    return alpha[place]


def fit(texts: list[str], langs: list[str], seed: int = 8) -> Crf | None:
    """Maximum likelihood of mixed sequences, by full-batch gradient steps with a rate per weight."""
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    position = {name: i for i, name in enumerate(labels)}
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # emissions are computed per slice, over its words
    segments: list[np.ndarray] = []
    label_of: list[int] = []
    shift = 0
    for words in slices(pa.array(texts, pa.string())):
        bounds = words.bounds
        _, once, back = np.unique(words.key, return_index=True, return_inverse=True)
        for r in range(words.rows):
            lang = position[langs[words.first + r]]
            at = bounds[r]
            while at < bounds[r + 1]:
                size = int(rng.integers(4, 20))
                segments.append(back[at : min(at + size, bounds[r + 1])] + shift)
                label_of.append(lang)
                at += size
        parts.append(_features(words.data, words.start[once], words.end[once], words.key[once]))
        shift += len(once)
    if not segments:
        return None
    counts = np.cumsum([0, *[len(p[0]) for p in parts]])
    features = (
        np.concatenate([p[0] for p in parts]),
        np.concatenate([p[1] for p in parts]),
        np.concatenate([p[2] + c for p, c in zip(parts, counts)]),
    )
    order = rng.permutation(len(segments))
    word = np.concatenate([segments[i] for i in order])
    gold = np.concatenate([np.full(len(segments[i]), label_of[i]) for i in order])
    fixed, gram, owner = features
    n, size, k = len(word), 1 << HASH_BITS, len(labels)
    bounds = np.r_[np.arange(0, n, SEQUENCE), n]
    share = NGRAM_SCALE / np.maximum(np.bincount(owner, minlength=len(fixed)), 1)
    weights = np.zeros((size, k), dtype=np.float64)
    transition, start = np.zeros((k, k)), np.zeros(k)
    seen = [np.full_like(x, 1e-6) for x in (weights, transition, start)]
    inner = np.ones(n, dtype=bool)
    inner[bounds[:-1]] = False
    follow = np.flatnonzero(inner)
    truth = np.zeros((n, k))
    truth[np.arange(n), gold] = 1
    real_pairs = np.bincount(gold[follow - 1] * k + gold[follow], minlength=k * k).reshape(k, k)
    for _ in range(EPOCHS):
        emission = _emission(weights, features)[word]
        gamma = forward_backward(emission, bounds, transition, start)
        diff = np.zeros((len(fixed), k))
        for c in range(k):
            diff[:, c] = np.bincount(word, (truth - gamma)[:, c], minlength=len(fixed))
        grad = np.zeros_like(weights)
        for c in range(k):
            for f in range(fixed.shape[1]):
                grad[:, c] += np.bincount(fixed[:, f], diff[:, c], minlength=size)
            if len(gram):
                grad[:, c] += np.bincount(gram, (diff[:, c] * share)[owner], minlength=size)
        pair = _pair_expectation(emission, gamma, follow, transition)
        grads = [grad / n - DECAY * weights, (real_pairs - pair) / n, (truth - gamma)[bounds[:-1]].sum(0) / n]
        for x, g, s in zip((weights, transition, start), grads, seen):
            s += g * g
            x += RATE * g / np.sqrt(s)
    return Crf(labels, weights.astype(np.float32), transition, start)


def _pair_expectation(emission, gamma, follow, transition) -> np.ndarray:
    """Expected label pairs of neighbours, from the marginals of both and the transition weights."""
    if not len(follow):
        return np.zeros_like(transition)
    joint = gamma[follow - 1][:, :, None] * gamma[follow][:, None, :] * np.exp(transition)[None]
    for _ in range(3):  # scaled until both marginals hold
        joint *= (gamma[follow - 1] / np.maximum(joint.sum(2), 1e-300))[:, :, None]
        joint *= (gamma[follow] / np.maximum(joint.sum(1), 1e-300))[:, None, :]
    return joint.sum(0)


_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True


def predict(model: Crf | None, column: pa.Array):
    """Label, score, words and switches of each text of a column."""
    n = len(column)
    label, score = [UNKNOWN] * n, np.zeros(n)
    words_of, switches = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if model is None or n == 0:
        return label, score, words_of, switches
    emissions, rows, lettered = [], [], []
    for words in slices(column):
        _, first, back = np.unique(words.key, return_index=True, return_inverse=True)
        distinct = _emission(model.weights, _features(words.data, words.start[first], words.end[first], words.key[first]))
        emissions.append(distinct[back])
        rows.append(words.row + words.first)
        lettered.append(_has_letter(words, first)[back])
    emission, row = np.concatenate(emissions), np.concatenate(rows)
    letter = np.concatenate(lettered)
    bounds = np.searchsorted(row, np.arange(n + 1))
    gamma = forward_backward(emission, bounds, model.transition, model.start)
    k = len(model.labels)
    counted = np.bincount(row[letter], minlength=n)
    mass = np.stack([np.bincount(row[letter], gamma[letter, c], minlength=n) for c in range(k)], 1)
    best = mass.argmax(1)
    words_of[:] = np.diff(bounds)
    hard = gamma.argmax(1)
    turn = np.flatnonzero((hard[1:] != hard[:-1]) & (row[1:] == row[:-1]))
    switches += np.bincount(row[turn], minlength=n)
    for i in np.flatnonzero(counted):
        label[i] = model.labels[best[i]]
        score[i] = min(1.0, mass[i, best[i]] / counted[i])
    return label, score, words_of, switches


def _has_letter(words: Words, at: np.ndarray) -> np.ndarray:
    """Which of the words have a letter of any script."""
    total = np.r_[0, np.cumsum(_LETTER[words.data])]
    plain = total[words.end[at]] > total[words.start[at]]
    for i in np.flatnonzero(~plain):
        plain[i] = any(c.isalpha() for c in words.text(at[i]))
    return plain


def labelled_sample(docs: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str]]:
    """At most so many texts per language outside the held-out part, of each so many characters from a seeded place.

    Only texts with a letter take places, and of the rows of one doc_id only one does: the first by
    language and digest. A text that is not longer than the piece is taken whole.
    """
    usable = docs.where((crc_mod(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    pick = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", "lang").withColumn("place", F.dense_rank().over(pick)).where(F.col("place") <= texts)
    ids = [r[0] for r in chosen.select("doc_id").distinct().collect()]  # at most `texts` for each language
    first = F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.greatest(F.lit(1), F.length("text") - chars + 1)) + 1
    piece = F.substring("text", first.cast("int"), F.lit(chars))
    rows = (
        usable.where(F.col("doc_id").isin(ids))
        .groupBy("doc_id")
        .agg(F.min(F.struct("lang", F.md5("text").alias("digest"), piece.alias("text"))).alias("row"))
        .select("doc_id", "row.lang", "row.text")
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def identify_languages(docs: DataFrame, model: Crf | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds lang_pred, score, n_words and n_switches to every row."""
    fields = [("lang_pred", "string"), ("score", "double"), ("n_words", "long"), ("n_switches", "long")]
    return append(docs, lambda batch: predict(model, batch.column(text_col)), fields, prefix)


def trained(docs: DataFrame) -> Crf | None:
    return fit(*labelled_sample(docs))


def op8_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark, 1500).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify_languages(docs.select("doc_id", "text"), trained(docs))
    return found.select(
        "doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "n_words", "n_switches"
    )
