"""Personal data: fixed detectors, and a semi-Markov conditional random field that adds spans.

The fixed detectors find email, ip, card and phone in whole texts. The field reads the
stretches that hold a candidate, a segment of bounded length with four digits or an
address mark in any case, so it finds what it would find in the whole text. Candidates
are scored with features of the whole span (digit groups, checksum, shape, neighbours),
and a forward-backward pass over all segmentations chooses boundaries and kinds
together. A span is added when its posterior is high and it overlaps no
fixed one, so forms such as `name (at) host (dot) org`, `(743) 555-3824` or
`10[.]1[.]2[.]3` are found too. The field is trained on seeded, generated examples.

Nulls and edge cases: a null or empty text has no spans. Offsets count code points,
end exclusive. Texts of any length are read whole; the scans are linear. Repeated rows
get equal results. An input column named like an added one is replaced.
"""

from __future__ import annotations

import math
import random
import re
import sys
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import append, prepare

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

# The base patterns; fixed values of the contract, written so that scans stay linear.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SEPARATORS = str.maketrans("", "", " -")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        low = domain.end() if domain else at + 1
        if domain:
            out.append((start, low))
        at = text.find("@", low)
    return out


def _digit_count(text: str) -> int:
    return sum(c.isdigit() for c in text)


def base_spans(text: str | None) -> list[Span]:
    """The fixed spans, by kind and start."""
    if not text:
        return []
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().translate(_SEPARATORS)
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= _digit_count(m.group()) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


# ---- the semi-Markov field

MAX_TOKENS = 23  # longest entity
ADD_AT = 0.95
LEAST_ODDS = math.log(ADD_AT / (1 - ADD_AT)) - 1e-6
EXAMPLES, ROUNDS, RATE, DECAY = 300, 7, 0.4, 1e-4

# Where a candidate may be: an at sign, the word at in any case, or four digits without a letter between them.
_AT = re.compile(r"@|[aA][tT](?![^\W\d_])(?<![^\W\d_]..)", re.DOTALL)
_FOUR = re.compile(r"[0-9](?:[^A-Za-z\n,;:\"'0-9]*[0-9]){3}[0-9]*+")
# Texts with other numerals; a token such as x² has letters but is no word, so theirs passes over letters.
_NUMERALS = frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha())
_ANY = "0-9" + "".join(sorted(c for c in _NUMERALS if c.isdigit()))
_FOUR_OF_ANY = re.compile(rf"[{_ANY}](?:[^\n,;:\"'{_ANY}]*[{_ANY}]){{3}}[{_ANY}]*+")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.DOTALL)
_JOINERS = set(" .-()[]{}+@_%/")
_AT_WORDS, _DOT_WORDS = {"at"}, {"dot"}
# Up to MAX_TOKENS tokens that may stand in a candidate; the same pattern reads a reversed text.
_USABLE = re.compile(rf"(?:[^\W\d_]++|[0-9]++|\d|(?!\n)\s(?!\s)|[.()\[\]{{}}+@_%/-]){{0,{MAX_TOKENS}}}+")


def _class_of(token: str) -> str:
    if token.isdigit():
        return "9"
    if token.isspace():
        return " "
    return "a" if token.isalpha() else token[:1]


def _bucket(n: int) -> str:
    for top in (0, 3, 6, 7, 9, 10, 12, 15, 16, 19):
        if n <= top:
            return str(top)
    return "more"


def span_features(tokens: list[str], i: int, j: int) -> list[str]:
    """Features of the whole candidate segment tokens[i:j] and of what stands around it."""
    part = tokens[i:j]
    groups = [t for t in part if t.isdigit()]
    digits = "".join(groups)
    words = [t.lower() for t in part if t.isalpha()]
    marks = "".join(t for t in part if not t.isdigit() and not t.isalpha() and not t.isspace())
    at = "@" in marks or bool(_AT_WORDS & set(words))
    dots = marks.count(".") + sum(w in _DOT_WORDS for w in words)
    shape = "".join(_class_of(t) for t in part)
    before = tokens[i - 1] if i else "^"
    after = tokens[j] if j < len(tokens) else "$"
    return [
        "digits:" + _bucket(len(digits)),
        "groups:" + "-".join(str(min(len(g), 9)) for g in groups[:7]) + f"/{min(len(groups), 8)}",
        "shape:" + shape if len(shape) < 16 else "shape:long",
        f"marks:{''.join(sorted(set(marks)))}",
        f"first:{_class_of(part[0])}",
        f"last:{_class_of(part[-1])}",
        f"at:{at}/dots:{min(dots, 4)}/words:{bool(words)}",
        f"luhn:{13 <= len(digits) <= 19 and luhn(digits)}/{_bucket(len(digits))}/{bool(words)}",
        f"bytes:{len(groups) == 4 and all(len(g) <= 3 and g.isdecimal() and int(g) <= 255 for g in groups)}/{min(dots, 4)}/{at}",
        f"tail:{at and part[-1].isalpha() and 2 <= len(part[-1]) <= 6}/{bool(dots)}",
        f"before:{_class_of(before)}",
        f"after:{_class_of(after)}",
        f"edges:{_class_of(before)}{_class_of(part[0])}{_class_of(part[-1])}{_class_of(after)}",
    ]


def _token_features(token: str) -> list[str]:
    return ["one:" + _class_of(token)]


def candidates(tokens: list[str]) -> list[tuple[int, int]]:
    """Segments that may be an entity: bounded, trimmed, and holding enough digits or an address mark."""
    out = []
    n = len(tokens)
    begins = [t[0] in "+(" or t[0].isalnum() for t in tokens]
    ends = [t[0].isalnum() for t in tokens]
    count = np.cumsum([0, *[len(t) if t.isdigit() else 0 for t in tokens]])
    mark = np.cumsum([0, *[t == "@" or t.lower() in _AT_WORDS for t in tokens]])
    usable = [t.isalnum() or t.isspace() and "\n" not in t and len(t) == 1 or t in _JOINERS for t in tokens]
    for i in range(n):
        if not begins[i] or i and tokens[i - 1][0].isalnum() and tokens[i][0].isalnum():
            continue
        letters = 0
        for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
            t = tokens[j - 1]
            if not usable[j - 1]:
                break
            letters += t.isalpha()
            marked = mark[j] > mark[i]
            if letters and not marked and count[j] - count[i] > 6 and letters > 2:
                break
            if ends[j - 1] and (marked and letters or count[j] - count[i] >= 4 and not letters):
                out.append((i, j))
    return out


@dataclass
class SemiCrf:
    index: dict[str, int]
    weights: np.ndarray  # feature x (outside, kinds...)
    transition: np.ndarray

    def lattice(self, tokens: list[str]):
        """Edges (i, j, scores by label, features) from the start of a token to the end of a segment.

        An edge outside all entities has one number as its score, that of label 0.
        """
        get = self.index.get
        edges = []
        for i, t in enumerate(tokens):
            ids = [k for k in map(get, _token_features(t)) if k is not None]
            edges.append((i, i + 1, float(self.weights[ids, 0].sum()), ids))
        for i, j in candidates(tokens):
            ids = [k for k in map(get, span_features(tokens, i, j)) if k is not None]
            score = self.weights[ids].sum(0)
            score[0] = -np.inf
            edges.append((i, j, score, ids))
        edges.sort(key=lambda e: e[:2])
        return edges

    def posteriors(self, tokens: list[str], edges):
        """The label probabilities of each edge."""
        n, k = len(tokens), len(KINDS) + 1
        step = np.exp(self.transition)
        alpha = np.full((n + 1, k), -np.inf)
        alpha[0, 0] = 0.0
        enter = np.empty((n + 1, k))
        done = -1
        for i, j, score, _ in edges:
            if i != done:
                top = alpha[i].max()
                enter[i] = np.log(np.exp(alpha[i] - top) @ step) + top
                done = i
            if isinstance(score, float):
                alpha[j, 0] = _log_add(alpha[j, 0], enter[i, 0] + score)
            else:
                alpha[j] = np.logaddexp(alpha[j], enter[i] + score)
        beta = np.full((n + 1, k), -np.inf)
        beta[n] = 0.0
        gain = np.full((n + 1, k), -np.inf)  # value of starting a segment of each label here
        last = n
        for i, j, score, _ in reversed(edges):
            if i != last:
                if last < n:
                    self._settle(beta, gain, last, step)
                last = i
            if isinstance(score, float):
                gain[i, 0] = _log_add(gain[i, 0], beta[j, 0] + score)
            else:
                gain[i] = np.logaddexp(gain[i], score + beta[j])
        z = np.logaddexp.reduce(alpha[n])
        out = []
        for i, j, score, _ in edges:
            if isinstance(score, float):
                p = np.zeros(k)
                p[0] = math.exp(min(0.0, enter[i, 0] + score + beta[j, 0] - z))
                out.append(p)
            else:
                out.append(np.exp(enter[i] + score + beta[j] - z))
        return out

    @staticmethod
    def _settle(beta, gain, at, step) -> None:
        top = gain[at].max()
        beta[at] = np.log(step @ np.exp(gain[at] - top)) + top


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(["an", "er", "th", "ing", "re", "lo", "ma", "ti", "on", "es"]) for _ in range(rng.randint(1, 4)))


def _card_number(rng: random.Random, ok: bool, n: int = 16) -> str:
    while True:
        digits = str(rng.randint(1, 9)) + "".join(str(rng.randint(0, 9)) for _ in range(n - 1))
        if luhn(digits) == ok:
            return digits


def _entity(rng: random.Random) -> tuple[str, str]:
    """A generated entity and its kind."""
    kind = rng.choice(KINDS)
    d = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))
    if kind == "email":
        at, dot = rng.choice([("@", "."), (" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), (" AT ", " DOT "), ("[at]", "[dot]"), (" @ ", ".")])
        name = _word(rng) + rng.choice(["", "." + _word(rng), d(2), "." + d(2)]) if at == "@" else _word(rng) + rng.choice(["", d(2)])
        return name + at + _word(rng) + dot + rng.choice(["com", "org", "net", "example" + dot + "com"]), kind
    if kind == "ip":
        return rng.choice([".", ".", "[.]", "(.)"]).join(str(rng.randint(0, 255)) for _ in range(4)), kind
    if kind == "card":
        digits = _card_number(rng, True)
        mark = rng.choice(["", " ", "-", ".", "/"])
        return mark.join(digits[i : i + 4] for i in range(0, 16, 4)), kind
    form = rng.choice(["+1 ({}) {}-{}", "({}) {}-{}", "({}) {}-{}", "{}-{}-{}", "+49 {} {}{}", "{}.{}.{}"])
    return form.format(rng.randint(200, 999), d(3), d(4)), kind


def _decoy(rng: random.Random) -> str:
    """A number or mark that is no personal data."""
    d = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))
    return rng.choice(
        [
            f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
            f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}",
            f"{rng.randint(0, 23)}:{d(2)}:{d(2)}",
            f"{rng.randint(1, 999)}.{d(2)}",
            f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
            f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{d(3)}.{d(3)}",
            f"{rng.randint(1, 99)},{d(3)},{d(3)}",
            f"{d(4)}-{d(4)}",
            d(rng.randint(2, 8)),
            d(rng.randint(20, 30)),
            _card_number(rng, False),
            d(9),
            d(11),
            d(13),
            "".join(rng.choice("0123456789abcdef") for _ in range(40)),
            f"{d(3)}-{d(2)}",
            f"({rng.randint(1900, 2030)}) {d(2)}-{d(2)}",
            f"{d(4)} {d(4)} {d(4)}",
            f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}",
            f"{_word(rng)} at {_word(rng)}",
            f"{_word(rng)} AT THE {_word(rng).upper()}",
            f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
            "@" + _word(rng),
            f"{_word(rng)} @ {d(2)}",
            f"{d(5)}-{d(4)}",
            f"{d(10)}",
            f"{d(3)} {d(3)} {d(4)}",
        ]
    )


def examples(count: int, seed: int = 1) -> list[tuple[str, list[Span]]]:
    """Generated texts with their entities."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            for _ in range(rng.randint(1, 3)):
                text += _word(rng) + rng.choice([" ", " ", ", ", ". ", " = \"", "### ", ": ", "\n"])
            if rng.random() < 0.5:
                value, kind = _entity(rng)
                spans.append((KINDS.index(kind), len(text), len(text) + len(value)))
                text += value
            else:
                text += _decoy(rng)
            text += rng.choice([" ", " ", ", ", ". ", "\" ", "###", "\n", "$$$ "])
        out.append((text + _word(rng), spans))
    return out


def tokenize(text: str) -> tuple[list[str], list[int]]:
    found = list(_TOKEN.finditer(text))
    return [m.group() for m in found], [*[m.start() for m in found], len(text)]


@lru_cache(maxsize=1)
def trained(seed: int = 1) -> SemiCrf:
    """The field fitted to the generated examples by stochastic ascent of the conditional likelihood."""
    index: dict[str, int] = {}
    data = []
    for text, spans in examples(EXAMPLES, seed):
        tokens, starts = tokenize(text)
        gold = {(starts.index(a), starts.index(b)): k + 1 for k, a, b in spans if a in starts and b in starts}
        for i, j in candidates(tokens):
            for f in span_features(tokens, i, j):
                index.setdefault(f, len(index))
        for t in tokens:
            for f in _token_features(t):
                index.setdefault(f, len(index))
        if all(g in set(candidates(tokens)) for g in gold):
            data.append((tokens, gold))
    k = len(KINDS) + 1
    model = SemiCrf(index, np.zeros((len(index), k)), np.zeros((k, k)))
    seen = np.full((len(index), k), 1e-3)
    rng = random.Random(seed)
    for _ in range(ROUNDS):
        rng.shuffle(data)
        for tokens, gold in data:
            edges = model.lattice(tokens)
            probability = model.posteriors(tokens, edges)
            inside = np.zeros(len(tokens), dtype=bool)
            for i, j in gold:
                inside[i:j] = True
            for (i, j, score, ids), p in zip(edges, probability):
                wish = np.zeros(k)
                if not isinstance(score, float):
                    if (i, j) in gold:
                        wish[gold[i, j]] = 1
                else:
                    wish[0] = not inside[i]
                step = wish - p
                if np.abs(step).max() > 1e-3:
                    grad = step - DECAY * model.weights[ids]
                    seen[ids] += grad * grad
                    model.weights[ids] += RATE * grad / np.sqrt(seen[ids])
    return model


class Finder:
    """Adds the field's spans to the fixed ones; equal stretches are scored once while they are remembered."""

    REMEMBERED, LONGEST = 20_000, 1_000

    def __init__(self, model: SemiCrf):
        self.model = model
        self.memory: dict[str, list[tuple[int, int, int, float]]] = {}
        self.best: dict[str, float] = {}
        self.single: dict[str, float] = {}

    def stretches(self, text: str) -> list[tuple[int, int]]:
        """The parts of a text that hold every candidate, each with a token around it."""
        out: list[tuple[int, int]] = []
        four = _FOUR if text.isascii() or _NUMERALS.isdisjoint(text) else _FOUR_OF_ANY
        for low, high in sorted([m.span() for m in _AT.finditer(text)] + [m.span() for m in four.finditer(text)]):
            inside = bool(out) and low < out[-1][1]
            low, high = low if inside else grown_left(text, low), grown_right(text, high)
            if out and low < out[-1][1]:
                out[-1] = (out[-1][0], max(high, out[-1][1]))
            else:
                out.append((low, high))
        return out

    def scored(self, stretch: str) -> list[tuple[int, int, int, float]]:
        known = self.memory.get(stretch)
        if known is None:
            tokens, starts = tokenize(stretch)
            known = []
            for low, high in self.open_parts(tokens):
                first = max(0, low - 1)
                part = tokens[first : high + 1]
                edges = self.model.lattice(part)
                probability = self.model.posteriors(part, edges)
                for (i, j, score, _), p in zip(edges, probability):
                    kind = int(p.argmax())
                    if kind and p[kind] >= ADD_AT:
                        known.append((kind - 1, starts[first + i], starts[first + j], float(p[kind])))
            if len(stretch) <= self.LONGEST:
                if len(self.memory) >= self.REMEMBERED:
                    self.memory.clear()
                self.memory[stretch] = known
        return known

    def open_parts(self, tokens: list[str]) -> list[tuple[int, int]]:
        """The parts, each of candidates that overlap, in which one may reach ADD_AT.

        The sum over all segmentations holds a candidate's own and the same with its tokens outside
        all entities, so its posterior is at most w / (w + outside). Labels do not act on one
        another here, so parts without a common candidate are independent.
        """
        codes = "".join(map(_code, tokens))
        outside = [0.0]
        for t in tokens:
            c = _class_of(t)
            if c not in self.single:
                k = self.model.index.get("one:" + c)
                self.single[c] = 0.0 if k is None else float(self.model.weights[k, 0])
            outside.append(outside[-1] + self.single[c])
        if "9" not in codes and "?" not in codes and not self.may_address(tokens, codes, outside):
            return []
        parts: list[list] = []
        for i, j in candidates(tokens):
            if parts and i < parts[-1][1]:
                parts[-1][1] = max(j, parts[-1][1])
            else:
                parts.append([i, j, False])
            if not parts[-1][2] and self.best_of(tokens, codes, i, j) - (outside[j] - outside[i]) >= LEAST_ODDS:
                parts[-1][2] = True
        return [(i, j) for i, j, may in parts if may]

    def may_address(self, tokens: list[str], codes: str, outside: list[float]) -> bool:
        """Whether a candidate of a stretch without digits may reach ADD_AT."""
        for m in re.finditer("[@t]", codes):
            at = m.start()
            low = max(codes.rfind("\n", 0, at) + 1, at + 1 - MAX_TOKENS)
            high = codes.find("\n", at)
            begins = [i for i in range(low, at + 1) if codes[i] in "atd+("]
            ends = [j for j in range(at + 1, min(len(codes) if high < 0 else high, at + MAX_TOKENS) + 1) if codes[j - 1] in "atd"]
            for i in begins:
                least = LEAST_ODDS - outside[i]
                for j in ends:
                    if j > i + MAX_TOKENS:
                        break
                    if self.best_of(tokens, codes, i, j) >= least + outside[j]:
                        return True
        return False

    def best_of(self, tokens: list[str], codes: str, i: int, j: int) -> float:
        """The highest score of a candidate over the kinds, remembered by all that its features know of it."""
        last = tokens[j - 1]
        key = (codes[i - 1] if i else "^") + codes[i:j] + (codes[j] if j < len(codes) else "$") + ("s" if 2 <= len(last) <= 6 else "")
        whole = not ("9" in key or "?" in key or "\n" in key)
        best = self.best.get(key) if whole else None
        if best is None:
            ids = [k for k in map(self.model.index.get, span_features(tokens, i, j)) if k is not None]
            best = float(self.model.weights[ids].sum(0)[1:].max())
            if whole:
                if len(self.best) >= self.REMEMBERED:
                    self.best.clear()
                self.best[key] = best
        return best

    def spans(self, text: str | None) -> tuple[list[Span], list[tuple[int, int, int, float]]]:
        """Fixed spans, and the added ones with their posterior, which meet no fixed one and none added before."""
        base = base_spans(text)
        added: list[tuple[int, int, int, float]] = []
        if text:
            taken = Taken()
            for _, a, b in sorted(base, key=lambda span: span[1:]):
                taken.join(a, b)
            for low, high in self.stretches(text):
                for kind, a, b, p in self.scored(text[low:high]):
                    if taken.free(a + low, b + low):
                        taken.join(a + low, b + low)
                        added.append((kind, a + low, b + low, p))
        return base, added


class Taken:
    """Places of a text that are taken, as disjoint intervals in order; places are found by bisection."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        k = bisect_right(self.ends, a)
        return k == len(self.starts) or self.starts[k] >= b

    def join(self, a: int, b: int) -> None:
        """Takes a place; intervals it meets become one with it."""
        k = last = bisect_right(self.ends, a)
        while last < len(self.starts) and self.starts[last] < b:
            a, b, last = min(a, self.starts[last]), max(b, self.ends[last]), last + 1
        self.starts[k:last], self.ends[k:last] = [a], [b]


def _code(token: str) -> str:
    """A token as one character: words, the address words, digits, usable marks, others without a form, and what ends a candidate."""
    if token.isalpha():
        word = token.lower()
        return "t" if word in _AT_WORDS else "d" if word in _DOT_WORDS else "a"
    if token.isdigit():
        return "9"
    if token in _JOINERS:
        return token
    if token.isalnum():
        return "?"
    return " " if token.isspace() and "\n" not in token and len(token) == 1 else "\n"


def grown_right(text: str, at: int) -> int:
    """The end of what a candidate from before a place can reach, with the token after it."""
    high = _USABLE.match(text, at).end()
    after = _TOKEN.match(text, high)
    return after.end() if after else high


def grown_left(text: str, at: int) -> int:
    """The begin of what a candidate to beyond a place can reach, with the token before it."""
    size = 256
    while True:
        low = max(0, at - size)
        back = text[low:at][::-1]
        used = _USABLE.match(back).end()
        before = _TOKEN.match(back, used)
        used = before.end() if before else used
        if used < len(back) or low == 0:
            return at - used
        size *= 4


FIELDS = [("spans", "array<struct<kind:string,start:int,end:int,score:double>>")]


def find_personal_data(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds spans, by kind and start; the fixed ones have score 2 and the added ones their posterior."""
    model = trained()
    finders: list[Finder] = []

    def run(batch):
        if not finders:
            finders.append(Finder(model))
        out = []
        for text in batch.column(text_col).to_pylist():
            base, added = finders[0].spans(text)
            rows = sorted([(*s, 2.0) for s in base] + added)
            out.append([{"kind": KINDS[k], "start": a, "end": b, "score": p} for k, a, b, p in rows])
        return [out]

    return append(docs, run, FIELDS, prefix)


def mask_personal_data(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans become one.

    The length column, where there is one, is counted anew; a null text stays null.
    """
    model = trained()
    finders: list[Finder] = []

    def run(batch):
        if not finders:
            finders.append(Finder(model))
        return [[masked(text, finders[0]) for text in batch.column(text_col).to_pylist()]]

    out = append(docs, run, [("text", "string")], "_masked_").withColumn(text_col, F.col("_masked_text"))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)


def masked(text: str | None, finder: Finder) -> str | None:
    if text is None:
        return None
    base, added = finder.spans(text)
    parts, at = [], 0
    for a, b, kind in sorted((s[1], s[2], s[0]) for s in [*base, *added]):
        if a >= at:
            parts += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*parts, text[at:]]) if parts else text


def op1_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_personal_data(docs).drop("text")
    # A posterior is at most 1; fixed spans carry 2 so that both are told apart.
    fixed = F.filter("spans", lambda s: s["score"] > 1)
    line = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of_kind = lambda kind: F.size(F.filter(fixed, lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(line(fixed), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(fixed)).cast("long").alias("n_added"),
    )
