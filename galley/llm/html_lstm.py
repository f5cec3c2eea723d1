"""HTML extraction: a bidirectional LSTM labels the leaf blocks of a page with document-wide context.

A page is cut into leaf blocks, the text between two block-level marks, each with its tag path.
A block's vector has the hashed tags, classes and ids of its path, its hashed words
and a few shares (links, length, marks). The network reads the blocks of a page in both
directions and labels each as main text or not. It is trained here, on seeded generated
pages of many layouts: menus, headers, footers, sidebars, notices, adverts, forms and
reader comments around and inside the article.

Nulls and edge cases: a null or empty page, and one without main text, gives an empty text.
Marks that do not close are closed by their parents or at the end. Of the elements whose content is no text, an open head
ends before the body or what cannot stand in a head, an open script or style at the end, and the others with their parent;
in the body itself, and for svg anywhere, also at the next block-level mark. Text outside any mark is a block.
Pages of any length are read whole. Repeated rows give equal results. An input column named like an added one is replaced.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import append, prepare

PATH_SIZE, WORD_SIZE = 96, 48
NUMBERS = 8
WORD_ROWS = 4096
SIZE = PATH_SIZE + WORD_SIZE + NUMBERS
HIDDEN = 24
PAGES, EPOCHS, BATCH, RATE = 1600, 14, 32, 0.01
KEEP = 0.5

# Elements whose content is no text, that break a block, and that have no end mark.
SKIPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head"}
RAW = {"script", "style"}
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
BREAKS = set(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {
    "p": BREAKS - {"br"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "option": {"option"},
}

_OPENING = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTES = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", re.DOTALL)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN_MARK = re.compile(r"\shidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)

class Path:
    """The names along the path of a block; what it shares with its parents is stored once and summed once."""

    __slots__ = ("parent", "own", "total")

    def __init__(self, parent: "Path | None", own: tuple[str, ...]):
        self.parent, self.own, self.total = parent, own, None

    @property
    def names(self) -> tuple[str, ...]:
        out: list[str] = []
        at: Path | None = self
        while at is not None:
            out += reversed(at.own)
            at = at.parent
        return tuple(reversed(out))

    def vector(self) -> np.ndarray:
        """The sum of the hashed names, and the last name once more; summed down from the nearest known parent."""
        chain: list[Path] = []
        at: Path | None = self
        while at is not None and at.total is None:
            chain.append(at)
            at = at.parent
        total = np.zeros(PATH_SIZE) if at is None else at.total
        for path in reversed(chain):
            total = total.copy()
            for name in path.own:
                total += _hashed(name, PATH_SIZE)
            path.total = total
        return total + _hashed("last " + self.own[-1], PATH_SIZE)


Block = tuple[str, "Path | None", float]  # text, path, share of characters in links


class _Open:
    """The open marks of a page, with the places of each name, so that nothing searches the whole stack."""

    SCOPES = {"table", "ul", "ol", "dl", "select", "div", "section", "article", "blockquote", "td"}

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.paths: list[Path] = []
        self.places: dict[str, list[int]] = {}
        self.skipped: list[int] = []
        self.scopes: list[int] = []

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        depth = len(self.tags)
        self.tags.append(tag)
        self.paths.append(Path(self.paths[-1] if self.paths else None, (tag, *names)))
        self.places.setdefault(tag, []).append(depth)
        if tag in SKIPPED:
            self.skipped.append(depth)
        if tag in self.SCOPES:
            self.scopes.append(depth)

    def cut(self, depth: int) -> None:
        """Removes the marks from a depth on."""
        while len(self.tags) > depth:
            tag = self.tags.pop()
            self.paths.pop()
            self.places[tag].pop()
            if tag in SKIPPED:
                self.skipped.pop()
            if tag in self.SCOPES:
                self.scopes.pop()

    def last(self, tag: str) -> int | None:
        held = self.places.get(tag)
        return held[-1] if held else None

    def closed_by(self, tag: str) -> int | None:
        """The first place that a mark closes without an end mark of its own."""
        scope = self.scopes[-1] if self.scopes else -1
        found = []
        for name, closers in CLOSED_BY.items():
            held = self.places.get(name)
            if not held or tag not in closers:
                continue
            if name in ("td", "th") and tag in ("td", "th", "tr") and self.tags[scope] != "table":
                found.append(held[0])
            else:
                inner = bisect_right(held, scope)
                if inner < len(held):
                    found.append(held[inner])
        return min(found, default=None)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, in time linear in the page."""
    if not page:
        return []
    out: list[Block] = []
    stack = _Open()
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            out.append((text, stack.paths[-1] if stack.paths else None, min(1.0, linked / len(text))))
        held.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if text and not stack.skipped:
            held.append(text)
            if stack.places.get("a"):
                linked += len(text)

    def close(at: int) -> None:
        if any(tag in BREAKS for tag in stack.tags[at:]):
            flush()
        stack.cut(at)

    marks = _marks(page)
    ends = _skipped_ends(page, marks)
    at, k = 0, 0
    while k < len(marks):
        start, end, tag, closing, rest = marks[k]
        take(page[at:start])
        at = end
        k += 1
        if not tag:
            continue
        if closing:
            depth = stack.last(tag)
            if depth is not None:
                close(depth)
            continue
        if k - 1 in ends:
            if tag == "head":
                flush()
            at, k = ends[k - 1]
            continue
        if tag in BREAKS:
            if stack.skipped:
                left_open = stack.skipped[0]
                if stack.tags[left_open] == "svg" or all(name in ("html", "body") for name in stack.tags[:left_open]):
                    close(left_open)
            flush()
            inner = stack.closed_by(tag)
            if inner is not None:
                stack.cut(inner)
        if tag not in VOID and not rest.rstrip().endswith("/"):
            names = [w.lower() for m in _NAMES.finditer(rest) for w in re.split(r"[^A-Za-z0-9]+", "".join(filter(None, m.groups()))) if w]
            if _HIDDEN_MARK.search(rest):
                names.append("hidden")
            if tag in SKIPPED:  # left open: it ends with what it stands in
                flush()
            stack.push(tag, tuple("." + w for w in names))
    take(page[at:])
    flush()
    return out


Mark = tuple[int, int, str, bool, str]  # start, end, name or nothing, whether it closes, attributes


def _marks(page: str) -> list[Mark]:
    """The marks of a page in order; a script or style is one mark with its content.

    Left open, a script or style runs to the end of the page, or of the skipped element around it.
    """
    out: list[Mark] = []
    inside: Counter[str] = Counter()
    known: dict[str, tuple[int, int]] = {}
    n = len(page)

    def next_end(tag: str, at: int) -> tuple[int, int]:
        if known.get(tag, (-1, -1))[0] < at:
            found = _end_of(tag).search(page, at)
            known[tag] = found.span() if found else (n, n)
        return known[tag]

    closers = _Closers(page)
    at = seek = 0
    while mark := _OPENING.search(page, seek):
        start, head = mark.start(), mark.group()
        if head == "<!--" or head == "<![CDATA[":
            stop = "-->" if head == "<!--" else "]]>"
            found = page.find(stop, mark.end())
            end = n if found < 0 else found + len(stop)
        elif mark.group(2):
            end = closers.after(mark.end())
        else:
            end = closers.plain(mark.end())
        if end < 0:  # it never closes, so it is text
            seek = start + 1
            continue
        tag, rest = (mark.group(2) or "").lower(), page[mark.end() : end - 1] if mark.group(2) else ""
        at = end
        if tag in SKIPPED and not rest.rstrip().endswith("/"):
            if mark.group(1):
                inside[tag] = max(0, inside[tag] - 1)
            elif tag in RAW:
                low, high = next_end(tag, at)
                around = min((next_end(name, at)[0] for name, held in inside.items() if held), default=n)
                if around < low and (low == n or _start_of(tag).search(page, around, low)):
                    high = around
                at = high
            else:
                inside[tag] += 1
        out.append((start, at, tag, bool(mark.group(1)), rest))
        seek = at
    return out


class _Closers:
    """Where a mark ends: at the first > outside quotes.

    The pattern finds it at once on ordinary pages. Where it fails, which costs a run to the end of the page, the ends
    after every quote and > are worked out from right to left, once for the page.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.spots: list[int] | None = None
        self.ends: list[int] = []

    def plain(self, at: int) -> int:
        return self.page.find(">", at) + 1 if at <= self.last else -1

    def after(self, at: int) -> int:
        if at > self.last:
            return -1
        if self.spots is None:
            found = _ATTRIBUTES.match(self.page, at)
            if found:
                return found.end()
            self._tabulate()
        k = bisect_left(self.spots, at)
        return self.ends[k] if k < len(self.spots) else -1

    def _tabulate(self) -> None:
        self.spots = [m.start() for m in re.finditer("[>\"']", self.page)]
        self.ends = [-1] * len(self.spots)
        after = {}  # the number of the next quote of each kind
        for k in range(len(self.spots) - 1, -1, -1):
            mark = self.page[self.spots[k]]
            if mark == ">":
                self.ends[k] = self.spots[k] + 1
                continue
            partner = after.get(mark, -1)
            if 0 <= partner < len(self.spots) - 1:
                self.ends[k] = self.ends[partner + 1]
            after[mark] = k


def _skipped_ends(page: str, marks: list[Mark]) -> dict[int, tuple[int, int]]:
    """The place and the next mark after each skipped element, by the number of its start mark.

    Elements that are left open are not in it, but for the head: it ends before the body, or before the
    first text or mark that cannot stand in a head.
    """
    ends: dict[int, tuple[int, int]] = {}
    begun: dict[str, list[int]] = {}
    heads: list[int] = []
    for k, (_, end, tag, closing, rest) in enumerate(marks):
        if tag == "body" and not closing:
            begun.pop("head", None)  # an end mark after the body is not that of the head
        if tag not in SKIPPED or not closing and rest.rstrip().endswith("/"):
            if tag in SKIPPED:
                ends[k] = (end, k + 1)
        elif tag in RAW:
            if not closing:
                ends[k] = (end, k + 1)
        elif closing:
            if begun.get(tag):
                ends[begun[tag].pop()] = (end, k + 1)
        else:
            begun.setdefault(tag, []).append(k)
            if tag == "head":
                heads.append(k)
    for head in heads:
        if head in ends:
            continue
        k, at, inner = head + 1, marks[head][1], ""
        while k < len(marks):
            start, end, tag, closing, _ = marks[k]
            if not inner and page[at:start].strip() or tag and tag not in IN_HEAD:
                break
            if not closing and k in ends:
                at, k = ends[k]
                continue
            if closing:
                inner = "" if tag == inner else inner
            elif tag in ("title", "noscript", "noframes", "template"):
                inner = inner or tag
            at, k = end, k + 1
        # Blank text before the mark that ends the head, and text that does, are read on.
        ends[head] = (at if not inner else marks[k][0] if k < len(marks) else len(page), k)
    return ends


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.IGNORECASE)


@lru_cache(maxsize=64)
def _start_of(tag: str) -> re.Pattern:
    return re.compile(rf"<{tag}(?![a-zA-Z0-9:-])", re.IGNORECASE)


@lru_cache(maxsize=50_000)
def _hashed(name: str, size: int) -> np.ndarray:
    """A sparse sign vector of a name."""
    out = np.zeros(size)
    seed = zlib.crc32(name.encode())
    for _ in range(4):
        seed = (seed * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
        out[(seed >> 33) % size] += 1 if seed >> 63 else -1
    return out


@lru_cache(maxsize=1)
def _word_table() -> np.ndarray:
    """The vectors that words share by their hash."""
    return np.stack([_hashed(f"word {i}", WORD_SIZE) for i in range(WORD_ROWS)]).astype(np.float32)


def vectors(found: list[Block]) -> np.ndarray:
    """A row for each block of a page."""
    out = np.zeros((len(found), SIZE))
    rows: list[int] = []
    sizes = []
    crc = zlib.crc32
    for i, (text, path, linked) in enumerate(found):
        if path is not None:
            out[i, :PATH_SIZE] = path.vector()
        words = text.lower().split()
        rows += [crc(w.encode()) & (WORD_ROWS - 1) for w in words]
        sizes.append(len(words))
        n = len(text)
        out[i, -NUMBERS:] = (
            linked,
            np.log1p(n) / 6,
            np.log1p(len(words)) / 4,
            sum(map(text.count, ".,;!?")) / n * 10,
            sum(map(text.count, "0123456789")) / n * 5,
            float(text[-1] in ".!?\""),
            (i + 1) / len(found),
            float("©" in text),
        )
    if found:
        size = np.array(sizes)
        sums = np.add.reduceat(_word_table()[rows], np.cumsum(size) - size, axis=0)
        # One length for all, so that a word said a hundred times does not outweigh the rest.
        out[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = 3 * sums / (1 + np.linalg.norm(sums, axis=1, keepdims=True))
    return out


class Lstm:
    """One layer in each direction and a logistic output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        def cell():
            w = rng.standard_normal((SIZE + HIDDEN, 4 * HIDDEN)) / np.sqrt(SIZE + HIDDEN)
            b = np.zeros(4 * HIDDEN)
            b[HIDDEN : 2 * HIDDEN] = 1.0  # the forget gate begins open
            return w, b

        (wf, bf), (wb, bb) = cell(), cell()
        self.theta = [wf, bf, wb, bb, rng.standard_normal(2 * HIDDEN) * 0.1, np.zeros(1)]

    @staticmethod
    def _run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, b: np.ndarray):
        """States over time-first input; where the mask is 0 the state stays."""
        steps, lanes, _ = x.shape
        h, c = np.zeros((lanes, HIDDEN)), np.zeros((lanes, HIDDEN))
        out, trace = np.zeros((steps, lanes, HIDDEN)), []
        for t in range(steps):
            joined = np.concatenate([x[t], h], 1)
            z = joined @ w + b
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new_c = f * c + i * g
            shown = np.tanh(new_c)
            trace.append((joined, i, f, o, g, c, shown, m))
            h = m * (o * shown) + (1 - m) * h
            c = m * new_c + (1 - m) * c
            out[t] = h
        return out, trace

    @staticmethod
    def _back(grad: np.ndarray, trace, w: np.ndarray):
        dw, db = np.zeros_like(w), np.zeros(4 * HIDDEN)
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        for t in range(len(trace) - 1, -1, -1):
            joined, i, f, o, g, c, shown, m = trace[t]
            total = grad[t] + dh
            inner = total * m
            cell = dc * m + inner * o * (1 - shown * shown)
            z = np.concatenate(
                [cell * g * i * (1 - i), cell * c * f * (1 - f), inner * shown * o * (1 - o), cell * i * (1 - g * g)], 1
            )
            dw += joined.T @ z
            db += z.sum(0)
            dh = z @ w[SIZE:].T + total * (1 - m)
            dc = cell * f + dc * (1 - m)
        return dw, db

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(p) for p in pages)
        x, mask = np.zeros((steps, len(pages), SIZE)), np.zeros((steps, len(pages)))
        for k, p in enumerate(pages):
            x[: len(p), k] = p
            mask[: len(p), k] = 1
        return x, mask

    def forward(self, x: np.ndarray, mask: np.ndarray):
        wf, bf, wb, bb, v, bias = self.theta
        ahead, trace_a = self._run(x, mask, wf, bf)
        back, trace_b = self._run(x[::-1], mask[::-1], wb, bb)
        states = np.concatenate([ahead, back[::-1]], 2)
        return 1 / (1 + np.exp(-np.clip(states @ v + bias, -30, 30))), states, trace_a, trace_b

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        p, states, trace_a, trace_b = self.forward(x, mask)
        error = (p - y) * mask / mask.sum()
        grad = error[:, :, None] * self.theta[4]
        wf, bf = self._back(grad[:, :, :HIDDEN], trace_a, self.theta[0])
        wb, bb = self._back(grad[::-1, :, HIDDEN:], trace_b, self.theta[2])
        return [wf, bf, wb, bb, (error[:, :, None] * states).sum((0, 1)), error.sum(keepdims=True).reshape(1)]

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of main text for every block of every page; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        for low in range(0, len(order), 64):
            part = order[low : low + 64]
            p = self.forward(*self.padded([pages[k] for k in part]))[0]
            for lane, k in enumerate(part):
                out[k] = p[: len(pages[k]), lane]
        return out


# ---- generated training pages


def _text(rng: random.Random, words: int) -> str:
    syllables = rng.choice([["an", "er", "th", "ing", "re", "on"], ["ei", "sch", "ung", "der", "ver"], ["eau", "tre", "elle", "la"], ["ción", "que", "ar", "os"], ["lo", "rem", "ip", "sum", "do"]])
    marks = rng.choice(["", "", "", "", "***", "###", "!!", " |", " -", "$$$", "&&&"])
    numbers = rng.choice([0, 0, 0, 0.1, 0.5])  # prices, dates, cells of a table
    out = []
    for _ in range(words):
        if rng.random() < numbers:
            out.append(rng.choice(["{}", "{}", "+{}", "{}%", "{}.5", "{}:30"]).format(rng.randrange(10 ** rng.choice([1, 2, 3, 4, 16]))))
            continue
        out.append("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) + (marks if marks else rng.choice(["", "", "", "", ",", "."])))
    return (" ".join(out)).capitalize() + rng.choice([".", ".", ""])


def generated_page(rng: random.Random) -> str:
    """A page; a mark before each leaf tells whether it is of the article."""
    parts: list[str] = []

    def leaf(label: int, words: int) -> str:
        return f"{'M' if label else 'B'}{_MARKER}{_text(rng, words)}"

    def link(words: int, cue: str = "") -> str:
        return f"<a href=\"/x\">{leaf(0, words)}{cue}</a>"

    def box(names: list[str], inner: str, tags: tuple[str, ...] = ("div", "div", "section", "aside")) -> str:
        """An element named by class or id, with a name of the list or one with a part before or after it."""
        name = rng.choice(names)
        name = rng.choice([name] * 4 + [f"{name}-wrapper", f"site-{name}", f"{name} {rng.choice(['box', 'block', 'col'])}", f"{name}_{rng.randint(1, 9)}"])
        return f"<{(t := rng.choice(tags))} {rng.choice(['class', 'class', 'id'])}=\"{name}\">{inner}</{t}>"

    def menu() -> str:
        items = "".join(f"<li>{link(rng.randint(1, 2))}</li>" for _ in range(rng.randint(3, 7)))
        tag = rng.choice(["<nav>{}</nav>", "<nav class=\"menu\">{}</nav>", "<div class=\"menu\">{}</div>", "<div id=\"navigation\">{}</div>", "<ul class=\"nav\">{}</ul>", "<div role=\"navigation\">{}</div>", "<div id=\"left\">{}</div>", "<nav class=\"nav\">{}</nav>"])
        if "<ul class" not in tag and rng.random() < 0.25:  # links in a row
            return tag.format(rng.choice([" ", " | ", "<br>"]).join(link(rng.randint(1, 2)) for _ in range(rng.randint(1, 6))))
        return tag.format(items if "<ul class" in tag else f"<ul>{items}</ul>")

    def crumbs() -> str:
        mark = rng.choice([" &gt; ", " / ", " » ", " | "])
        return box(["breadcrumb", "breadcrumbs", "pagination", "pager", "crumbs", "toolbar"], mark.join(link(rng.randint(1, 2)) for _ in range(rng.randint(2, 5))), ("div", "p", "nav"))

    def share() -> str:
        cues = rng.sample(["Share", "Tweet", "Facebook", "Email", "Print", "Pin it", "Like", "WhatsApp", "Copy link"], rng.randint(2, 4))
        links = [f"<a href=\"/s\">{leaf(0, 1)} {cue}</a>" for cue in cues]
        inner = " ".join(links) if rng.random() < 0.5 else "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>"
        return box(["share", "share-links", "social", "sharing", "post-share", "social-links", "addthis", "tags"], inner, ("div", "div", "p"))

    def advert() -> str:
        name = rng.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner ad", "ad-slot"])
        return f"<{(t := rng.choice(['div', 'aside', 'section', 'div']))} class=\"{name}\">{leaf(0, rng.randint(3, 25))}</{t}>"

    def notice() -> str:
        name = rng.choice(["cookie", "cookie-notice", "cookie-bar", "cookiebanner", "notice", "consent", "newsletter", "popup", "alert", "gdpr", "subscribe"])
        cue = rng.choice(["We use cookies", "This site uses cookies", "Accept all", "Subscribe to our newsletter", "Sign up", ""])
        inner = f"{leaf(0, rng.randint(3, 20))} {cue}"
        inner = rng.choice([f"<p>{inner}</p>", f"<p>{inner}</p>", inner + " <button>Accept</button>", f"<p>{inner}</p>{link(1)}"])
        return f"<div {rng.choice(['class', 'id'])}=\"{name}\">{inner}</div>"

    def sidebar() -> str:
        name = rng.choice(["<aside>{}</aside>", "<div class=\"sidebar\">{}</div>", "<aside class=\"related\">{}</aside>", "<div id=\"sidebar\">{}</div>", "<div class=\"related-posts\">{}</div>", "<div class=\"widget\">{}</div>", "<div class=\"recommended\">{}</div>", "<div id=\"left\">{}</div>", "<div id=\"right\">{}</div>", "<div class=\"right-col\">{}</div>"])
        inner = f"<h3>{leaf(0, 2)}</h3>" + "".join(rng.choice(["<p>{}</p>", "<li><a href=\"/y\">{}</a></li>"]).format(leaf(0, rng.randint(2, 18))) for _ in range(rng.randint(1, 4)))
        return name.format(inner)

    def form() -> str:
        return f"<form><label>{leaf(0, 1)}</label><input name=\"q\"><button>{leaf(0, 1)}</button></form>"

    def comments() -> str:
        name = rng.choice(["comments", "comment-list", "reader-comments", "discussion", "replies", "disqus_thread", "responses", "commentlist", "respond"])
        forms = [
            "<div class=\"comment\"><b>{}</b><p>{}</p></div>", "<li class=\"comment\"><span>{}</span> <p>{}</p></li>",
            "<div><b>{} says</b><p>{}</p></div>", "<p><b>{}:</b> {}</p>", "<article class=\"comment\"><h4>{}</h4><p>{}</p></article>",
        ]
        inner = "".join(rng.choice(forms).format(leaf(0, 1), leaf(0, rng.randint(3, 30))) for _ in range(rng.randint(1, 5)))
        return f"<{(t := rng.choice(['section', 'div']))} {rng.choice(['class', 'id'])}=\"{name}\"><h2>{leaf(0, 1)}</h2>{inner}</{t}>"

    def footer() -> str:
        inner = rng.choice(["&copy; {}", "{} &middot; {}", "<p>&copy; 2020 {}</p><p>{}</p>", "<ul><li><a href=\"/z\">{}</a></li><li><a href=\"/w\">{}</a></li></ul>"])
        if rng.random() < 0.2:  # a line of its own, without a name
            line = f"{rng.choice(['Copyright', 'Copyright 2011', '&copy;', 'All rights reserved', 'Powered by', 'Imprint'])} {leaf(0, rng.randint(1, 5))}"
            return rng.choice(["<p>{}</p>", "<hr><p>{}</p>", "<p><small>{}</small></p>", "<center>{}</center>", "<div>{}</div>", "<address>{}</address>", "<p class=\"copyright\">{}</p>"]).format(line)
        tag = rng.choice(["<footer>{}</footer>", "<footer>{}</footer>", "<div class=\"footer\">{}</div>", "<div id=\"footer\">{}</div>", "<div id=\"bottom\">{}</div>"])
        return tag.format(inner.format(leaf(0, rng.randint(1, 6)), leaf(0, rng.randint(2, 9))))

    def header() -> str:
        tag = rng.choice(["<header>{}</header>", "<div class=\"header\">{}</div>", "<div id=\"masthead\">{}</div>", "<div id=\"top\">{}</div>"])
        return tag.format(rng.choice(["<a href=\"/\">{}</a>", "<h1>{}</h1>", "<p>{}</p>"]).format(leaf(0, rng.randint(1, 4))))

    def figure() -> str:
        caption = f"<figcaption>{leaf(1, rng.randint(3, 14))}</figcaption>"
        return f"<figure><img src=\"/i.png\">{caption}</figure>" if rng.random() < 0.7 else f"<div class=\"image\"><img src=\"/i\"><p class=\"caption\">{leaf(1, rng.randint(3, 14))}</p></div>"

    def listing() -> str:
        tag = rng.choice(["ul", "ul", "ol", "dl"])
        if tag == "dl":
            return "<dl>" + "".join(f"<dt>{leaf(1, rng.randint(1, 3))}</dt><dd>{leaf(1, rng.randint(2, 14))}</dd>" for _ in range(rng.randint(2, 5))) + "</dl>"
        linked = rng.random() < 0.15
        items = "".join(f"<li>{leaf(1, rng.randint(1, 14))}{' <a href=\"/l\">l</a>' if linked else ''}</li>" for _ in range(rng.randint(2, 6)))
        return f"<{tag}>{items}</{tag}>"

    def grid() -> str:
        columns = rng.randint(2, 4)
        head = "<tr>" + "".join(f"<th>{leaf(1, rng.randint(1, 2))}</th>" for _ in range(columns)) + "</tr>"
        rows = "".join("<tr>" + "".join(f"<td>{leaf(1, rng.randint(1, 4))}</td>" for _ in range(columns)) + "</tr>" for _ in range(rng.randint(1, 5)))
        return f"<table{rng.choice(['', ' class=\"data\"', ' border=\"1\"'])}>{rng.choice([head, ''])}{rows}</table>"

    def article() -> str:
        unclosed = rng.random() < 0.3
        body = []
        title = leaf(1, rng.randint(1, 12))
        if rng.random() < 0.85:
            body.append(f"<{(h := rng.choice(['h1', 'h1', 'h2']))}>{title}</{h}>")
        if rng.random() < 0.1:
            body.append(share())
        if unclosed:
            body.append(f"<p><b>{leaf(1, rng.randint(1, 12))}<br>")
        for _ in range(rng.randint(1, 12)):
            if rng.random() < 0.12:
                body.append(rng.choice([figure, listing, listing, grid])())
            form_of = rng.choice(["<p>{}</p>"] * 8 + ["<p><b>{}</b></p>", "<p><b>{}<br>", "<li>{}</li>", "<h2>{}</h2>", "<h3>{}</h3>", "<blockquote>{}</blockquote>", "<p>{} <a href=\"/l\">l</a></p>", "<pre>{}</pre>", "<td>{}</td>", "<div>{}</div>"])
            body.append(form_of.format(leaf(1, rng.choice([1, 2, 5, 12, 25, 40]))))
            if rng.random() < 0.06:
                body.append(rng.choice([advert, sidebar, notice])())
        if rng.random() < 0.12:
            body.append(share())
        if rng.random() < 0.1:
            body.append(comments())
        wrap = rng.choice(
            ["<article>{}</article>"] * 7
            + ["<main>{}</main>"] * 2
            + ["<main><article>{}</article></main>", "<div class=\"content\">{}</div>", "<div id=\"main-content\">{}</div>", "<div class=\"post-body\">{}</div>"]
            + ["<div class=\"article\">{}</div>", "<div><div>{}</div></div>", "<div role=\"main\">{}</div>", "<div class=\"entry-content\">{}</div>"]
            + ["<section class=\"story\">{}</section>", "<div id=\"page\"><div class=\"main\">{}</div></div>", "<section>{}</section>", "{}", "<div id=\"middle\">{}</div>", "<div class=\"center\">{}</div>", "<section class=\"post\">{}</section>"]
        )
        return wrap.format("".join(body))

    before = ((header, 0.4), (menu, 0.85), (crumbs, 0.2), (notice, 0.25), (advert, 0.6), (form, 0.15), (sidebar, 0.2))
    after = ((share, 0.15), (sidebar, 0.2), (advert, 0.2), (comments, 0.35), (form, 0.15), (notice, 0.2), (menu, 0.15), (crumbs, 0.1))
    if rng.random() < 0.12:  # laid out by a table, as older pages are
        top = "".join(make() for make, chance in before if rng.random() < chance / 2)
        side, rest = rng.choice([menu, sidebar, advert])(), "".join(make() for make, chance in after if rng.random() < chance)
        cells = [f"<td{rng.choice(['', ' valign=\"top\"', ' width=\"20%\"'])}>{x}</td>" for x in (side, article())]
        if rng.random() < 0.3:
            cells.reverse()
        parts.append(f"{top}<table>{f'<tr><td colspan=\"2\">{header()}</td></tr>' if rng.random() < 0.5 else ''}<tr>{''.join(cells)}</tr></table>{rest}")
    else:
        parts += [make() for make, chance in before if rng.random() < chance]
        parts.append(article())
        parts += [make() for make, chance in after if rng.random() < chance]
    if rng.random() < 0.9:
        parts.append(footer())
    return f"<!DOCTYPE html><html lang=\"en\"><head><title>{_text(rng, 4)}</title><style>p{{}}</style></head><body>{''.join(parts)}</body></html>"


_MARKER = "\u0001"


def examples(count: int, seed: int = 7) -> list[tuple[list[Block], np.ndarray]]:
    """Blocks and labels of generated pages."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        found, labels = [], []
        for text, names, linked in blocks(generated_page(rng)):
            marked = text.find(_MARKER)
            if marked > 0:
                labels.append(text[marked - 1] == "M")
                found.append((text.replace("M" + _MARKER, "").replace("B" + _MARKER, ""), names, linked))
            else:
                labels.append(bool(labels and labels[-1]))
                found.append((text, names, linked))
        out.append((found, np.array(labels, dtype=float)))
    return out


@lru_cache(maxsize=1)
def trained(seed: int = 7) -> Lstm:
    """The network fitted to generated pages with Adam."""
    data = [(vectors(found), labels) for found, labels in examples(PAGES, seed) if found]
    data.sort(key=lambda d: len(d[1]))
    groups = [data[k : k + BATCH] for k in range(0, len(data), BATCH)]
    model = Lstm(seed)
    moment = [np.zeros_like(p) for p in model.theta]
    spread = [np.zeros_like(p) for p in model.theta]
    rng = random.Random(seed)
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(groups)
        for group in groups:
            x, mask = Lstm.padded([v for v, _ in group])
            y = np.zeros(mask.shape)
            for k, (_, labels) in enumerate(group):
                y[: len(labels), k] = labels
            step += 1
            for k, g in enumerate(model.gradients(x, mask, y)):
                moment[k] = 0.9 * moment[k] + 0.1 * g
                spread[k] = 0.999 * spread[k] + 0.001 * g * g
                model.theta[k] = model.theta[k] - RATE * (moment[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.999**step)) + 1e-8)
    return model


def main_texts(pages: list[str | None], model: Lstm) -> list[str]:
    found = [blocks(p) for p in pages]
    labels = model.label([vectors(f) for f in found])
    return [" ".join(text for (text, _, _), p in zip(f, label) if p >= KEEP) for f, label in zip(found, labels)]


def extract_main_text(pages: DataFrame, html_col: str = "html", prefix: str = "") -> DataFrame:
    """Adds text, the main text of each page, and n_chars, its code points."""
    model = trained()

    def run(batch):
        texts = main_texts(batch.column(html_col).to_pylist(), model)
        return [texts, [len(t) for t in texts]]

    return append(pages, run, [("text", "string"), ("n_chars", "long")], prefix)


def op7_html_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = prepare(spark, 500).read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")
