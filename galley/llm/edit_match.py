"""Benchmark decontamination: pigeonhole pieces, exact piece hits, Myers bit-parallel verification.

A test item of m characters may be met with up to floor(0.05 m) edits. It is cut
into one piece more than that, so an occurrence within the budget holds at least
one piece unchanged. An Aho-Corasick automaton finds the pieces in one pass over a
text; the stretch around each hit is verified with Myers' bit-parallel distance.
Texts and items are compared in lower case with white space as single blanks.

Items travel to the tasks in blocks of bounded size; more items mean more blocks,
and each block is searched in every text.

Nulls and edge cases: null or empty texts and items match nothing. Items shorter than
`MIN_CHARS` after folding are met only without an edit and on word bounds. Items without
an id are searched like others and give rows without one. Of several
occurrences in a text the one with the least distance, then the leftmost, is given.
Repeated texts give equal rows each; repeated items (same id and text) count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import append, prepare

ERROR_RATE = 0.05
MIN_CHARS = 24
BLOCK_ITEMS, BLOCK_CHARS = 5000, 2_000_000

Item = tuple[object, str]


def fold(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """The text in budget + 1 parts of nearly equal length, with their offsets."""
    n = budget + 1
    cuts = [len(text) * k // n for k in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def pattern_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best place in the text where the pattern ends, the leftmost of equals."""
    full = (1 << m) - 1
    top = 1 << (m - 1)
    plus, minus, score = full, 0, m
    best: tuple[int, int] | None = None
    get = masks.get
    for at, c in enumerate(text):
        eq = get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(horizontal | plus) & full)
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
        if score <= budget and (best is None or score < best[0]):
            best = (score, at + 1)
            if score == 0:
                break
    return best


def on_word_bounds(text: str, start: int, end: int) -> bool:
    """Whether no word or number goes on beyond either end of a place."""
    return not (start > 0 and text[start - 1].isalnum() and text[start].isalnum()) and not (
        end < len(text) and text[end - 1].isalnum() and text[end].isalnum()
    )


class Matcher:
    """Finds the items of a block in folded texts."""

    def __init__(self, items: list[Item], rate: float):
        self.items = [(key, text, int(len(text) * rate) if len(text) >= MIN_CHARS else 0) for key, text in items]
        self.masks = [pattern_masks(t) for _, t, _ in self.items]
        self.back = [pattern_masks(t[::-1]) for _, t, _ in self.items]
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, budget) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                where.setdefault(piece, []).append((i, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, places)
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, distance, start, end) of every item met in a folded text."""
        stretches: dict[int, list[list[int]]] = {}
        short: dict[int, int] = {}
        for last, places in self.automaton.iter(text):
            for i, offset in places:
                _, item, budget = self.items[i]
                if len(item) < MIN_CHARS:
                    if i not in short and on_word_bounds(text, last + 1 - len(item), last + 1):
                        short[i] = last + 1
                    continue
                low = max(0, last + 1 - offset - budget)
                high = min(len(text), last + 1 - offset + len(item) + budget)
                held = stretches.setdefault(i, [])
                if held and low <= held[-1][1]:  # hits come in order of their ends; stretches grow to the right
                    held[-1][0] = min(held[-1][0], low)
                    held[-1][1] = max(held[-1][1], high)
                else:
                    held.append([low, high])
        for i, end in short.items():
            yield i, 0, end - len(self.items[i][1]), end
        for i, held in stretches.items():
            _, item, budget = self.items[i]
            best = None
            for low, high in held:
                found = myers(self.masks[i], len(item), text[low:high], budget)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], low + found[1])
            if best:
                distance, end = best
                low = max(0, end - len(item) - budget)
                size = myers(self.back[i], len(item), text[low:end][::-1], distance)
                yield i, distance, end - (size[1] if size else len(item)), end


_matchers: dict[object, Matcher] = {}


def matcher_of(items: list[Item], rate: float, token: str) -> Matcher:
    """The matcher of a block; a worker keeps the last one."""
    if token not in _matchers:
        _matchers.clear()
        _matchers[token] = Matcher(items, rate)
    return _matchers[token]


def _search(items: list[Item], rate: float, token: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of(items, rate, token)
        for batch in batches:
            rows, found = [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                for i, distance, start, end in matcher.find(fold(text)):
                    rows.append(r)
                    found.append((matcher.items[i][0], distance, start, end))
            own = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            columns = list(zip(*found)) or [[], [], [], []]
            kinds = [kind, pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [own, *[pa.array(list(c), k) for c, k in zip(columns, kinds)]],
                names=["doc_id", "item_id", "distance", "start", "end"],
            )

    return run


def item_blocks(items: DataFrame) -> Iterator[list[Item]]:
    """Folded items in blocks of bounded number and size, fetched a partition at a time."""
    block: list[Item] = []
    chars = 0
    for key, text in items.dropDuplicates().toLocalIterator():
        text = fold(text)
        if not text:
            continue
        if block and (len(block) >= BLOCK_ITEMS or chars + len(text) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((key, text))
        chars += len(text)
    if block:
        yield block


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = ERROR_RATE
) -> DataFrame:
    """(doc_id, item_id, distance, start, end) of every benchmark item met in a text within its error budget.

    `items` has item_id and text; start and end are places in the folded text.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    items = items.select("item_id", "text")
    item_type = items.schema["item_id"].dataType.simpleString()
    item_kind = to_arrow_type(items.schema["item_id"].dataType)
    schema = f"doc_id {id_type}, item_id {item_type}, distance int, start long, end long"
    out = None
    for block in item_blocks(items):
        token = str(hash(tuple(block)))
        part = docs.mapInArrow(_search(block, rate, token, item_kind), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The documents in which no item is met, with all their columns."""
    for block in item_blocks(items.select("item_id", "text")):
        token = str(hash(tuple(block)))

        def free(batch, block=block, token=token):
            matcher = matcher_of(block, rate, token)
            return [[next(matcher.find(fold(t)), None) is None for t in batch.column(text_col).to_pylist()]]

        docs = append(docs, free, [("free", "boolean")], "_op6_").where("_op6_free").drop("_op6_free")
    return docs


def op6_edit_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
