"""Ordered differences between two versions of a text, line by line.

Lines that occur once in both versions are safe anchors. The longest chain of them that keeps its order in
both is matched, and the stretches between anchors are compared in the same way; where a stretch has no such line,
its lines are told apart by how often they occurred before. Equal beginnings and ends are matched first.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.functions import text
from galley.schema import require


def longest_chain(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence whose second members increase; the first members already do."""
    tails: list[int] = []  # smallest last member of a chain of each length
    ends: list[int] = []  # and the pair it belongs to
    before: list[int] = []
    for at, (_, j) in enumerate(pairs):
        size = bisect_left(tails, j)
        before.append(ends[size - 1] if size else -1)
        tails[size : size + 1], ends[size : size + 1] = [j], [at]
    chain, at = [], ends[-1] if ends else -1
    while at >= 0:
        chain.append(pairs[at])
        at = before[at]
    return chain[::-1]


def _once(old: Sequence[str], new: Sequence[str], a: range, b: range) -> list[tuple[int, int]]:
    """Places of the lines that occur once in each stretch, in old order."""
    left, right = Counter(old[i] for i in a), Counter(new[j] for j in b)
    place = {new[j]: j for j in b if right[new[j]] == 1}
    return [(i, place[old[i]]) for i in a if left[old[i]] == 1 and old[i] in place]


def _counted(old: Sequence[str], new: Sequence[str], a: range, b: range) -> list[tuple[int, int]]:
    """Places of the n-th occurrence of a line in each stretch, in old order."""
    place: dict[tuple[str, int], int] = {}
    seen: Counter = Counter()
    for j in b:
        place[new[j], seen[new[j]]] = j
        seen[new[j]] += 1
    seen.clear()
    out = []
    for i in a:
        if (old[i], seen[old[i]]) in place:
            out.append((i, place[old[i], seen[old[i]]]))
        seen[old[i]] += 1
    return out


def matched_lines(old: Sequence[str], new: Sequence[str]) -> list[tuple[int, int]]:
    """(old place, new place) of the lines that stay, increasing in both."""
    stay: list[tuple[int, int]] = []
    stretches = [(0, len(old), 0, len(new))]
    while stretches:
        a, a_end, b, b_end = stretches.pop()
        while a < a_end and b < b_end and old[a] == new[b]:
            stay.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and old[a_end - 1] == new[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            stay.append((a_end, b_end))
        if a == a_end or b == b_end:
            continue
        anchors = longest_chain(_once(old, new, range(a, a_end), range(b, b_end)))
        if not anchors:
            stay += longest_chain(_counted(old, new, range(a, a_end), range(b, b_end)))
            continue
        stay += anchors
        for i, j in [*anchors, (a_end, b_end)]:
            stretches.append((a, i, b, j))
            a, b = i + 1, j + 1
    return sorted(stay)


def script(old: Sequence[str], new: Sequence[str]) -> list[tuple[str, int]]:
    """Steps ('removed', old line) and ('added', new line) in order, lines from 1; removals of a place come first."""
    steps: list[tuple[str, int]] = []
    a = b = 0
    for i, j in [*matched_lines(old, new), (len(old), len(new))]:
        steps += [("removed", n + 1) for n in range(a, i)]
        steps += [("added", n + 1) for n in range(b, j)]
        a, b = i + 1, j + 1
    return steps


def ordered_changes(new: DataFrame, base: DataFrame, key: str, body: str) -> DataFrame:
    """(key, step, change, line_no, line): what turns the old version into the new one, in order.

    `line_no` counts in the old version for a removed and in the new one for an
    added line, `step` in the script of a document. A version that is absent or
    NULL has no lines. Keys must be unique and not NULL. Documents that did not change are
    left out before the texts of the two versions meet in a row.
    """
    require(new, key, body)
    require(base, key, body)
    digest = F.sha2(F.col(body), 256).alias("_h")
    kept = new.select(key, digest).join(base.select(key, digest), [key, "_h"])
    sides = [df.join(kept.select(key), key, "left_anti").select(key, text.lines(F.col(body)).alias(n)) for df, n in ((base, "_old"), (new, "_new"))]
    both = sides[0].join(sides[1], key, "full_outer")
    kind = both.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One document at a time: its lines are freed before those of the next are read.
            for i in range(batch.num_rows):
                steps = script(*(batch.column(c)[i].as_py() or [] for c in ("_old", "_new")))
                change = pa.array([[c for c, _ in steps]], pa.list_(pa.string()))
                place = pa.array([[n for _, n in steps]], pa.list_(pa.int32()))
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [row.column(key), row.column("_old"), row.column("_new"), change, place], names=[key, "_old", "_new", "_c", "_p"]
                )

    steps = both.mapInArrow(run, f"`{key}` {kind}, _old array<string>, _new array<string>, _c array<string>, _p array<int>")
    line = lambda s: F.when(s["_c"] == "removed", F.get("_old", s["_p"] - 1)).otherwise(F.get("_new", s["_p"] - 1))
    full = F.transform(F.arrays_zip("_c", "_p"), lambda s: F.struct(s["_c"].alias("change"), s["_p"].alias("line_no"), line(s).alias("line")))
    return steps.select(key, F.posexplode(full).alias("_at", "_s")).select(key, (F.col("_at") + 1).alias("step"), "_s.*")


def apply_changes(base: DataFrame, changes: DataFrame, key: str, body: str) -> DataFrame:
    """(key, body): the old versions after their scripts, lines joined by line feeds.

    Removed lines leave, added lines take their places, and the lines that stay
    fill the others in order. A document of which no line is left is empty.
    """
    require(base, key, body)
    require(changes, key, "change", "line_no", "line")
    of = lambda kind, c: F.collect_list(F.when(F.col("change") == kind, c))
    steps = changes.groupBy(key).agg(
        of("removed", F.col("line_no")).alias("_gone"), of("added", F.struct(F.col("line_no").alias("at"), "line")).alias("_come")
    )
    none = F.array().cast("array<int>")
    joined = base.select(key, F.coalesce(text.lines(F.col(body)), F.array().cast("array<string>")).alias("_old")).join(steps, key, "full_outer")
    numbered = F.transform("_old", lambda l, i: F.struct((i + 1).alias("at"), l.alias("line")))
    gone = F.coalesce("_gone", none)
    stays = F.coalesce(F.filter(numbered, lambda l: ~F.array_contains(gone, l["at"])), F.array().cast("array<struct<at:int,line:string>>"))
    come = F.coalesce("_come", F.array().cast("array<struct<at:int,line:string>>"))
    free = text.bind(
        F.size(F.col("_stays")) + F.size(F.col("_in")),
        lambda n: F.when(n > 0, F.array_except(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.transform("_in", lambda l: l["at"]))).otherwise(none),
    )
    moved = F.transform(F.arrays_zip(F.col("_free").alias("at"), F.col("_stays").alias("line")), lambda z: F.struct(z["at"].alias("at"), z["line"]["line"].alias("line")))
    placed = joined.select(key, stays.alias("_stays"), come.alias("_in")).withColumn("_free", free)
    lines = F.array_sort(F.concat(moved, F.col("_in")))
    return placed.select(key, F.array_join(F.transform(lines, lambda l: l["line"]), "\n").alias(body))
