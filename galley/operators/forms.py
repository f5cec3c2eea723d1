"""Form cells: fill by address, reconcile, pair labels, roll up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galley.functions import text
from galley.operators import ordered
from galley.schema import require

ADDRESS = ["doc_id", "section", "row", "col", "occurrence"]


def with_occurrence(cells: DataFrame) -> DataFrame:
    """Numbers the cells of one address from 0; nested tables repeat addresses."""
    require(cells, "doc_id", "section", "row", "col", "idx")
    same = Window.partitionBy("doc_id", "section", "row", "col").orderBy("idx")
    return cells.withColumn("occurrence", F.row_number().over(same) - 1)


def fill_cells(cells: DataFrame, values: DataFrame) -> DataFrame:
    """Cells after the values, with status filled, error or untouched.

    Modes: `set` opens the empty run or replaces the first fragment, `whole`
    leaves only the value, `append` follows the last fragment, `prepend` goes
    before the first run. A value with no matching cell is an error row.
    """
    require(cells, "doc_id", "section", "row", "col", "idx", "fragments", "empty_at", "has_run")
    require(values, *ADDRESS, "mode", "value")
    old = F.col("fragments")
    value = F.array(text.escape(F.col("value")))
    n = F.size(old)
    opened = F.concat(F.slice(old, 1, F.col("empty_at")), value, F.slice(old, F.col("empty_at") + 1, n))
    set_text = F.when(F.col("empty_at").isNotNull(), opened).when(
        n > 0, F.concat(value, F.slice(old, 2, n))
    )
    joined_last = F.array(F.concat(F.element_at(old, F.greatest(n, F.lit(1))), value[0]))
    new = (
        F.when(F.col("mode") == "set", set_text)
        .when(F.col("mode") == "whole", F.when(n > 0, value).otherwise(set_text))
        .when(
            F.col("mode") == "append",
            F.when(n > 0, F.concat(F.slice(old, 1, n - 1), joined_last)).otherwise(set_text),
        )
        .when((F.col("mode") == "prepend") & F.col("has_run"), F.concat(value, old))
    )
    # Several values for one address would overwrite each other in no fixed order.
    once = values.groupBy(*ADDRESS).agg(
        F.count(F.lit(1)).alias("_values"), F.max("mode").alias("mode"), F.max("value").alias("value")
    )
    known = with_occurrence(cells).withColumn("_cell", F.lit(True))
    joined = known.join(once, ADDRESS, "full_outer")
    error = (
        F.when(F.col("_cell").isNull(), "unknown_address")
        .when(F.col("_values") > 1, "several_values")
        .when(F.col("_values").isNotNull() & new.isNull(), "no_text_slot")
    )
    status = F.when(error.isNotNull(), "error").when(F.col("_values") == 1, "filled").otherwise("untouched")
    after = F.when(status == "filled", F.array_join(new, "")).otherwise(F.array_join(old, ""))
    return joined.select(*ADDRESS, after.alias("text"), status.alias("status"), error.alias("error"))


def reconcile_keys(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, hits, status): every expected key must be hit exactly once.

    `actual` has one row per hit and may carry a `count`.
    """
    require(expected, key)
    require(actual, key)
    weight = F.col("count") if "count" in actual.columns else F.lit(1)
    hits = actual.groupBy(key).agg(F.sum(weight).alias("hits"))
    wanted = expected.select(key).distinct().withColumn("_wanted", F.lit(True))
    joined = wanted.join(hits, key, "full_outer")
    status = (
        F.when(F.col("_wanted").isNull(), "unexpected")
        .when(F.coalesce("hits", F.lit(0)) == 0, "missing")
        .when(F.col("hits") != 1, "wrong_count")
        .otherwise("ok")
    )
    return joined.select(key, F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), status.alias("status"))


def reconcile_verdict(reconciled: DataFrame) -> DataFrame:
    """One row: counts and verdict. Nothing expected is a failure, not a pass."""
    require(reconciled, "status")
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    facts = reconciled.agg(count("ok"), count("missing"), count("unexpected"), count("wrong_count"))
    good = (F.col("ok") > 0) & (F.col("missing") + F.col("unexpected") + F.col("wrong_count") == 0)
    return facts.withColumn("verdict", F.when(good, "pass").otherwise("fail"))


def label_value_pairs(cells: DataFrame) -> DataFrame:
    """Each label with the next empty cell to its right in the same row.

    (doc_id, section, row, label, value_col, paired). A row of a form is
    narrow, so its cells may meet in one task.
    """
    require(cells, "doc_id", "section", "row", "col", "text", "is_empty")
    after = (
        Window.partitionBy("doc_id", "section", "row")
        .orderBy("col")
        .rowsBetween(1, Window.unboundedFollowing)
    )
    target = F.first(F.when(F.col("is_empty"), F.col("col")), ignorenulls=True).over(after)
    labels = cells.withColumn("value_col", target).filter(~F.col("is_empty") & (text.strip(F.col("text")) != ""))
    return labels.select(
        "doc_id", "section", "row", "col", F.col("text").alias("label"),
        F.coalesce("value_col", F.lit(-1)).alias("value_col"),
        F.col("value_col").isNotNull().alias("paired"),
    )


def form_rollup(cells: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, section, cells, empties) and, with counts, paragraphs and pictures.

    Sections roll up to documents by a second, far smaller aggregate.
    """
    require(cells, "doc_id", "section", "is_empty")
    rolled = cells.groupBy("doc_id", "section").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if("is_empty").alias("empties")
    )
    if counts is None:
        return rolled
    return counts.join(rolled, ["doc_id", "section"], "left").fillna(0, ["cells", "empties"])


def document_rollup(sections: DataFrame) -> DataFrame:
    """Section counts summed to documents."""
    counts = ("cells", "empties", "paragraphs", "pictures")
    require(sections, "doc_id", "section", *counts)
    return sections.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sections"), *[F.sum(c).alias(c) for c in counts]
    )


def style_usage(runs: DataFrame, styles: DataFrame) -> DataFrame:
    """(doc_id, style_id, runs, height, color, spacing, italic, bold), unused styles too."""
    require(runs, "doc_id", "style_id")
    require(styles, "doc_id", "style_id", "height", "color")
    used = runs.groupBy("doc_id", "style_id").agg(F.count(F.lit(1)).alias("runs"))
    return styles.join(used, ["doc_id", "style_id"], "left").fillna(0, ["runs"])


def body_styles(styles: DataFrame, n: int = 14) -> DataFrame:
    """The first n black styles of each document, by number."""
    require(styles, "doc_id", "style_id", "color")
    order = Window.partitionBy("doc_id").orderBy("style_id")
    return (
        styles.filter(F.col("color") == "#000000")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
    )


def next_fragment(fragments: DataFrame, key: Sequence[str], anchor: str) -> DataFrame:
    """The fragment right after the first one that holds the anchor, or an error row.

    Two aggregates and an equality join on the position: no ordered pass over
    the fragments of a document.
    """
    require(fragments, *key, "pos", "text")
    hits = fragments.groupBy(*key).agg(
        F.min(F.when(F.col("text").contains(anchor), F.col("pos"))).alias("_hit")
    )
    wanted = hits.withColumn("pos", F.col("_hit") + 1)
    found = fragments.select(*key, "pos", F.col("text").alias("following"))
    return wanted.join(found, [*key, "pos"], "left").select(
        *key,
        F.coalesce("_hit", F.lit(-1)).alias("anchor_pos"),
        F.coalesce("following", F.lit("")).alias("following"),
        F.when(F.col("_hit").isNull(), "no_anchor")
        .when(F.col("following").isNull(), "nothing_follows")
        .otherwise("ok")
        .alias("status"),
    )


def counted_replace(sections: DataFrame, find: str, replacement: str) -> DataFrame:
    """Literal replacement inside text fragments only, with the number of hits.

    (doc_id, section, hits, xml). Attributes are never touched.
    """
    require(sections, "doc_id", "section", "xml")
    pieces = F.split("xml", r"(?=<hp:t>)|(?<=</hp:t>)")
    changed = F.transform(
        pieces,
        lambda p: F.when(
            p.startswith("<hp:t>"),
            F.replace(p, F.lit(find), text.escape(F.lit(replacement))),
        ).otherwise(p),
    )
    hits = F.aggregate(
        pieces,
        F.lit(0),
        lambda acc, p: acc + F.when(p.startswith("<hp:t>"), text.literal_count(p, F.lit(find))).otherwise(0),
    )
    return sections.select("doc_id", "section", hits.alias("hits"), F.array_join(changed, "").alias("xml"))


def width_slack(lines: DataFrame, group: Sequence[str], body: str) -> DataFrame:
    """Adds slack: room left in a line against the longest line of its list."""
    require(lines, *group, body)
    widest = lines.groupBy(*group).agg(F.max(F.length(body)).alias("_widest"))
    return lines.join(widest, list(group)).withColumn("slack", F.col("_widest") - F.length(body)).drop("_widest")
