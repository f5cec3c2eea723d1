"""Does the spoken copy still match its script, and what leaked onto the screen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import lexicon, text
from galley.operators import ordered
from galley.schema import require


def _is_spoken(trimmed: Column) -> Column:
    return (
        F.when(trimmed == "", False)
        .when(trimmed.startswith(">"), ~trimmed.rlike(rf"^>+\s*$|{lexicon.DIRECTIVES}"))
        .when(trimmed.startswith("#"), ~trimmed.rlike(lexicon.SECTION_HEADING))
        .when(trimmed.startswith("|"), False)
        .otherwise(~trimmed.rlike(r"^-\s*\[[ x]\]|^(---|\*\*\*)$"))
    )


def spoken_lines(lines: DataFrame) -> DataFrame:
    """Lines that are read aloud."""
    require(lines, "line")
    # The array binds the trimmed line once for all tests on it.
    return lines.filter(F.exists(F.array(text.strip(F.col("line"))), _is_spoken))


def spoken_text(script: Column) -> Column:
    """The spoken lines of a script as one normalised text."""
    trimmed = F.transform(text.lines(script), text.strip)
    return text.normalize_copy(F.array_join(F.filter(trimmed, _is_spoken), " "))


def narration_sentences(script: Column, min_chars: int = 12) -> Column:
    """Normalised paragraphs of a slide script that are long enough to compare."""
    plain = F.replace(F.replace(script, F.lit("&quot;"), F.lit("")), F.lit("&amp;"), F.lit("&"))
    pieces = F.transform(F.split(plain, r"\|"), text.normalize_copy)
    return F.filter(pieces, lambda s: F.length(s) >= min_chars)


def missing_copy(slides: DataFrame, scripts: DataFrame, key: str, head: int = 25) -> DataFrame:
    """(key, slide_no, sentence): narration whose beginning is not in the script.

    The join is on the document alone; containment is tested inside the row.
    """
    require(slides, key, "slide_no", "script")
    require(scripts, key, "script_text")
    spoken = scripts.select(key, spoken_text(F.col("script_text")).alias("_spoken"))
    narrated = slides.select(key, "slide_no", narration_sentences(F.col("script")).alias("_s"))
    joined = narrated.join(spoken, key, "left").withColumn("_spoken", F.coalesce("_spoken", F.lit("")))
    gone = F.filter("_s", lambda s: ~F.col("_spoken").contains(F.substring(s, 1, head)))
    return joined.select(key, "slide_no", F.explode(gone).alias("sentence"))


def numeral_split(missing: DataFrame) -> DataFrame:
    """Adds severity: a sentence with numbers is soft, since numbers are read as words."""
    require(missing, "sentence")
    return missing.withColumn(
        "severity", F.when(text.has_number(F.col("sentence")), "soft").otherwise("hard")
    )


def longest_shared(left: Column, right: Column, min_len: int, max_len: int) -> Column:
    """Struct (start, length, fragment) of the longest run in both texts, or NULL.

    Starts whose shortest run is shared are found first; only they can begin a
    longer one. If a run of n characters is shared then so is one of n - 1, so
    the length is found by halving the range. The first run in the left text
    wins; `start` counts from 1.
    """
    halvings = max(1, (max_len - min_len).bit_length())

    def search(t: Column) -> Column:
        size = F.length(t["l"])

        def holds(i: Column, n: Column) -> Column:
            return (i + n - 1 <= size) & t["r"].contains(t["l"].substr(i, n))

        def narrow(starts: Column) -> Column:
            def probe(state: Column, _: Column) -> Column:
                middle = F.ceil((state["low"] + state["high"]) / 2).cast("int")
                return text.bind(
                    middle,
                    lambda n: F.when(
                        F.exists(starts, lambda i: holds(i, n)),
                        F.struct(n.alias("low"), state["high"].alias("high")),
                    ).otherwise(
                        F.struct(
                            state["low"].alias("low"),
                            F.greatest(state["low"], n - 1).alias("high"),
                        )
                    ),
                )

            length = F.aggregate(
                F.sequence(F.lit(1), F.lit(halvings)),
                F.struct(F.lit(min_len).alias("low"), F.least(F.lit(max_len), size).alias("high")),
                probe,
                lambda s: s["low"],
            )
            return text.bind(
                length,
                lambda n: text.bind(
                    F.filter(starts, lambda i: holds(i, n))[0],
                    lambda i: F.struct(
                        i.alias("start"), n.alias("length"), t["l"].substr(i, n).alias("fragment")
                    ),
                ),
            )

        first = F.filter(
            F.sequence(F.lit(1), size - min_len + 1), lambda i: holds(i, F.lit(min_len))
        )
        return F.when(
            (size >= min_len) & (F.length(t["r"]) >= min_len),
            text.bind(first, lambda starts: F.when(F.size(starts) > 0, narrow(starts))),
        )

    return text.bind(F.struct(left.alias("l"), right.alias("r")), search)


def shared_passages(
    pairs: DataFrame, key: Sequence[str], left: str, right: str, min_len: int = 12, max_len: int = 80
) -> DataFrame:
    """(key, start, length, fragment): the longest run the two texts of a pair share.

    Both texts lie in the row of their pair, as a note and the screen it must not
    appear on: nothing is shuffled and no pairs are formed.
    """
    require(pairs, *key, left, right)
    longest = longest_shared(
        text.collapse(F.col(left)), text.collapse(F.col(right)), min_len, max_len
    )
    # Exploding keeps the search in one place; a filter would run it twice.
    return pairs.select(*key, F.explode(F.array_compact(F.array(longest))).alias("_p")).select(
        *key, "_p.*"
    )


def merge_runs(matches: DataFrame, diagonal: Sequence[str], pos: str) -> DataFrame:
    """(diagonal, start, length): neighbouring positions on a diagonal become one run."""
    require(matches, *diagonal, pos)
    distinct = matches.select(*diagonal, pos).distinct()
    placed = ordered.numbered(distinct, diagonal, [pos], "_rn", [ordered.line_block(pos)])
    return (
        placed.groupBy(*diagonal, (F.col(pos) - F.col("_rn")).alias("_run"))
        .agg(F.min(pos).alias("start"), F.count(F.lit(1)).alias("length"))
        .drop("_run")
    )


def broken_refs(refs: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    """References with no target; absolute URLs are exempt."""
    require(refs, key, "ref")
    require(inventory, "path")
    local = refs.filter(~text.is_absolute_url(F.col("ref")))
    return local.join(inventory.select(F.col("path").alias("ref")), "ref", "left_anti")


def three_way_drift(a: DataFrame, b: DataFrame, c: DataFrame, key: str, body: str) -> DataFrame:
    """(key, drift): which of three copies disagrees.

    The copies are stacked and grouped once. Only digests are shuffled.
    """
    stacked = None
    for name, df in (("a", a), ("b", b), ("c", c)):
        require(df, key, body)
        part = df.select(
            key, F.lit(name).alias("_src"), F.sha2(text.normalize_copy(F.col(body)), 256).alias("_h")
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    of = lambda n: F.max(F.when(F.col("_src") == n, F.col("_h"))).alias(f"_{n}")
    ha, hb, hc = F.col("_a"), F.col("_b"), F.col("_c")
    gaps = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNull(), n) for n in "abc"]))
    drift = (
        F.when(F.size(gaps) > 0, F.concat(F.lit("missing_"), F.array_join(gaps, "")))
        .when((ha == hb) & (hb == hc), "same")
        .when(hb == hc, "a_differs")
        .when(ha == hc, "b_differs")
        .when(ha == hb, "c_differs")
        .otherwise("all_differ")
    )
    return stacked.groupBy(key).agg(of("a"), of("b"), of("c")).select(key, drift.alias("drift"))


def visual_mix(
    slides: DataFrame, deck: str, *, image: str = r"(?i)<img\s", drawing: str = r"(?i)<svg\s",
    min_shots: int = 1, max_text_only: float = 0.7,
) -> DataFrame:
    """Per deck: slides with an image, with a drawing, with text only, and the verdict.

    Too few shots fail; too much plain text only warns.
    """
    require(slides, deck, "body")
    has_image, has_drawing = F.col("body").rlike(image), F.col("body").rlike(drawing)
    text_only = ~has_image & ~has_drawing
    return (
        slides.groupBy(deck)
        .agg(
            F.count(F.lit(1)).alias("slides"),
            F.count_if(has_image).alias("shots"),
            F.count_if(has_drawing).alias("drawings"),
            F.count_if(text_only).alias("text_only"),
        )
        .withColumn("text_only_ratio", F.col("text_only") / F.col("slides"))
        .withColumn(
            "verdict",
            F.when(F.col("shots") < min_shots, "fail")
            .when(F.col("text_only_ratio") > max_text_only, "warn")
            .otherwise("pass"),
        )
    )


def line_changes(new: DataFrame, base: DataFrame, key: str, body: str) -> DataFrame:
    """(key, change, line, copies): lines added and removed, as multisets."""
    require(new, key, body)
    require(base, key, body)

    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select(key, F.explode(text.lines(F.col(body))).alias("line"), F.lit(sign).alias("_s"))

    net = (
        signed(new, 1)
        .unionByName(signed(base, -1))
        .groupBy(key, "line")
        .agg(F.sum("_s").alias("_net"))
        .filter(F.col("_net") != 0)
    )
    return net.select(
        key, F.when(F.col("_net") > 0, "added").otherwise("removed").alias("change"), "line",
        F.abs("_net").alias("copies"),
    )


def baseline_diff(new: DataFrame, base: DataFrame, key: str, body: str, pages: str | None = None) -> DataFrame:
    """(key, chars_before, chars_after, [pages_before, pages_after], same_text) ignoring white space."""
    require(new, key, body)
    require(base, key, body)

    def facts(df: DataFrame, suffix: str) -> DataFrame:
        columns = [
            F.length(body).alias(f"chars_{suffix}"),
            F.sha2(text.squeeze(F.col(body)), 256).alias(f"_{suffix}"),
        ]
        if pages:
            columns.append(F.col(pages).alias(f"pages_{suffix}"))
        return df.select(key, *columns)

    joined = facts(base, "before").join(facts(new, "after"), key, "full_outer")
    same = F.coalesce(F.col("_before") == F.col("_after"), F.lit(False))
    return joined.withColumn("same_text", same).drop("_before", "_after")
