"""Style and coverage of texts. A document is one row; nothing here needs its lines shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions import lexicon, text
from galley.operators import ordered
from galley.schema import require
from galley.session import shared_dir

FENCE = r"^\s*```"
LONG_CELL = 50


def running_fence(lines: DataFrame, key: str = "doc") -> DataFrame:
    """Adds in_fence: whether a line lies in a code block. Fence lines count as inside."""
    require(lines, key, "line_no", "line")
    flag = F.col("line").rlike(FENCE).cast("int")
    counted = ordered.running_total(
        lines, [key], ["line_no"], flag, "_fences", ordered.line_block("line_no")
    )
    inside = (F.col("_fences") % 2 == 1) | F.col("line").rlike(FENCE)
    return counted.withColumn("in_fence", inside).drop("_fences")


def fenced_lines(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, line_no, line, in_fence) of whole documents, each inside its row.

    The rules of `running_fence` without its shuffle: a document is cut in front of its
    fence lines, and the number of a piece tells how many fences came before.
    """
    require(docs, key, body)
    pieces = F.split(F.col(body), r"\r?\n(?=[^\S\n]*```)")

    def marked(parts: Column) -> Column:
        opened = parts[0].rlike(FENCE).cast("int")
        return F.flatten(
            F.transform(
                parts,
                lambda p, i: F.transform(
                    text.lines(p),
                    lambda l, n: F.struct(l.alias("line"), (((i + opened) % 2 == 1) | ((n == 0) & l.rlike(FENCE))).alias("in_fence")),
                ),
            )
        )

    rows = docs.select(key, F.posexplode(text.bind(pieces, marked)).alias("_pos", "_l"))
    return rows.select(key, (F.col("_pos") + 1).alias("line_no"), "_l.line", "_l.in_fence")


def body_text(c: Column) -> Column:
    """Prose of a document: no code blocks, headings or table rows.

    A table cell of 50 characters or more is prose that happens to sit in a table.
    """
    pieces = F.split(c, r"(?m)^[ \t]*```.*$")
    outside = F.filter(pieces, lambda piece, i: i % 2 == 0)
    rows = text.lines(F.array_join(outside, "\n"))

    def body_of(row: Column) -> Column:
        cells = F.filter(
            F.transform(F.split(row, r"\|"), text.strip), lambda cell: F.length(cell) >= LONG_CELL
        )
        return (
            F.when(row.rlike(r"^\s*#"), F.lit(None))
            .when(row.rlike(r"^\s*\|"), F.when(F.size(cells) > 0, F.array_join(cells, "\n")))
            .otherwise(row)
        )

    return F.array_join(F.array_compact(F.transform(rows, body_of)), "\n")


def body_scope(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, body_text, body_chars, doc_chars)."""
    require(docs, key, body)
    return docs.select(
        key, body_text(F.col(body)).alias("body_text"), F.length(body).alias("doc_chars")
    ).withColumn("body_chars", F.length("body_text"))


def _ending_of(sentence: Column, endings: Sequence[str]) -> Column:
    """The listed ending a sentence closes with, or NULL; of several the longest.

    The endings are levels of a suffix trie: the last characters of a sentence
    are looked up once for each length that occurs, the longest length first.
    """
    levels = []
    for size in sorted({len(e) for e in endings}, reverse=True):
        known = F.create_map(*[F.lit(x) for e in endings if len(e) == size for x in (e, e)])
        levels.append(lambda bare, n=size, known=known: F.try_element_at(known, F.right(bare, F.lit(n))))
    return text.bind(
        F.rtrim(sentence, F.lit(text.CLOSING + text.WHITE)), lambda bare: F.coalesce(*[level(bare) for level in levels])
    )


def style_metrics(
    docs: DataFrame,
    key: str,
    body: str,
    *,
    min_hangul: float,
    endings: Sequence[str] = lexicon.ENDINGS,
    cliches: str | None = None,
    contrast: str = lexicon.CONTRAST,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One wide row per document with every style axis, and the columns to keep.

    The four axes built on endings are NULL when the text is not Korean enough.
    """
    require(docs, key, body)

    def read(paragraph: Column) -> Column:
        """Whether a paragraph is a list, and the ending of each of its sentences."""
        return F.struct(
            paragraph.rlike(r"^\s*(?:[-*•]|\d+[.)])\s").alias("listed"),
            F.transform(text.sentences(paragraph), lambda s: _ending_of(s, endings)).alias("ends"),
        )

    hangul = F.coalesce(text.hangul_share(F.col("_t")), F.lit(0.0))
    # A sentence never crosses a blank line, so one pass serves both units.
    base = docs.select(key, *keep, F.col(body).alias("_t")).select(
        key,
        *keep,
        "_t",
        F.transform(text.paragraphs(F.col("_t")), read).alias("_p"),
        (hangul >= min_hangul).alias("_korean"),
    )
    base = base.withColumn("_all", F.flatten("_p.ends")).withColumn("_e", F.array_compact("_all"))
    chars = F.length("_t")
    n_sent, n_end = F.size("_all"), F.size("_e")
    narrative = F.filter(
        "_p", lambda p: ~p["listed"] & F.exists(p["ends"], lambda e: e.isNotNull())
    )

    def uses(ending: Column) -> Column:
        return F.size(F.filter("_e", lambda e: e == ending))

    top = F.array_max(F.transform(F.array_distinct("_e"), uses))

    def korean(value: Column) -> Column:
        return F.when(F.col("_korean"), value)

    def percent(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part * 100.0 / whole)

    cliche_count = F.regexp_count("_t", F.lit(cliches)) if cliches else F.lit(0)
    return base.select(
        key,
        *keep,
        chars.alias("body_chars"),
        n_sent.alias("sentence_count"),
        F.regexp_count("_t", F.lit(text.PROSE_SYMBOLS)).cast("double").alias("symbols"),
        text.digits_per_100(F.col("_t")).alias("digits_per_100"),
        korean(percent(n_end, n_sent)).alias("ending_ratio"),
        korean(percent(F.size(narrative), F.size("_p"))).alias("narrative_ratio"),
        korean(F.size(F.array_distinct("_e")).cast("double")).alias("ending_variety"),
        korean(percent(top, n_end)).alias("top_ending_share"),
        F.when(chars > 0, cliche_count * 1000.0 / chars).alias("cliche_per_1000"),
        F.when(chars > 0, F.regexp_count("_t", F.lit(contrast)) * 400.0 / chars).alias("contrast_per_400"),
    )


AXES = (
    "symbols", "digits_per_100", "ending_ratio", "narrative_ratio", "ending_variety",
    "top_ending_share", "cliche_per_1000", "contrast_per_400",
)


def axes_long(metrics: DataFrame, key: str) -> DataFrame:
    """Wide metrics to (key, axis, value); an axis that was not measured has no row."""
    pairs = F.array(
        *[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("value")) for a in AXES]
    )
    return (
        metrics.select(key, F.explode(pairs).alias("_a"))
        .select(key, "_a.*")
        .filter(F.col("value").isNotNull())
    )


def coverage_guard(metrics: DataFrame, *, min_share: float) -> DataFrame:
    """Adds share and coverage: too little text measured is not a clean result."""
    require(metrics, "body_chars", "doc_chars", "sentence_count")
    share = F.when(F.col("doc_chars") > 0, F.col("body_chars") / F.col("doc_chars"))
    measured = (share >= min_share) & (F.col("sentence_count") > 0)
    return metrics.withColumn("share", share).withColumn(
        "coverage",
        F.when(F.coalesce(measured, F.lit(False)), "measured").otherwise("not_measured"),
    )


def markup_loss(before: DataFrame, after: DataFrame, key: str, body: str) -> DataFrame:
    """(key, before, after, lost): emphasis must survive a rewrite.

    Only the two counts cross the network, not the texts.
    """
    require(before, key, body)
    require(after, key, body)

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.regexp_count(body, F.lit(r"\*\*[^*\n]+\*\*")).alias(name))

    joined = counted(before, "before").join(counted(after, "after"), key, "left")
    after_count = F.coalesce("after", F.lit(0))
    return joined.select(
        key, "before", after_count.alias("after"), (after_count < F.col("before")).alias("lost")
    )


def cross_section_repeats(sections: DataFrame, key: str, section: str, body: str, min_chars: int = 1) -> DataFrame:
    """(key, sentence, sections, copies) for sentences found in more than one section."""
    require(sections, key, section, body)
    found = sections.select(key, section, F.explode(text.sentences(F.col(body))).alias("sentence")).filter(
        F.length("sentence") >= min_chars
    )
    per_section = found.groupBy(key, "sentence", section).agg(F.count(F.lit(1)).alias("_n"))
    return (
        per_section.groupBy(key, "sentence")
        .agg(F.count(F.lit(1)).alias("sections"), F.sum("_n").alias("copies"))
        .filter(F.col("sections") > 1)
    )


def table_repeats(docs: DataFrame, key: str, body: str, min_chars: int = 10) -> DataFrame:
    """(key, cell): table cells that the prose of the same document says again."""
    require(docs, key, body)

    def repeated(rows: Column) -> Column:
        cells = F.flatten(
            F.transform(
                F.filter(rows, lambda r: r.startswith("|")),
                lambda r: F.transform(F.split(r, r"\|"), text.strip),
            )
        )
        prose = F.array_join(F.filter(rows, lambda r: ~r.startswith("|")), "\n")
        return text.bind(
            prose,
            lambda p: F.filter(
                F.array_distinct(cells), lambda c: (F.length(c) >= min_chars) & p.contains(c)
            ),
        )

    found = text.bind(F.transform(text.lines(F.col(body)), text.strip), repeated)
    return docs.select(key, F.explode(found).alias("cell"))


def volume_bounds(
    docs: DataFrame, key: str, chars: str, pages: str,
    char_range: tuple[int, int] = lexicon.PLAN_CHARS, page_range: tuple[int, int] = lexicon.PLAN_PAGES,
) -> DataFrame:
    """(key, chars_status, pages_status) of a whole document; a missing count is unmeasured."""
    require(docs, key, chars, pages)

    def status(c: Column, bounds: tuple[int, int]) -> Column:
        return (
            F.when(c.isNull(), "unmeasured")
            .when(c < bounds[0], "short")
            .when(c > bounds[1], "long")
            .otherwise("ok")
        )

    return docs.select(
        key, status(F.col(chars), char_range).alias("chars_status"), status(F.col(pages), page_range).alias("pages_status")
    )


def token_counts(docs: DataFrame, by: Sequence[str], body: str) -> DataFrame:
    """(by, token, n); repeats meet in the map tasks before the shuffle."""
    return (
        docs.select(*by, F.explode(text.tokens(F.col(body))).alias("token"))
        .groupBy(*by, "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def signature_terms(captions: DataFrame, channel: str, body: str, min_count: int, k: int = 5) -> DataFrame:
    """(channel, rank, token, n, score): words a channel uses far more than the others.

    Score is the share in the channel over the share in all channels. The
    counts are needed four times and are far smaller than the captions, so they
    are checkpointed in the shared folder: the captions are read once.
    """
    require(captions, channel, body)
    shared_dir(captions.sparkSession)
    counts = token_counts(captions, [channel], body).checkpoint()
    overall = counts.groupBy("token").agg(F.sum("n").alias("_all"))
    per_channel = counts.groupBy(channel).agg(F.sum("n").alias("_channel"))
    grand = counts.agg(F.sum("n")).scalar()
    score = (F.col("n") / F.col("_channel")) / (F.col("_all") / grand)
    scored = (
        counts.filter(F.col("n") >= min_count)
        .join(overall, "token")
        .join(per_channel, channel)
        .select(channel, "token", "n", score.alias("score"))
    )
    best = Window.partitionBy(channel).orderBy(F.desc("score"), F.desc("n"), "token")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.withColumn("score", F.round("score", 6))


def format_mix(
    blocks: DataFrame, key: str, kind: str, chars: str, targets: dict[str, float], tolerance: float
) -> DataFrame:
    """(key, kind, share, target, ok): how a document divides into text, table and image."""
    require(blocks, key, kind, chars)
    totals = blocks.groupBy(key).agg(
        F.sum(chars).alias("_all"),
        *[F.coalesce(F.sum(F.when(F.col(kind) == k, F.col(chars))), F.lit(0)).alias(k) for k in targets],
    )
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.col(k).alias("_part"), F.lit(float(t)).alias("target"))
            for k, t in targets.items()
        ]
    )
    share = F.when(F.col("_all") > 0, F.col("_part") * 100.0 / F.col("_all"))
    return (
        totals.select(key, "_all", F.explode(rows).alias("_r"))
        .select(key, "_all", "_r.*")
        .select(
            key, "kind", share.alias("share"), "target",
            (F.abs(share - F.col("target")) <= tolerance).alias("ok"),
        )
    )
