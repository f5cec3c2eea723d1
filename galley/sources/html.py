"""Elements of markup, found by pattern inside the row that holds the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import text
from galley.schema import require


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def explode_html_elements(pages: DataFrame, key: str, html: str, *tags: str) -> DataFrame:
    """(key, tag, pos, attrs, inner) for the elements of the tags, in one scan."""
    require(pages, key, html)

    def of_tag(page: Column, tag: str) -> Column:
        pattern = rf"(?is)<{tag}(\s[^>]*)?>(.*?)</{tag}>"
        return F.transform(
            F.regexp_extract_all(page, F.lit(pattern), F.lit(0)),
            lambda whole, pos: F.struct(
                F.lit(tag).alias("tag"),
                pos.alias("pos"),
                F.trim(F.regexp_extract(whole, pattern, 1)).alias("attrs"),
                F.regexp_extract(whole, pattern, 2).alias("inner"),
            ),
        )

    found = text.bind(
        without_comments(F.col(html)), lambda page: F.concat(*[of_tag(page, t) for t in tags])
    )
    return pages.select(key, F.explode(found).alias("_e")).select(key, "_e.*")


def attribute(attrs: Column, name: str) -> Column:
    """The value of a double-quoted attribute, NULL when it is absent."""
    pattern = rf'(?i)(?:^|\s){name}="([^"]*)"'
    return F.when(attrs.rlike(pattern), F.regexp_extract(attrs, pattern, 1))


def image_refs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, ref) for every image source."""
    require(pages, key, html)
    found = F.regexp_extract_all(F.col(html), F.lit(r'<img[^>]+src="([^"]+)"'), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("pos", "ref"))


def slides(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, slide_no, script, note, body): one row per slide section.

    The script attribute holds paragraphs split by a bar.
    """
    require(pages, key, html)
    opening = r'(?i)<section[^>]*class="slide"'
    parts = F.split(F.col(html), r'(?i)(?=<section[^>]*class="slide")')
    parts = F.filter(parts, lambda p: p.rlike(opening))
    exploded = pages.select(key, F.posexplode(parts).alias("pos", "_raw"))
    head = F.regexp_extract("_raw", r"(?s)^<section[^>]*>", 0)
    body = F.regexp_extract("_raw", r"(?is)^<section[^>]*>(.*?)(?:</section>|$)", 1)
    return exploded.select(
        key,
        (F.col("pos") + 1).alias("slide_no"),
        F.coalesce(attribute(head, "data-script"), F.lit("")).alias("script"),
        F.coalesce(attribute(head, "data-note"), F.lit("")).alias("note"),
        without_comments(body).alias("body"),
    )
