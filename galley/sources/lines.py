"""Text files as ordered lines, and key-value files with section headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import text
from galley.operators import ordered
from galley.schema import require

# Line shapes of settings files and of front matter.
SETTINGS_HEADER = r"^\[(.+)\]$"
FRONT_KEY = r"^([A-Za-z_]\w*)\s*:\s*(.*)$"
FRONT_ITEM = r"^\s+-\s+(.*)$"


def explode_lines(docs: DataFrame, key: str, body: str) -> DataFrame:
    """One row per line, numbered from 1, without a shuffle."""
    require(docs, key, body)
    return docs.select(key, F.posexplode(text.lines(F.col(body))).alias("pos", "line")).select(
        key, (F.col("pos") + 1).alias("line_no"), "line"
    )


def read_marked_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc, line_no, line) of whole text files; the path is the document."""
    docs = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc"), "value"
    )
    return explode_lines(docs, "doc", "value")


def carry_forward_sections(
    lines: DataFrame, key: str = "doc", header: str = SETTINGS_HEADER, comment: str = ";"
) -> DataFrame:
    """Settings lines to (doc, section, key, value).

    The last header owns the lines below it. Blank lines, comments and lines
    before the first header are left out; only the first = splits. A key given
    twice in one section keeps its last value.
    """
    require(lines, key, "line_no", "line")
    line = text.strip(F.col("line"))
    kept = lines.withColumn("line", line).filter(
        (F.col("line") != "") & ~F.col("line").startswith(comment)
    )
    head = F.when(F.col("line").rlike(header), F.regexp_extract("line", header, 1))
    owned = ordered.carry_forward(
        kept, [key], ["line_no"], head, "section", ordered.line_block("line_no")
    )
    at = F.instr("line", "=")
    return (
        owned.filter(F.col("section").isNotNull() & ~F.col("line").rlike(header) & (at > 1))
        .select(
            key,
            "section",
            F.expr("substring(line, 1, instr(line, '=') - 1)").alias("key"),
            F.struct("line_no", F.expr("substring(line, instr(line, '=') + 1)").alias("v")).alias("_v"),
        )
        .groupBy(key, "section", "key")
        .agg(F.max("_v").alias("_v"))
        .select(key, "section", "key", F.col("_v.v").alias("value"))
    )


def section_settings(
    docs: DataFrame, key: str, body: str, header: str = SETTINGS_HEADER, comment: str = ";"
) -> DataFrame:
    """Settings files to (doc, section, key, value), each file inside its row.

    The rules of `carry_forward_sections` without its shuffle: a file is cut in
    front of its headers, so each piece is a section with the lines it owns. Of a key
    given twice in one section the last value is kept, by a sort inside the row.
    """
    require(docs, key, body)
    rows = F.filter(F.transform(text.lines(F.col(body)), text.strip), lambda l: (l != "") & ~l.startswith(comment))
    pieces = F.split(F.array_join(rows, "\n"), rf"(?md)\n(?={header})")

    def settings(piece: Column) -> Column:
        def of_rows(owned: Column) -> Column:
            section = F.regexp_extract(owned[0], header, 1)
            below = F.slice(owned, 2, F.greatest(F.size(owned) - 1, F.lit(0)))
            given = F.filter(F.when(owned[0].rlike(header), below), lambda l: F.instr(l, "=") > 1)
            return F.transform(
                given,
                lambda l: F.struct(
                    section.alias("section"),
                    F.substring_index(l, "=", 1).alias("key"),
                    F.substring(l, F.instr(l, "=") + 1, F.length(l)).alias("value"),
                ),
            )

        return text.bind(text.lines(piece), of_rows)

    found = F.flatten(F.filter(F.transform(pieces, settings), lambda p: p.isNotNull()))
    placed = F.array_sort(
        F.transform(found, lambda e, i: F.struct(e["section"].alias("section"), e["key"].alias("key"), i.alias("at"), e["value"].alias("value")))
    )

    def is_last(s: Column, e: Column, i: Column) -> Column:
        after = F.get(s, i + 1)
        return after.isNull() | (after["section"] != e["section"]) | (after["key"] != e["key"])

    last = text.bind(placed, lambda s: F.filter(s, lambda e, i: is_last(s, e, i)))
    return docs.select(F.col(key), F.explode(last).alias("_s")).select(key, "_s.section", F.col("_s.key").alias("key"), F.col("_s.value").alias("value"))


def _unquote(c: Column) -> Column:
    bare = F.trim(F.regexp_replace(text.strip(c), r"\s+#.*$", ""))
    return F.trim(F.regexp_replace(bare, r"""^["'](.*)["']$""", "$1"))


def front_matter(docs: DataFrame, key: str, body: str) -> DataFrame:
    """The header block between --- lines as (doc, has_header, fields).

    `fields` maps a key to its values: a list keeps its items, a scalar is one
    value, an empty key is an empty list. A scalar is marked by `scalars`.
    """
    require(docs, key, body)
    block = F.regexp_extract(body, r"^---\r?\n([\s\S]*?)\r?\n---", 1)
    has_header = F.col(body).rlike(r"^---\r?\n[\s\S]*?\r?\n---")
    # A key line starts a block of its own; the items below it stay with it.
    pieces = F.split(block, r"\r?\n(?=[A-Za-z_]\w*\s*:)")
    pieces = F.filter(pieces, lambda p: p.rlike(r"^[A-Za-z_]\w*\s*:"))

    def field(piece: Column) -> Column:
        def of_rows(rows: Column) -> Column:
            items = F.transform(
                F.filter(
                    F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))),
                    lambda r: r.rlike(FRONT_ITEM) & ~text.strip(r).startswith("#"),
                ),
                lambda r: _unquote(F.regexp_extract(r, FRONT_ITEM, 1)),
            )
            scalar = _unquote(F.regexp_extract(rows[0], FRONT_KEY, 2))
            name = F.regexp_extract(rows[0], FRONT_KEY, 1)
            return F.struct(name.alias("name"), scalar.alias("scalar"), items.alias("items"))

        def of_parts(parts: Column) -> Column:
            # The first list item replaces a scalar written on the key line.
            is_list = (F.size(parts["items"]) > 0) | (parts["scalar"] == "")
            return F.struct(
                parts["name"].alias("name"),
                F.when(is_list, parts["items"]).otherwise(F.array(parts["scalar"])).alias("items"),
                is_list.alias("is_list"),
            )

        return text.bind(text.bind(text.lines(piece), of_rows), of_parts)

    return docs.select(
        key, has_header.alias("has_header"), F.when(has_header, F.transform(pieces, field)).alias("fields")
    )
