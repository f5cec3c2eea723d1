"""Cells of form documents, found inside the row that holds the section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import text
from galley.schema import require

# The marks of the form format.
CELL_OPEN = "<hp:tc"
CELL_ADDRESS = r'<hp:cellAddr\s+colAddr="(\d+)"\s+rowAddr="(\d+)"\s*/>'
CELL_TEXT = r"(?s)<hp:t>(.*?)</hp:t>"
EMPTY_RUN = r'<hp:run charPrIDRef="\d+"\s*/>'
PARAGRAPH = "<hp:p "
PICTURE = "<hp:pic "
STYLE = r'<hh:charPr id="(\d+)"[^>]*height="(\d+)"[^>]*?textColor="([^"]+)"'
ITALIC = "<hh:italic"
BOLD = "<hh:bold"
SPACING = r'<hh:spacing hangul="(-?\d+)"'


def _cells_of(xml: Column) -> Column:
    """All cells of a section in address order.

    A cell is known by its address mark and begins at the nearest opening
    before it. So the section is cut at openings, and a piece is cut at the
    addresses in it: address j owns the piece up to it.
    """
    pieces = F.split(xml, f"(?={CELL_OPEN})")

    def of_content(content: Column, row: Column, col: Column) -> Column:
        fragments = F.regexp_extract_all(content, F.lit(CELL_TEXT), F.lit(1))
        is_empty = content.rlike(EMPTY_RUN)
        before_gap = F.split(content, EMPTY_RUN, 2)[0]
        return text.bind(
            fragments,
            lambda found: F.struct(
                row.cast("int").alias("row"),
                col.cast("int").alias("col"),
                F.array_join(found, "").alias("text"),
                is_empty.alias("is_empty"),
                found.alias("fragments"),
                F.when(is_empty, F.regexp_count(before_gap, F.lit(CELL_TEXT))).alias("empty_at"),
                content.contains("<hp:run").alias("has_run"),
            ),
        )

    def of_piece(piece: Column) -> Column:
        parts = F.struct(
            F.regexp_extract_all(piece, F.lit(CELL_ADDRESS), F.lit(1)).alias("cols"),
            F.regexp_extract_all(piece, F.lit(CELL_ADDRESS), F.lit(2)).alias("rows"),
            F.split(piece, CELL_ADDRESS).alias("between"),
        )
        return text.bind(
            parts,
            lambda p: F.transform(
                p["cols"],
                lambda col, j: text.bind(
                    F.array_join(F.slice(p["between"], 1, j + 1), "<cut/>"),
                    lambda content: of_content(content, F.element_at(p["rows"], j + 1), col),
                ),
            ),
        )

    return F.flatten(F.transform(pieces, of_piece))


def form_cell_inventory(sections: DataFrame) -> DataFrame:
    """(doc_id, section, idx, row, col, text, is_empty, fragments, empty_at, has_run)."""
    require(sections, "doc_id", "section", "xml")
    return sections.select(
        "doc_id", "section", F.posexplode(_cells_of(F.col("xml"))).alias("idx", "_c")
    ).select("doc_id", "section", "idx", "_c.*")


def section_counts(sections: DataFrame) -> DataFrame:
    """Paragraphs and pictures per section."""
    require(sections, "doc_id", "section", "xml")
    return sections.select(
        "doc_id",
        "section",
        F.regexp_count("xml", F.lit(PARAGRAPH)).alias("paragraphs"),
        F.regexp_count("xml", F.lit(PICTURE)).alias("pictures"),
    )


def style_table(headers: DataFrame) -> DataFrame:
    """(doc_id, style_id, height, color, spacing, italic, bold) from style headers.

    Style numbers mean something only inside their own document.
    """
    require(headers, "doc_id", "xml")
    blocks = F.filter(
        F.split("xml", "(?=<hh:charPr )"), lambda b: b.rlike(STYLE)
    )
    spacing = F.regexp_extract("_b", SPACING, 1)
    return headers.select("doc_id", F.explode(blocks).alias("_b")).select(
        "doc_id",
        F.regexp_extract("_b", STYLE, 1).cast("int").alias("style_id"),
        F.regexp_extract("_b", STYLE, 2).cast("int").alias("height"),
        F.regexp_extract("_b", STYLE, 3).alias("color"),
        F.when(spacing != "", spacing).cast("int").alias("spacing"),
        F.col("_b").contains(ITALIC).alias("italic"),
        F.col("_b").contains(BOLD).alias("bold"),
    )


def text_fragments(sections: DataFrame) -> DataFrame:
    """(doc_id, section, pos, text) of every text fragment, in order."""
    require(sections, "doc_id", "section", "xml")
    found = F.regexp_extract_all("xml", F.lit(CELL_TEXT), F.lit(1))
    return sections.select("doc_id", "section", F.posexplode(found).alias("pos", "text"))
