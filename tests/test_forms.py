import pytest
from pyspark.sql import functions as F

from galley.functions import bands
from galley.operators import forms
from galley.sources import forms as source


def cell(row, col, inner):
    return f'<hp:tc name=""><hp:subList>{inner}</hp:subList><hp:cellAddr colAddr="{col}" rowAddr="{row}"/></hp:tc>'


def run(value):
    return f'<hp:run charPrIDRef="3"><hp:t>{value}</hp:t></hp:run>'


EMPTY = '<hp:run charPrIDRef="5"/>'
FORM = (
    '<hp:p id="1">'
    + cell(0, 0, run("성명"))
    + cell(0, 1, EMPTY)
    + cell(1, 0, run("둘 ") + run("조각"))
    + cell(1, 1, run("앞") + cell(0, 0, run("안")) + run("뒤"))
    + cell(2, 0, "")
    + "<hp:pic /></hp:p>"
)


@pytest.fixture
def sections(spark):
    return spark.createDataFrame([("f", 0, FORM)], "doc_id string, section int, xml string")


def test_inventory(sections):
    rows = source.form_cell_inventory(sections).orderBy("idx").collect()
    assert [(r.idx, r.row, r.col, r.text, r.is_empty) for r in rows] == [
        (0, 0, 0, "성명", False),
        (1, 0, 1, "", True),
        (2, 1, 0, "둘 조각", False),
        (3, 0, 0, "안", False),
        # the outer cell begins at the nearest opening before its address
        (4, 1, 1, "안뒤", False),
        (5, 2, 0, "", False),
    ]
    rolled = forms.form_rollup(source.form_cell_inventory(sections), source.section_counts(sections)).first()
    assert (rolled.cells, rolled.empties, rolled.paragraphs, rolled.pictures) == (6, 1, 1, 1)


def fill(spark, sections, *values):
    table = spark.createDataFrame(
        [("f", 0, *v) for v in values],
        "doc_id string, section int, row int, col int, occurrence int, mode string, value string",
    )
    rows = forms.fill_cells(source.form_cell_inventory(sections), table).collect()
    return {(r.row, r.col, r.occurrence): (r.text, r.status, r.error) for r in rows}


def test_fill_modes(spark, sections):
    got = fill(
        spark, sections,
        (0, 1, 0, "set", "홍<길동> & 씨"), (1, 0, 0, "set", "새"), (0, 0, 0, "append", ": 값"),
        (0, 0, 1, "whole", "둘째"), (1, 1, 0, "prepend", "앞에"), (2, 0, 0, "set", "x"),
        (9, 9, 0, "set", "x"), (0, 1, 1, "set", "x"),
    )
    assert got[(0, 1, 0)] == ("홍&lt;길동&gt; &amp; 씨", "filled", None)
    assert got[(1, 0, 0)] == ("새조각", "filled", None)
    assert got[(0, 0, 0)] == ("성명: 값", "filled", None)
    assert got[(0, 0, 1)] == ("둘째", "filled", None)
    assert got[(1, 1, 0)] == ("앞에안뒤", "filled", None)
    assert got[(2, 0, 0)] == ("", "error", "no_text_slot")
    assert got[(9, 9, 0)][1:] == ("error", "unknown_address")
    assert got[(0, 1, 1)][1:] == ("error", "unknown_address")


def test_fill_untouched_and_doubled(spark, sections):
    got = fill(spark, sections, (1, 0, 0, "set", "a"), (1, 0, 0, "set", "b"))
    assert got[(1, 0, 0)] == ("둘 조각", "error", "several_values")
    assert got[(0, 0, 0)] == ("성명", "untouched", None)


def test_counted_replace(spark, sections):
    found = forms.counted_replace(sections, "조각", "a<b").first()
    assert found.hits == 1 and "<hp:t>a&lt;b</hp:t>" in found.xml
    assert forms.counted_replace(sections, "charPr", "x").first().hits == 0


def keys(spark, rows, schema="key string"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    "expected, actual, verdict",
    [
        (["a", "b"], [("a", 1), ("b", 1)], "pass"),
        (["a", "b"], [("a", 1)], "fail"),
        (["a"], [("a", 1), ("c", 1)], "fail"),
        (["a"], [("a", 2)], "fail"),
        (["a"], [("a", 0)], "fail"),
        ([], [], "fail"),  # nothing expected must not pass
    ],
)
def test_reconcile(spark, expected, actual, verdict):
    rows = forms.reconcile_keys(
        keys(spark, [(k,) for k in expected]), keys(spark, actual, "key string, count int"), "key"
    )
    assert forms.reconcile_verdict(rows).first().verdict == verdict


def test_label_pairs(spark):
    rows = [("f", 0, 2, 3, "휴 대 폰", False), ("f", 0, 2, 4, " ", False), ("f", 0, 2, 5, "", True), ("f", 0, 3, 0, "끝", False)]
    cells = spark.createDataFrame(rows, "doc_id string, section int, row int, col int, text string, is_empty boolean")
    found = {(r.label, r.value_col, r.paired) for r in forms.label_value_pairs(cells).collect()}
    assert found == {("휴 대 폰", 5, True), ("끝", -1, False)}


def test_next_fragment(spark):
    rows = [("a", 0, "위와 같이 년도"), ("a", 1, "   "), ("a", 2, "분야"), ("b", 0, "없음"), ("c", 0, "년도")]
    fragments = spark.createDataFrame(rows, "doc string, pos int, text string")
    found = {r.doc: (r.following, r.status) for r in forms.next_fragment(fragments, ["doc"], "년도").collect()}
    assert found == {"a": ("   ", "ok"), "b": ("", "no_anchor"), "c": ("", "nothing_follows")}


def test_styles(spark):
    header = (
        '<hh:charPr id="7" height="1200" x="1" textColor="#000000"><hh:spacing hangul="-5"/><hh:italic/></hh:charPr>'
        '<hh:charPr id="8" height="900" textColor="#FF0000"></hh:charPr>'
    )
    styles = source.style_table(spark.createDataFrame([("f", header)], "doc_id string, xml string"))
    rows = {r.style_id: r for r in styles.collect()}
    assert (rows[7].height, rows[7].spacing, rows[7].italic, rows[7].bold) == (1200, -5, True, False)
    assert rows[8].spacing is None and not rows[8].italic
    assert [r.style_id for r in forms.body_styles(styles).collect()] == [7]


def test_geometry_golden(spark):
    row = spark.range(1).select(
        F.round(bands.pixels_to_mm(F.lit(152)), 1).alias("a"),
        F.round(bands.pixels_to_mm(F.lit(898)), 1).alias("b"),
        bands.mm_to_pixels(F.lit(0.01)).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == (40.2, 237.6, 1)
