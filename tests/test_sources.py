import os

from pyspark.sql import functions as F

from galley.operators import layout, recall, routing
from galley.sources import assets, html, lines, sinks

SETTINGS = """key=before any header
; comment
[Video]
OutputCX=1280
FPS=a=b

[Audio]
Rate=48000
[Video]
OutputCX=1920
=novalue
"""


def test_settings(spark):
    docs = spark.createDataFrame([("f", SETTINGS)], "doc string, body string")
    got = {(r.section, r.key): r.value for r in lines.carry_forward_sections(lines.explode_lines(docs, "doc", "body")).collect()}
    assert got == {("Video", "OutputCX"): "1920", ("Video", "FPS"): "a=b", ("Audio", "Rate"): "48000"}


def test_marked_lines(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("하나\r\n둘\n🔵".encode())
    got = lines.read_marked_lines(spark, str(tmp_path / "*.md")).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in got] == [(1, "하나"), (2, "둘"), (3, "🔵")]
    # the symbol is found whatever the locale
    assert sum(r.line.startswith("🔵") for r in got) == 1


def test_elements(spark):
    page = '<p class="x">one</p><!-- <p>no</p> --><P>two\nlines</P><a href="/u">t</a>'
    rows = html.explode_html_elements(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html", "p", "a").collect()
    assert [(r.tag, r.pos, r.inner) for r in rows] == [("p", 0, "one"), ("p", 1, "two\nlines"), ("a", 0, "t")]
    refs = spark.createDataFrame([('class="b" href="/u"',)], "a string").select(html.attribute(F.col("a"), "href"))
    assert refs.first()[0] == "/u"


def test_assets(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"0" * 20
    files = {"a.png": png, "b.jpg": png, "c.gif": b"GIF89a" + b"1" * 10, "d.png": b"\xff\xd8\xff" + b"2" * 20,
             "e.webp": b"RIFF1234WEBPxxxx", "short": b"12345678901", "edge": b"123456789012", "big": b"3" * (6 * 1024 * 1024 + 1)}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {os.path.basename(r.path): (r.kind, r.status) for r in assets.scan_assets(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("png", "accepted"), "b.jpg": ("png", "reused"), "c.gif": ("gif", "accepted"),
                   "d.png": ("jpeg", "accepted"), "e.webp": ("webp", "accepted"), "short": (None, "too_small"),
                   "edge": (None, "unknown_kind"), "big": (None, "too_large")}


def test_upsert_rewrites_changed_partitions_only(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *r: spark.createDataFrame(r, "k int, v string, p int")
    sinks.upsert_changed(rows((1, "a", 1), (2, "b", 2)), path, "k", "p")
    before = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{path}/p=1") for f in fs}
    sinks.upsert_changed(rows((1, "a", 1), (2, "B", 2), (3, "c", 2)), path, "k", "p")
    after = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{path}/p=1") for f in fs}
    assert before == after
    assert {tuple(r) for r in spark.read.schema("k int, v string, p int").parquet(path).collect()} == {(1, "a", 1), (2, "B", 2), (3, "c", 2)}


def test_null_payload_is_a_value(spark):
    rows = lambda v: spark.createDataFrame([(1, v)], "k int, v string")
    action = lambda a, b: sinks.changed_records(rows(a), rows(b), "k", ["v"]).first().action
    assert action(None, "") == "update" and action(None, None) == "unchanged"


def test_snapshot_keeps_history(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = lambda d, v: spark.createDataFrame([(v, d)], "cpc int, survey_date string").withColumn("survey_date", F.col("survey_date").cast("date"))
    for d, v in (("2026-01-01", 1), ("2026-02-01", 2), ("2026-02-01", 3)):
        sinks.append_snapshot(rows(d, v), path)
    assert sorted(r.cpc for r in spark.read.parquet(path).collect()) == [1, 3]


def test_extents(spark):
    rows = [(1, 0, "a", 5.0, 720.0), (1, 1, "b", 5.0, 720.0), (2, 0, "a", -1.0, 721.0), (3, 0, "a", 0.0, 690.0), (4, 0, "h", 0.0, 900.0)]
    boxes = spark.createDataFrame([(s, p, e, t, b, 0.0 if s == 4 else 1.0, 0.0 if s == 4 else 1.0) for s, p, e, t, b in rows],
                                  "slide int, pos int, element string, top double, bottom double, width double, height double")
    got = {r.slide: r for r in layout.extents(boxes, ["slide"], 720, 20).collect()}
    assert (got[1].over, got[1].lowest, got[1].highest, got[1].status) == (False, "a", "a", "tight")
    assert (got[2].over, got[2].over_by, got[2].above, got[2].status) == (True, 1, True, "fail")
    assert got[3].status == "pass" and got[4].status == "unmeasured"


def test_segments(spark):
    minutes = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (6.0,), (13.0,)], "m double")
    got = [(r.segment, r.cta_allowed) for r in layout.segment_of(minutes, "m").orderBy("m").collect()]
    assert got == [("hook", False), ("result", False), ("result", False), ("immersion", True), ("overrun", False)]
    deck = spark.createDataFrame([("d", 1, 17.6), ("d", 2, 5.0)], "deck string, slide int, m double")
    assert abs(layout.pacing(deck, "deck", "m", "slide", 13.0).first().overrun - 4.6) < 1e-9


def test_byte_order(spark):
    names = spark.createDataFrame([("b",), ("a",), ("Z",), ("é",), ("🔵",), ("가",)], "n string")
    assert [r.n for r in recall.byte_order_sort(names, "n").collect()] == ["Z", "a", "b", "é", "가", "🔵"]


def test_map_objects(spark):
    texts = spark.createDataFrame([(1, "Acme rises"), (2, "acme and Beta"), (3, "nothing"), (4, "acme ACME corp")], "id int, body string")
    objects = spark.createDataFrame([("acme", "A"), ("corp", "A"), ("beta", "B")], "token string, object_id string")
    got = {r.id: (r.matched, r.object_id, r.route) for r in recall.map_objects(texts, objects, "id", "body").collect()}
    assert got == {1: (1, "A", "mapped"), 2: (2, "none", "review"), 3: (0, "none", "review"), 4: (1, "A", "mapped")}


def test_category(spark):
    rows = spark.createDataFrame([("lecture", None), ("decided", None), ("x", "object")], "text string, category string")
    got = [r.category for r in routing.with_category(rows, {"judgment": "decid"}).collect()]
    assert got == ["knowledge", "judgment", "object"]
