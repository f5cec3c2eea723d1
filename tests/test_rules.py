import pytest

from galley.operators import rules
from galley.schema import RULES
from galley.sources import lines

RECORDING = [
    ("width", "equals", 1920.0, 0.0, None, True),
    ("fps", "at_least", 30.0, 0.5, None, True),
    ("kbps", "at_least", 8000.0, 0.0, "quality", True),
    ("lufs", "within", -14.0, 2.0, None, True),
    ("peak", "at_most", -1.0, 0.0, None, False),
]
GOOD = {"width": 1920.0, "fps": 29.5, "kbps": 9000.0, "lufs": -14.5, "peak": -1.2}


MEASURES = "asset string, metric string, value double, mode string, kind string"


def rule_table(spark):
    rows = [(*r, "video") for r in RECORDING] + [("kbps", "at_least", 64.0, 0.0, None, True, "sound")]
    return spark.createDataFrame(rows, RULES)


def judged(spark, values, mode=None):
    rows = [("v", m, v, mode, "video") for m, v in values.items()]
    measures = spark.createDataFrame(rows, MEASURES)
    return rules.judge(measures, rule_table(spark), ["asset"], "kind", "mode")


@pytest.mark.parametrize(
    "change, mode, status, verdict",
    [
        ({}, None, {}, "pass"),
        ({"lufs": -27.1}, None, {"lufs": "fail"}, "fail"),
        ({"lufs": -16.0}, None, {"lufs": "pass"}, "pass"),
        ({"lufs": None}, None, {"lufs": "unmeasured"}, "pass_with_warnings"),
        ({"fps": 29.4}, None, {"fps": "fail"}, "fail"),
        ({"kbps": 244.0}, None, {"kbps": "fail"}, "fail"),
        ({"kbps": 244.0}, "quality", {"kbps": "info"}, "pass"),
        ({"peak": 0.0}, None, {"peak": "warn"}, "pass_with_warnings"),
        ({"width": 1280.0}, None, {"width": "fail"}, "fail"),
    ],
)
def test_judge(spark, change, mode, status, verdict):
    rows = judged(spark, {**GOOD, **change}, mode)
    got = {r.metric: r.status for r in rows.collect()}
    assert {m: got[m] for m in status} == status
    result = rules.verdict(rows, ["asset"]).first()
    assert result.verdict == verdict
    assert result.failures == ",".join(sorted(m for m, s in got.items() if s == "fail"))


def test_a_missing_row_is_unmeasured(spark):
    rows = judged(spark, {k: v for k, v in GOOD.items() if k != "lufs"})
    assert {r.metric for r in rows.filter("status = 'unmeasured'").collect()} == {"lufs"}


def test_nothing_measured_is_no_pass(spark):
    empty = spark.createDataFrame([], MEASURES)
    rows = rules.judge(empty, rule_table(spark), ["asset"], "kind", "mode")
    assert rules.overall(rows).first().verdict == "not_measured"


def test_rules_of_another_kind_do_not_apply(spark):
    measures = spark.createDataFrame([("a", "kbps", 32.0, None, "sound")], MEASURES)
    rows = rules.judge(measures, rule_table(spark), ["asset"], "kind").collect()
    assert [(r.metric, r.status) for r in rows] == [("kbps", "fail")]


def test_each_kind_of_a_key_has_its_own_rules(spark):
    """A failing rule of one kind, a kind without rules and a missing kind all stay visible."""
    rows = [("a", "kbps", 32.0, None, "sound"), ("a", "fps", 30.0, None, "video"), ("b", "fps", 30.0, None, "else"), ("c", "fps", 30.0, None, None)]
    judged_rows = rules.judge(spark.createDataFrame(rows, MEASURES), rule_table(spark), ["asset"], "kind")
    got = {(r.asset, r.kind, r.metric): r.status for r in judged_rows.collect()}
    assert got["a", "sound", "kbps"] == "fail" and got["a", "video", "kbps"] == "unmeasured" and got["a", "video", "fps"] == "pass"
    assert got["b", "else", None] == got["c", None, None] == "unmeasured"
    found = {r.asset: r.verdict for r in rules.verdict(judged_rows, ["asset"]).collect()}
    assert found == {"a": "fail", "b": "pass_with_warnings", "c": "pass_with_warnings"}


OK = """---
channel: 채널
positioning: 저는 A가 아닙니다. B입니다.
target: 0~1K 시작자
tone: "겪은 것만 말한다." # 주석
pillars:
  - 하나
  # 설명
  - 둘
  - 셋
forbidden:
  - 넓은 말
---
본문"""
REQUIRED = ["channel", "positioning", "target", "tone", "pillars", "forbidden"]


@pytest.mark.parametrize(
    "text, errors",
    [
        (OK, []),
        (OK.replace("positioning: 저는 A가 아닙니다. B입니다.\n", ""), ["missing:positioning"]),
        (OK.replace("  - 셋", "  - 셋\n  - 넷"), ["too_many:pillars"]),
        (OK.replace('tone: "겪은 것만 말한다." # 주석', "tone: <말투>"), ["blank:tone"]),
        ("# 제목만", ["no_header"]),
        (OK.replace("forbidden:\n  - 넓은 말", "forbidden: 넓은 말"), ["not_a_list:forbidden"]),
        (OK.replace("pillars:\n  - 하나\n  # 설명\n  - 둘\n  - 셋", "pillars:"), ["blank:pillars"]),
        (OK.replace("\n", "\r\n"), []),
    ],
)
def test_contract(spark, text, errors):
    files = spark.createDataFrame([(1, text)], "id int, body string")
    found = rules.contract_check(
        lines.front_matter(files, "id", "body"), "id", REQUIRED, {"pillars": 3, "forbidden": None}
    ).first()
    assert list(found.errors) == errors and found.ok == (not errors)


def test_front_matter_values(spark):
    files = spark.createDataFrame([(1, OK)], "id int, body string")
    fields = {f["name"]: list(f["items"]) for f in lines.front_matter(files, "id", "body").first().fields}
    assert fields["tone"] == ["겪은 것만 말한다."] and fields["pillars"] == ["하나", "둘", "셋"]


def test_precedence(spark):
    rows = [
        ("font", "form", 1, "15pt"), ("font", "guide", 3, "12pt"), ("pages", "minutes", 4, "10"),
        ("name", "form", 1, "x"), ("name", "guide", 2, "x"), ("none", "form", 1, None),
    ]
    claims = spark.createDataFrame(rows, "field string, source string, priority int, value string")
    got = {r.field: (r.value, r.source, r.conflict, r.unsupported) for r in rules.resolve_precedence(claims, ["field"], 4).collect()}
    assert got == {
        "font": ("15pt", "form", True, False), "pages": ("10", "minutes", False, True), "name": ("x", "form", False, False),
    }


def test_catalog(spark):
    names = [("jobs:go-start",), ("go-save",), ("wrap-dev",), ("dev:wrap-dev",), ("other:thing",), ("review",), ("other:go-x",)]
    found = rules.catalog_bucket(
        spark.createDataFrame(names, "name string"), "name", {"go-": "team"}, {"jobs": "jobs", "dev": "dev"}, ["review"]
    )
    assert {r.name: r.bucket for r in found.collect()} == {
        "jobs:go-start": "team", "go-save": "team", "wrap-dev": "other", "dev:wrap-dev": "dev",
        "other:thing": "foreign", "review": "builtin", "other:go-x": "foreign",
    }


def test_tenant_guard(spark):
    rows = spark.createDataFrame([(1, "t", None), (2, "t", "A"), (3, "t", "B"), (4, "u", None)], "id int, token string, tenant_claimed string")
    claims = spark.createDataFrame([("t", "A")], "token string, tenant string")
    accepted, rejected = rules.tenant_guard(rows, claims, "token")
    assert {r.id: r.tenant for r in accepted.collect()} == {1: "A", 2: "A"}
    assert {r.id: r.reason for r in rejected.collect()} == {3: "tenant_mismatch", 4: "unknown_token"}


def test_missing_column_fails_early(spark):
    with pytest.raises(ValueError, match="missing columns"):
        rules.verdict(spark.range(1), ["asset"])
