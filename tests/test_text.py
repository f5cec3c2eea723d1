import pytest
from pyspark.sql import functions as F

from galley.functions import text
from galley.operators import rules, textstyle
from galley.plans import style_gate


@pytest.mark.parametrize(
    "value, wanted",
    [
        ("　 a b \n", "a b"),
        (" x﻿", "x"),
        ("", ""),
    ],
)
def test_strip(one, value, wanted):
    assert one(text.strip, value) == wanted


def test_normalize_copy(one):
    raw = "**그래서** 「이것」은 [출처: 통계청] `code` 31%—맞습니다…  정말?"
    assert one(text.normalize_copy, raw) == "그래서 이것은 31% 맞습니다 정말"


def test_utf16_length(one):
    assert one(text.utf16_length, "😀가a") == 4


def test_digits_per_100_golden(one):
    assert one(text.digits_per_100, "2026. 8.") == pytest.approx(62.5)


def test_escape_round_trip(one):
    assert one(text.escape, "a<b>&c") == "a&lt;b&gt;&amp;c"
    assert one(lambda c: text.unescape(text.escape(c)), "a<b>&amp;c") == "a<b>&amp;c"


def test_placed_quote(one):
    assert one(text.placed_quote, "!말 @ 함@12,30").asDict() == {
        "text": "말 @ 함", "x": 12, "y": 30, "accent": True,
    }
    assert one(text.placed_quote, "no place") is None


def test_minutes_text(one):
    assert one(lambda c: text.minutes_text(c.cast("double")), "83.25") == "1m 23.3s"


def test_literal_count(one):
    assert one(lambda c: text.literal_count(c, F.lit("aa")), "aaaaa") == 2


def test_placeholders(spark):
    docs = spark.createDataFrame(
        [(1, "이름 ____ <NAME_1> TODO"), (2, "mastodon <b> TODOS"), (3, "")], "id int, body string"
    )
    found = {r.id: (r.marks, r.first_five) for r in rules.placeholder_scan(docs, "id", "body").collect()}
    assert found == {1: (3, "____,<NAME_1>,TODO"), 2: (0, ""), 3: (0, "")}


def test_form_placeholders(spark):
    docs = spark.createDataFrame([(1, "201 년  월 ( 우편 :   ) 년  월  일")], "id int, body string")
    assert rules.placeholder_scan(docs, "id", "body", text.FORM_PLACEHOLDER).first().marks == 3


def test_sensitive(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c-d.co.kr or 010-1234-5678 now"), (2, "clean")], "id int, body string")
    found = {r.id: (r.kinds, r.masked) for r in rules.sensitive_scan(docs, "id", "body").collect()}
    assert found[1] == ("email,phone", "mail [email] or [phone] now")
    assert found[2] == ("", "clean")


def test_banned_korean(spark):
    docs = spark.createDataFrame([(1, "혁신적인 계획, 정답은 이것. 왜일까요?"), (2, "조용한 보고")], "id int, body string")
    found = {(r.id, r.kind): r.hits for r in rules.banned_phrases(docs, "id", "body").collect()}
    assert found == {
        (1, "forbidden_word"): 1, (1, "spoiler"): 1, (1, "future_tense"): 1, (1, "closing_question"): 1,
    }


@pytest.mark.parametrize("n, status", [(8, "short"), (9, "ok"), (13, "ok"), (14, "long")])
def test_main_copy_edges(spark, n, status):
    plans = spark.createDataFrame([(1, "main", "가" * n + "|" + "나" * 10)], "id int, kind string, body string")
    rows = rules.copy_line_lengths(plans, "id", "kind", "body").orderBy("pos").collect()
    assert [r.status for r in rows] == [status, "ok"]


def test_pages_of_a_plan_have_their_own_ranges(spark):
    pages = spark.createDataFrame([(1, "요약", "가" * 500), (2, "요약", "가" * 399), (3, "성장전략", "가" * 1201), (4, "부록", "가")], "id int, kind string, body string")
    got = {r.id: r.status for r in rules.length_bounds(pages, "id", "kind", "body").collect()}
    assert got == {1: "ok", 2: "short", 3: "long", 4: "no_rule"}


def test_body_scope(spark):
    cell = "가" * 50
    body = f"# 제목\n본문입니다.\n```\ncode\n```\n| 짧음 | {cell} |\n| a | b |\n끝."
    docs = spark.createDataFrame([(1, body)], "id int, body string")
    lines = [x for x in textstyle.body_scope(docs, "id", "body").first().body_text.split("\n") if x]
    assert lines == ["본문입니다.", cell, "끝."]


KOREAN = "오늘 매출이 올랐다. 왜 그럴까?\n이유를 찾았어요.\n\n- 매출 3배\n- 비용 절감\n\n그래서 적는다."


def test_style_metrics_korean(spark):
    docs = spark.createDataFrame([(1, KOREAN), (2, "Plain English text. It ends here.")], "id int, body string")
    rows = {r.id: r for r in textstyle.style_metrics(docs, "id", "body", min_hangul=0.3).collect()}
    ko, en = rows[1], rows[2]
    assert ko.sentence_count == 6
    assert ko.ending_ratio == pytest.approx(4 / 6 * 100)
    assert ko.ending_variety == 3
    assert ko.top_ending_share == pytest.approx(50)
    assert ko.narrative_ratio == pytest.approx(2 / 3 * 100)
    assert en.ending_ratio is None and en.ending_variety is None and en.symbols == 0


def test_endings_are_told_apart_by_the_longest_match(spark):
    """The published kinds, polite and plain endings each count as their own."""
    said = ["보고합니다.", "시작한다.", "문제이다!", "만들었다.", "바뀌었다.", "작아졌였다.", "남아 있다.", "했습니다.", "왜일까?", "그렇죠.", "좋네요.", "판다.", "명사"]
    docs = spark.createDataFrame([(1, "\n".join(said))], "id int, body string")
    got = textstyle.style_metrics(docs, "id", "body", min_hangul=0.3).first()
    kinds = ["니다", "한다", "이다", "었다", "었다", "였다", "있다", "니다", "까", "죠", "네요", "다"]
    assert got.ending_variety == len(set(kinds)) > 4
    assert got.ending_ratio == pytest.approx(12 / 13 * 100)
    assert got.top_ending_share == pytest.approx(2 / 12 * 100)
    seven = spark.createDataFrame([(1, "갑니다. " * 71 + "간다. " * 29)], "id int, body string")
    assert textstyle.style_metrics(seven, "id", "body", min_hangul=0.3).first().top_ending_share == pytest.approx(71)


def test_trade_phrases_are_judged_by_a_given_bound(spark):
    docs = spark.createDataFrame([(1, "혁신을 혁신한다. " * 20), (2, "매출을 적는다. 왜 줄었을까. 값을 내렸어요. " * 20)], "id int, body string")
    judge = lambda **k: {
        r.id: r.warnings.split(",")
        for r in style_gate.style_verdict(docs, "id", "body", "business_plan", min_share=0.5, min_hangul=0.3, **k).collect()
    }
    assert all("cliche_per_1000" not in w for w in judge().values())
    got = judge(cliches="혁신", cliche_bound=10.4)
    assert "cliche_per_1000" in got[1] and "cliche_per_1000" not in got[2]
    with pytest.raises(ValueError, match="together"):
        judge(cliches="혁신")


def test_profiles(spark):
    rows = [(1, "symbols", 2.0), (1, "ending_ratio", 50.0), (1, "digits_per_100", 9.0), (2, "symbols", 0.0)]
    metrics = spark.createDataFrame(rows, "doc_id int, axis string, value double")
    level = lambda p: {(r.axis, r.severity) for r in rules.apply_profile(metrics, p).collect()}
    assert level("business_plan") == {
        ("symbols", "violation"), ("ending_ratio", "violation"), ("digits_per_100", "warning"),
    }
    assert level("report") == {("symbols", "warning"), ("ending_ratio", "warning")}
    assert level(None) == level("report")
    with pytest.raises(ValueError, match="unknown_profile"):
        rules.apply_profile(metrics, "poem")


def test_unmeasured_text_is_no_pass(spark):
    table_only = "| 항목 | 값 |\n" * 400 + "2026. 8."
    docs = spark.createDataFrame([(1, table_only), (2, "짧게 말한다. " * 30), (3, "")], "id int, body string")
    got = style_gate.style_verdict(docs, "id", "body", "business_plan", min_share=0.5, min_hangul=0.3)
    verdicts = {r.id: r.verdict for r in got.collect()}
    assert verdicts[1] == "not_measured" and verdicts[3] == "not_measured"
    assert verdicts[2] == "pass_with_warnings"


def test_markup_loss(spark):
    before = spark.createDataFrame([(1, "**a** **b**"), (2, "plain")], "id int, body string")
    after = spark.createDataFrame([(1, "a **b**"), (2, "plain")], "id int, body string")
    found = {r.id: (r.before, r.after, r.lost) for r in textstyle.markup_loss(before, after, "id", "body").collect()}
    assert found == {1: (2, 1, True), 2: (0, 0, False)}


def test_candidate_limits(spark):
    call = "마감 2026. 8. 14(금) 16시까지\n글꼴 15pt, 최대 10페이지 이내\n각 1,000자 이상"
    docs = spark.createDataFrame([(1, call)], "id int, body string")
    found = rules.candidate_limits(docs, "id", "body")
    assert {(r.kind, r.value) for r in found.collect()} == {
        ("deadline", "2026. 8. 14(금) 16시"), ("font_size", "15"), ("page_cap", "10"), ("min_length", "1,000"),
    }
    assert rules.confirmed_limits(found).count() == 0


def test_question_tags_keep_noise(spark):
    rows = spark.createDataFrame([("임플란트 가격이 얼마인가요",), ("임플란트 게임 공략법",)], "q string")
    tagged = rules.question_tags(rows, "q", heads=("임플란트",), noise=("게임",)).collect()
    assert [(r.markers, r.head, r.noise) for r in tagged] == [
        ("가격", "임플란트", False), ("", "임플란트", True),
    ]
