import random

import pytest
from pyspark.sql import functions as F

from galley.functions import text
from galley.operators import drift
from galley.plans import drift_check
from galley.sources import html

SCRIPT = """# 1 구간
> 🔴 촬영 금지 지시
> 결론 세 문장은 이렇게 읽습니다 여러분
### 그런데 하나가 남았습니다 정말로
## 3~6분
| 표 | 는 읽지 않는다 |
- [ ] 체크리스트
---
오늘은 매출이 크게 올랐습니다 여러분. [출처: 통계]
"""


def test_spoken_lines(spark):
    rows = [(i, line) for i, line in enumerate(SCRIPT.split("\n"), 1)]
    kept = drift.spoken_lines(spark.createDataFrame(rows, "n int, line string")).orderBy("n").collect()
    assert [r.n for r in kept] == [3, 4, 9]


DECK = """<html><body>
<section class="slide" data-script="결론 세 문장은 이렇게 읽습니다 여러분|짧은 말" data-note="카메라를 보고 천천히 말하기"><h1>하나</h1><img src="a.png"></section>
<section data-x="1" class="slide" data-script="지운 문장이 그대로 남아 있습니다 여기에"><!-- <img src="x.png"> --><p>글자</p></section>
<section class="slide" data-script="서른한 퍼센트가 그렇게 답했습니다 분명히"><svg ></svg></section>
</body></html>"""


def test_missing_copy_and_verdict(spark):
    pages = spark.createDataFrame([("d", DECK)], "deck string, html string")
    slides = html.slides(pages, "deck", "html")
    assert slides.count() == 3
    scripts = spark.createDataFrame([("d", SCRIPT)], "deck string, script_text string")
    missing = drift.numeral_split(drift.missing_copy(slides, scripts, "deck")).orderBy("slide_no").collect()
    assert [(r.slide_no, r.severity) for r in missing] == [(2, "hard"), (3, "soft")]
    refs = html.image_refs(pages, "deck", "html")
    inventory = spark.createDataFrame([("a.png",)], "path string")
    broken = drift.broken_refs(refs, inventory, "deck")
    assert [r.ref for r in broken.collect()] == ["x.png"]
    verdict = drift_check.drift_verdict(slides, scripts, broken, "deck").first()
    assert (verdict.hard, verdict.soft, verdict.shots, verdict.broken_refs, verdict.verdict) == (1, 1, 1, 1, "fail")
    assert verdict.text_only_ratio == pytest.approx(1 / 3)


def test_only_the_first_25_characters_count(spark):
    head = "가나다라마바사아자차카타파하가나다라마바사아자차카"
    scripts = spark.createDataFrame([("d", head + " 뒤가 다르다")], "deck string, script_text string")
    rows = [("d", 1, head + "전혀 다른 끝"), ("d", 2, "나" + head), ("d", 3, "열한글자열한글자열한글")]
    slides = spark.createDataFrame(rows, "deck string, slide_no int, script string")
    assert [r.slide_no for r in drift.missing_copy(slides, scripts, "deck").collect()] == [2]


def longest_by_hand(left, right, low, high):
    for n in range(min(len(left), high), low - 1, -1):
        for start in range(len(left) - n + 1):
            if left[start : start + n] in right:
                return (start + 1, n, left[start : start + n])
    return None


@pytest.mark.parametrize("run", [11, 12, 80, 81, 95])
def test_shared_passage_edges(spark, run):
    common = "".join(chr(0xAC00 + i) for i in range(run))
    pairs = spark.createDataFrame([(1, "xx " + common + " yy", "zz " + common + " qq")], "id int, l string, r string")
    got = [(r.start, r.length, r.fragment) for r in drift.shared_passages(pairs, ["id"], "l", "r").collect()]
    wanted = longest_by_hand("xx " + common + " yy", "zz " + common + " qq", 12, 80)
    assert got == ([wanted] if wanted else [])


def test_shared_passages_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        make = lambda n: "".join(rng.choice("ab ") for _ in range(n))
        rows.append((i, make(rng.randint(0, 120)), make(rng.randint(0, 160))))
    pairs = spark.createDataFrame(rows, "id int, l string, r string")
    got = {r.id: (r.start, r.length, r.fragment) for r in drift.shared_passages(pairs, ["id"], "l", "r", 4, 9).collect()}
    wanted = {}
    for i, left, right in rows:
        hit = longest_by_hand(" ".join(left.split()), " ".join(right.split()), 4, 9)
        if hit:
            wanted[i] = hit
    assert got == wanted and len(wanted) > 30


def test_three_way(spark):
    make = lambda rows: spark.createDataFrame(rows, "k string, t string")
    a = make([("same", "말 **하기**"), ("b", "하나"), ("gone", "x")])
    b = make([("same", "말 하기"), ("b", "둘")])
    c = make([("same", "「말」 하기."), ("b", "하나"), ("gone", "x")])
    found = {r.k: r.drift for r in drift.three_way_drift(a, b, c, "k", "t").collect()}
    assert found == {"same": "same", "b": "b_differs", "gone": "missing_b"}


def test_line_changes_are_multisets(spark):
    make = lambda t: spark.createDataFrame([(1, t)], "id int, t string")
    base, new = make("a\nb\nb\nc"), make("a\nb\nd")
    found = {(r.change, r.line, r.copies) for r in drift.line_changes(new, base, "id", "t").collect()}
    assert found == {("removed", "b", 1), ("removed", "c", 1), ("added", "d", 1)}
    spaced = drift.baseline_diff(make("a b"), make("ab"), "id", "t").first()
    assert spaced.same_text and (spaced.chars_before, spaced.chars_after) == (2, 3)


def test_mask_is_whole(one):
    assert one(lambda c: text.mask(c), "x a@b.c y") == "x [email] y"


def test_empty_deck_is_no_pass(spark):
    slides = spark.createDataFrame([], "deck string, body string")
    assert drift.visual_mix(slides, "deck").count() == 0
    assert drift.visual_mix(
        spark.createDataFrame([("d", "text")], "deck string, body string"), "deck"
    ).select(F.col("verdict")).first().verdict == "fail"
