import datetime as dt

from galley.operators import worklog

AS_OF = "2026-08-18"
NOTE = """# 핸드오프 — 카드 명세서 정리
> 상태: {status}

## 한 줄
⟳ 갱신 2026-08-10
> 인용
보통 문장
{bold}

## 남은 것
**다른 굵은 줄**
"""


def test_header(spark):
    rows = [
        ("2026-08-07-handoff-a.md", NOTE.format(status="🔵 진행 — 닫지 말 것 (확인 2026-08-09) (확인 2026-08-16)", bold="**실질 문장**")),
        ("2026-08-08-handoff-b.md", NOTE.format(status="✅ 종결 (2026-08-10) → 후속: 2026-08-10-handoff-c.md", bold="")),
        ("handoff-undated.md", "# 제목만"),
    ]
    found = {r.item_id: r for r in worklog.work_item_header(spark.createDataFrame(rows, "name string, body string")).collect()}
    a, b, c = (found[name] for name, _ in rows)
    assert (a.status, a.item_date, a.confirmed_on) == ("open", dt.date(2026, 8, 7), dt.date(2026, 8, 16))
    assert a.do_not_close and a.one_line == "**실질 문장**" and a.successor is None
    assert (b.status, b.closed_on, b.successor) == ("closed", dt.date(2026, 8, 10), "2026-08-10-handoff-c.md")
    assert b.one_line == "보통 문장" and not b.do_not_close
    assert (c.status, c.item_date, c.one_line) == ("unmarked", None, "")


def items(spark):
    d = dt.date
    rows = [
        ("old", d(2026, 8, 1), "open", None),
        ("older", d(2026, 7, 1), "open", d(2026, 7, 2)),
        ("confirmed", d(2026, 7, 1), "open", d(2026, 8, 15)),  # exactly three days ago
        ("recent", d(2026, 8, 15), "open", None),
        ("undated", None, "open", None),
        ("closed", d(2026, 8, 1), "closed", None),
        ("closed_today", d(2026, 8, 18), "closed", None),
        ("bare", d(2026, 8, 17), "unmarked", None),
        ("bare_old", d(2026, 8, 10), "unmarked", None),
    ]
    return spark.createDataFrame(rows, "item_id string, item_date date, status string, confirmed_on date")


def test_stale_excludes_undated(spark):
    rows = worklog.stale_work(items(spark), AS_OF).collect()
    assert [(r.item_id, r.total) for r in rows] == [("older", 2), ("old", 2)]


def test_resume_keeps_undated(spark):
    rows = {r.item_id: r.fold for r in worklog.resume_candidates(items(spark), AS_OF).collect()}
    assert rows == {"old": "OLD", "older": "OLD", "confirmed": "OLD", "recent": "NEW", "undated": "NEW", "bare": "NEW"}


def test_backlog(spark):
    row = worklog.backlog_health(items(spark), AS_OF).first()
    assert (row.open, row.stale, row.stale_confirmed) == (5, 3, 1)
    empty = worklog.backlog_health(items(spark).limit(0), AS_OF).first()
    assert (empty.open, empty.share) == (0, None)


def test_chains(spark):
    rows = [(str(i), str(i + 1)) for i in range(300)] + [("300", None), ("x", "gone"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("into", "c1")]
    found = {r.item_id: r for r in worklog.chain_tips(spark.createDataFrame(rows, "item_id string, successor string")).collect()}
    assert len(found) == len(rows)
    assert all(found[str(i)].tip == "300" and found[str(i)].steps == 300 - i for i in range(301))
    assert found["x"].tip == "x" and not found["x"].cyclic
    assert all(found[k].cyclic and found[k].tip is None for k in ("c1", "c2", "c3", "into"))


def test_supersession(spark):
    rows = [("a", "open", "b"), ("b", "closed", "c"), ("c", "closed", "gone"), ("d", "open", None)]
    found = {r.item_id: (r.open_predecessor, r.dangling) for r in worklog.supersession_audit(
        spark.createDataFrame(rows, "item_id string, status string, successor string")).collect()}
    assert found == {"a": (True, False), "b": (False, False), "c": (False, True)}


def test_collisions(spark):
    t = lambda h: dt.datetime(2026, 8, 18, h)
    candidates = spark.createDataFrame([("a", t(9)), ("b", t(9)), ("c", t(9)), ("d", t(9))], "item_id string, ts timestamp")
    journal = spark.createDataFrame([("a", "kim", t(8)), ("b", "me", t(7)), ("c", "me", t(9)), ("d", None, t(7))], "item_id string, author string, ts timestamp")
    found = {r.item_id: (r.other_author, r.other_window, r.demoted) for r in worklog.collisions(candidates, journal, "me").collect()}
    assert found == {"a": (True, False, True), "b": (False, True, True), "c": (False, False, False), "d": (False, False, False)}


def test_tasks(spark):
    rows = [("m", "t1", "Todo", "P2"), ("m", "t2", "Todo", "P1"), ("m", "r", "In Review", "P1"), ("m", "d", "Done", "P1"),
            ("n", "w", "In Progress", "P3"), ("n", "t", "Todo", "P1"), ("o", "b", "Backlog", "P1")]
    found = {r.task: (r.place, r.suggested) for r in worklog.task_focus(
        spark.createDataFrame(rows, "board string, task string, status string, priority string"), "board").collect()}
    assert found == {"r": (1, False), "t2": (2, True), "t1": (3, False), "w": (1, True), "t": (2, False)}


def test_interrupted(spark):
    t = lambda h, m: dt.datetime(2026, 8, 18, h, m)
    prompts = spark.createDataFrame([("u", t(9, 0)), ("u", t(9, 20)), ("u", t(12, 0))], "who string, ts timestamp")
    saves = spark.createDataFrame([("u", t(9, 30)), ("u", t(18, 0))], "who string, ts timestamp")
    found = worklog.interrupted_sessions(prompts, saves, "who").collect()
    assert [(r.started, r.prompts) for r in found] == [(t(12, 0), 1)]
