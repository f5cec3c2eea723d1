"""Work items: what is open, stale, superseded, colliding or next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions import text
from galley.operators import ordered
from galley.schema import require
from galley.session import shared_dir

# Marks of a handoff note.
STATUS_LINE = r"(?m)^> *상태: *(.*)$"
OPEN_LINE = r"(?m)^> *상태: *🔵"
CLOSED_LINE = r"(?m)^> *상태: *✅"
CONFIRMED = r"확인 (\d{4}-\d{2}-\d{2})"
CLOSED_ON = r"종결 \((\d{4}-\d{2}-\d{2})\)"
SUCCESSOR = r"후속: *(\S+)"
KEEP_OPEN = r"(?i)종결 아님|닫지 말|닫으면 통째로"
ONE_LINE_HEADING = r"## 한 줄"
HEAD_LINES = 15


def _date(c: Column) -> Column:
    return F.try_to_date(F.when(c != "", c), "yyyy-MM-dd")


def work_item_header(notes: DataFrame) -> DataFrame:
    """Handoff notes (name, body) to item columns, inside the row of each note.

    Notes that were written automatically are no work items.
    """
    require(notes, "name", "body")
    notes = notes.filter(~F.col("name").contains("autohandoff"))
    body = F.col("body")
    status = F.regexp_extract(body, STATUS_LINE, 1)
    confirmed = F.array_max(
        F.transform(F.regexp_extract_all(status, F.lit(CONFIRMED), F.lit(1)), _date)
    )
    head = F.array_join(F.slice(text.lines(body), 1, HEAD_LINES), "\n")
    section = F.regexp_extract(body, rf"(?ms)^{ONE_LINE_HEADING}[^\n]*\n(.*?)(?=^## |\z)", 1)
    plain = F.filter(
        text.lines(section),
        lambda r: ~r.rlike(r"^(##|--|> |~~)") & (r != "") & ~r.contains("⟳"),
    )
    bold = F.filter(plain, lambda r: r.startswith("**"))
    first = F.coalesce(F.try_element_at(bold, F.lit(1)), F.try_element_at(plain, F.lit(1)), F.lit(""))
    label = (
        F.when(body.rlike(CLOSED_LINE), "closed").when(body.rlike(OPEN_LINE), "open").otherwise("unmarked")
    )
    successor = F.regexp_extract(status, SUCCESSOR, 1)
    return notes.select(
        F.col("name").alias("item_id"),
        _date(F.regexp_extract("name", r"^(\d{4}-\d{2}-\d{2})", 1)).alias("item_date"),
        label.alias("status"),
        _date(F.regexp_extract(status, CLOSED_ON, 1)).alias("closed_on"),
        F.when(successor != "", successor).alias("successor"),
        confirmed.alias("confirmed_on"),
        head.rlike(KEEP_OPEN).alias("do_not_close"),
        first.alias("one_line"),
    )


def _cut(as_of: str, days: int) -> Column:
    return F.date_sub(F.lit(as_of).cast("date"), days)


def stale_items(items: DataFrame, as_of: str, days: int = 3) -> DataFrame:
    """Open items nobody touched or confirmed since the cut.

    An undated item is left out: nothing says that it is old.
    """
    require(items, "item_id", "item_date", "status", "confirmed_on")
    cut = _cut(as_of, days)
    silent = F.col("confirmed_on").isNull() | (F.col("confirmed_on") < cut)
    return items.filter((F.col("status") == "open") & (F.col("item_date") < cut) & silent)


def stale_work(items: DataFrame, as_of: str, days: int = 3, n: int = 3) -> DataFrame:
    """The n oldest stale items, each with the total number of stale items."""
    stale = stale_items(items, as_of, days)
    total = stale.agg(F.count(F.lit(1))).scalar()
    return stale.orderBy("item_date", "item_id").limit(n).withColumn("total", total)


def resume_candidates(items: DataFrame, as_of: str, days: int = 3) -> DataFrame:
    """Open items, and unmarked ones of today or yesterday, labelled NEW or OLD.

    OLD is folded in a report, never dropped. An undated item counts as NEW.
    """
    require(items, "item_id", "item_date", "status")
    today = F.lit(as_of).cast("date")
    recent = F.col("item_date").isin(today, F.date_sub(today, 1))
    wanted = (F.col("status") == "open") | (recent & (F.col("status") == "unmarked"))
    fold = F.when(F.col("item_date") < _cut(as_of, days), "OLD").otherwise("NEW")
    return items.filter(wanted).withColumn("fold", fold)


def fold_counts(candidates: DataFrame) -> DataFrame:
    """One row: how many are shown and how many are folded away."""
    require(candidates, "fold")
    return candidates.agg(
        F.count_if(F.col("fold") == "NEW").alias("shown"), F.count_if(F.col("fold") == "OLD").alias("folded")
    )


def backlog_health(items: DataFrame, as_of: str, days: int = 3) -> DataFrame:
    """One row: open, stale, share, and stale items that were confirmed since."""
    require(items, "item_date", "status", "confirmed_on")
    cut = _cut(as_of, days)
    is_open = F.col("status") == "open"
    old = is_open & (F.col("item_date") < cut)
    confirmed = F.coalesce(F.col("confirmed_on") >= cut, F.lit(False))
    n_open, n_stale = F.count_if(is_open), F.count_if(old)
    return items.agg(
        n_open.alias("open"),
        n_stale.alias("stale"),
        F.when(n_open > 0, n_stale / n_open).alias("share"),
        F.count_if(old & confirmed).alias("stale_confirmed"),
    )


EVIDENCE = ("path", "topic", "folder", "recency")


def own_last_item(candidates: DataFrame, session: str) -> DataFrame:
    """The item a session most likely worked on: (session, item_id, evidence, uncertain).

    An explicit path beats topic words, those beat the folder, and recency
    alone is marked uncertain. One aggregate; copies of a session never meet
    in one task unsummed.
    """
    require(candidates, session, "item_id", "ts", "by_path", "by_topic", "by_folder")
    rank = (
        F.when(F.col("by_path"), 1).when(F.col("by_topic"), 2).when(F.col("by_folder"), 3).otherwise(4)
    )
    best = F.min(F.struct(rank.alias("rank"), (-F.unix_micros("ts")).alias("age"), "item_id"))
    return (
        candidates.groupBy(session)
        .agg(best.alias("_b"))
        .select(
            session,
            F.col("_b.item_id").alias("item_id"),
            F.element_at(F.array(*[F.lit(e) for e in EVIDENCE]), F.col("_b.rank")).alias("evidence"),
            (F.col("_b.rank") == 4).alias("uncertain"),
        )
    )


def supersession_audit(items: DataFrame) -> DataFrame:
    """Adds open_predecessor and dangling for items that name a successor."""
    require(items, "item_id", "status", "successor")
    named = items.filter(F.col("successor").isNotNull())
    known = items.select(F.col("item_id").alias("successor"), F.lit(True).alias("_known"))
    return named.join(known, "successor", "left").select(
        "item_id",
        "successor",
        (F.col("status") == "open").alias("open_predecessor"),
        F.col("_known").isNull().alias("dangling"),
    )


def chain_tips(items: DataFrame, checkpoint_every: int = 2) -> DataFrame:
    """(item_id, tip, steps, cyclic): the last item of each chain of successors.

    Each round doubles the reach of every pointer, so a chain of a million items
    takes twenty rounds. Rounds that resolve nothing leave only cycles. The
    pointers are checkpointed in the shared folder, so a lost executor does not
    replay the rounds. An item that is listed several times counts once, with the
    smallest of its successors.
    """
    require(items, "item_id", "successor")
    items = items.groupBy("item_id").agg(F.min("successor").alias("successor"))
    shared_dir(items.sparkSession)
    known = items.select(F.col("item_id").alias("successor"), F.lit(True).alias("_known"))
    # A successor nobody knows ends its chain at the item that names it.
    state = items.select("item_id", "successor").join(known, "successor", "left").select(
        "item_id",
        F.when(F.col("_known"), F.col("successor")).otherwise(F.col("item_id")).alias("tip"),
        F.when(F.col("_known"), 1).otherwise(0).cast("long").alias("steps"),
        F.col("_known").isNull().alias("done"),
    ).checkpoint()
    waiting = state.filter(~F.col("done")).count()
    rounds = 0
    while waiting:
        ahead = state.select(
            F.col("item_id").alias("tip"), F.col("tip").alias("_tip"),
            F.col("steps").alias("_steps"), F.col("done").alias("_done"),
        )
        moving = state.filter(~F.col("done")).join(ahead, "tip").select(
            "item_id",
            F.col("_tip").alias("tip"),
            (F.col("steps") + F.col("_steps")).alias("steps"),
            F.col("_done").alias("done"),
        )
        state = state.filter("done").unionByName(moving)
        rounds += 1
        if rounds % checkpoint_every == 0:
            state = state.checkpoint()
            still = state.filter(~F.col("done")).count()
            if still == waiting:
                break
            waiting = still
    return state.select(
        "item_id",
        F.when(F.col("done"), F.col("tip")).alias("tip"),
        F.when(F.col("done"), F.col("steps")).alias("steps"),
        (~F.col("done")).alias("cyclic"),
    )


def collisions(candidates: DataFrame, journal_today: DataFrame, me: str) -> DataFrame:
    """Candidates with other_author and other_window, demoted behind the free ones."""
    require(candidates, "item_id", "ts")
    require(journal_today, "item_id", "author", "ts")
    # One row per item: was anyone else here, and when was the same author here.
    touched = journal_today.filter(F.col("author").isNotNull()).groupBy("item_id").agg(
        F.count_if(F.col("author") != me).alias("_others"),
        F.min(F.when(F.col("author") == me, F.col("ts"))).alias("_from"),
        F.max(F.when(F.col("author") == me, F.col("ts"))).alias("_to"),
    )
    other_author = F.coalesce(F.col("_others") > 0, F.lit(False))
    other_window = F.coalesce((F.col("_from") != F.col("ts")) | (F.col("_to") != F.col("ts")), F.lit(False))
    return (
        candidates.join(touched, "item_id", "left")
        .withColumn("other_author", other_author)
        .withColumn("other_window", other_window)
        .withColumn("demoted", F.col("other_author") | F.col("other_window"))
        .drop("_others", "_from", "_to")
    )


def stale_parents(progress: DataFrame, parents: DataFrame, min_sessions: int = 3) -> DataFrame:
    """Topics of several sessions whose parent document is older than their progress."""
    require(progress, "topic", "ts")
    require(parents, "topic", "edited")
    recent = progress.groupBy("topic").agg(
        F.count(F.lit(1)).alias("sessions"), F.max("ts").alias("latest")
    )
    return (
        recent.filter(F.col("sessions") >= min_sessions)
        .join(parents.select("topic", "edited"), "topic")
        .filter(F.col("edited") < F.col("latest"))
    )


TASK_GROUPS = {"In Progress": 1, "In Review": 2, "Todo": 3}


def task_focus(tasks: DataFrame, board: str) -> DataFrame:
    """(board, task, status, priority, place, suggested) in the order of work.

    Started work comes first, then reviews, then to-do by priority. The first
    place is the suggestion, unless it is a review: then the best to-do is. The
    order is cut into ranges, so a board with most of all tasks, or with one
    priority for all, is numbered by many tasks.
    """
    require(tasks, board, "task", "status", "priority")
    group = F.lit(None).cast("int")
    for status, rank in TASK_GROUPS.items():
        group = F.when(F.col("status") == status, rank).otherwise(group)
    active = tasks.withColumn("_group", group).filter(F.col("_group").isNotNull())
    placed = ordered.range_numbered(active, [board], ["_group", "priority", "task"], "place")
    pick = (
        active.filter(F.col("_group") != 2)
        .groupBy(board)
        .agg(F.min(F.struct("_group", "priority", "task"))["task"].alias("_pick"))
    )
    return placed.join(pick, board, "left").select(
        board, "task", "status", "priority", "place",
        F.coalesce(F.col("task") == F.col("_pick"), F.lit(False)).alias("suggested"),
    )


def _sessions(activity: DataFrame, by: str, gap_seconds: int, **counts: Column) -> DataFrame:
    """Sessions of (by, ts) with extra counts, cut where the pause reaches the gap.

    Rows in one slot of the length of the gap are never further apart than the
    gap, so each slot is summed to one row in the map tasks. What is put in
    order afterwards is one row per key and slot, however busy the key is.
    """
    gap = gap_seconds * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    slots = activity.groupBy(by, F.floor(at / gap).alias("_slot")).agg(
        F.min(at).alias("_from"), F.max(at).alias("_to"), *[c.alias(n) for n, c in counts.items()]
    )
    order = Window.partitionBy(by).orderBy("_slot")
    pause = F.col("_from") - F.lag("_to").over(order)
    starts = slots.withColumn("_new", F.when(pause < gap, 0).otherwise(1))
    return (
        starts.withColumn("_s", F.sum("_new").over(order))
        .groupBy(by, "_s")
        .agg(
            F.timestamp_micros(F.min("_from")).alias("started"),
            F.timestamp_micros(F.max("_to")).alias("ended"),
            *[F.sum(n).alias(n) for n in counts],
        )
        .drop("_s")
    )


def activity_sessions(activity: DataFrame, by: str, gap_seconds: int = 1_800) -> DataFrame:
    """(by, started, ended, prompts): activity cut where it pauses for the gap."""
    require(activity, by, "ts")
    return _sessions(activity, by, gap_seconds, prompts=F.count(F.lit(1)))


def interrupted_sessions(activity: DataFrame, saves: DataFrame, by: str, gap_seconds: int = 1_800) -> DataFrame:
    """Sessions with prompts and no save inside them.

    Saves are put in the same sessions as activity: a save belongs to the
    session it extends, so no range join is needed.
    """
    require(activity, by, "ts")
    require(saves, by, "ts")
    both = activity.select(by, "ts", F.lit(True).alias("_p")).unionByName(
        saves.select(by, "ts", F.lit(False).alias("_p"))
    )
    found = _sessions(
        both, by, gap_seconds, prompts=F.count_if(F.col("_p")), _saves=F.count_if(~F.col("_p"))
    )
    return found.filter((F.col("prompts") > 0) & (F.col("_saves") == 0)).drop("_saves")
