"""Drift, layout, form and rule-table queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.functions import bands, text
from galley.operators import drift, forms, layout, linediff, passages, rules
from galley.plans import drift_check
from galley.schema import RULES
from galley.session import scratch_path
from galley.sources import forms as form_source
from galley.sources import html, lines, sinks
from workload import sqltext as Q
from workload.registry import query, table, texts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents", "doc_id", "text")


# ---- copy drift ---------------------------------------------------------------

# Every fourth document was rewritten after its slides were made.
NARRATION_SQL = rf"""
spoken AS (
  SELECT doc_id, {Q.normalize_copy(
    "array_to_string(list_filter(list_transform(" + Q.lines("CASE WHEN doc_id % 4 = 0 THEN replace(text, 'e', 'i') ELSE text END")
    + ", lambda l: " + Q.strip("l") + r"), lambda l: l <> '' AND NOT starts_with(l, '|') AND NOT regexp_matches(l, '^-\s*\[[ x]\]|^(---|\*\*\*)$')"
    r" AND NOT (starts_with(l, '>') AND regexp_matches(l, '^>+\s*$')) AND NOT (starts_with(l, '#') AND regexp_matches(l, '^#{1,2}\s'))), ' ')"
  )} AS s FROM documents),
told AS (
  SELECT doc_id, 1 AS slide_no, unnest(list_filter(list_transform(string_split(
    replace(replace(text, '&quot;', ''), '&amp;', '&'), '|'), lambda p: {Q.normalize_copy('p')}), lambda p: length(p) >= 12)) AS sentence
  FROM (SELECT doc_id, regexp_replace(text, '[.]\s|\n', '|', 'g') AS text FROM documents)),
missing AS (
  SELECT doc_id, slide_no, sentence,
    CASE WHEN regexp_matches(sentence, '[0-9]') THEN 'soft' ELSE 'hard' END AS severity
  FROM told JOIN spoken USING (doc_id) WHERE NOT contains(s, substr(sentence, 1, 25)))"""


def narration(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Slides that narrate the documents, and scripts partly rewritten since."""
    docs = documents(spark, sf_dir)
    slides = docs.select(
        "doc_id", F.lit(1).alias("slide_no"), F.regexp_replace("text", r"[.]\s|\n", "|").alias("script"),
        F.col("text").alias("body"),
    )
    rewritten = F.when(F.col("doc_id") % 4 == 0, F.replace("text", F.lit("e"), F.lit("i"))).otherwise(F.col("text"))
    return slides, docs.select("doc_id", rewritten.alias("script_text"))


@query(
    "missing_copy",
    f"WITH {NARRATION_SQL} SELECT doc_id, slide_no, sha256(sentence) AS sentence_sha FROM missing",
)
def missing_copy(spark, sf_dir):
    slides, scripts = narration(spark, sf_dir)
    found = drift.missing_copy(slides, scripts, "doc_id")
    return found.select("doc_id", "slide_no", F.sha2("sentence", 256).alias("sentence_sha"))


@query(
    "numeral_split",
    f"WITH {NARRATION_SQL} SELECT doc_id, severity, count(*) AS sentences FROM missing GROUP BY ALL",
)
def numeral_split(spark, sf_dir):
    slides, scripts = narration(spark, sf_dir)
    found = drift.numeral_split(drift.missing_copy(slides, scripts, "doc_id"))
    return found.groupBy("doc_id", "severity").agg(F.count(F.lit(1)).alias("sentences"))


@query(
    "drift_verdict",
    rf"""WITH {NARRATION_SQL}, m AS (
  SELECT doc_id, count(*) FILTER (severity = 'hard') AS hard, count(*) FILTER (severity = 'soft') AS soft
  FROM missing GROUP BY 1),
r AS (SELECT doc_id, count(*) AS broken_refs FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '(\w+)\*\*\*', 1)) AS ref FROM documents)
  WHERE ref NOT IN (SELECT n_name FROM nation) GROUP BY 1),
j AS (
  SELECT doc_id, coalesce(hard, 0) AS hard, coalesce(soft, 0) AS soft,
    CAST(contains(text, 'tion') AS INT) AS shots,
    CASE WHEN contains(text, 'tion') OR contains(text, 'und') THEN 0.0 ELSE 1.0 END AS text_only_ratio,
    coalesce(broken_refs, 0) AS broken_refs
  FROM documents LEFT JOIN m USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, CASE WHEN hard > 0 OR broken_refs > 0 OR shots < 1 THEN 'fail'
  WHEN soft > 0 OR text_only_ratio > 0.7 THEN 'pass_with_warnings' ELSE 'pass' END AS verdict FROM j""",
)
def drift_verdict(spark, sf_dir):
    slides, scripts = narration(spark, sf_dir)
    found = F.regexp_extract_all("text", F.lit(r"(\w+)\*\*\*"), F.lit(1))
    refs = documents(spark, sf_dir).select("doc_id", F.explode(found).alias("ref"))
    inventory = table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"))
    broken = drift.broken_refs(refs, inventory, "doc_id")
    return drift_check.drift_verdict(slides, scripts, broken, "doc_id", image="tion", drawing="und")


@query(
    "shared_passages",
    rf"""WITH p AS (
  SELECT page_id, {Q.collapse("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS l,
    {Q.collapse("regexp_replace(regexp_replace(html, '(?is)<head>.*?</head>|<h1[^>]*>.*?</h1>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')")} AS r
  FROM pages),
c AS (
  SELECT page_id, l, r, unnest(range(1, length(l) + 1)) AS i FROM p WHERE length(l) >= 12 AND length(r) >= 12),
f AS (
  SELECT page_id, i AS start, n AS length, substr(l, i, n) AS fragment FROM (
    SELECT *, unnest(range(12, least(80, length(l) - i + 1) + 1)) AS n FROM c)
  WHERE contains(r, substr(l, i, n))),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length DESC, start) AS rn FROM f)
SELECT page_id, start, length, fragment FROM k WHERE rn = 1""",
)
def shared_passages(spark, sf_dir):
    """The heading of a page as the note, the rest of the page as the screen."""
    markup = F.col("html")
    rest = F.regexp_replace(markup, r"(?is)<head>.*?</head>|<h1[^>]*>.*?</h1>|<!--.*?-->", " ")
    pairs = texts(spark, sf_dir, "pages", "page_id", "html").select(
        "page_id",
        F.regexp_extract(markup, r"(?is)<h1[^>]*>(.*?)</h1>", 1).alias("note"),
        F.regexp_replace(rest, "<[^>]*>", " ").alias("screen"),
    )
    return drift.shared_passages(pairs, ["page_id"], "note", "screen")


@query(
    "corpus_passages",
    rf"""WITH l AS (SELECT doc_id, {Q.collapse('text')} AS t FROM documents), r AS (SELECT item_id, {Q.collapse('text')} AS t FROM benchmark),
lg AS (SELECT doc_id, i AS lp, substr(t, i, 40) AS g FROM (SELECT *, unnest(range(1, length(t) - 38)) AS i FROM l WHERE length(t) >= 40)),
rg AS (SELECT item_id, i AS rp, substr(t, i, 40) AS g FROM (SELECT *, unnest(range(1, length(t) - 38)) AS i FROM r WHERE length(t) >= 40)),
m AS (SELECT doc_id, item_id, rp - lp AS d, lp FROM lg JOIN rg USING (g)),
n AS (SELECT *, lp - row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY lp) AS run FROM m),
f AS (SELECT doc_id, item_id, min(lp) AS start, least(80, count(*) + 39) AS length FROM n GROUP BY doc_id, item_id, d, run),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY length DESC, start) AS rn FROM f)
SELECT doc_id, item_id, start, k.length, substr(t, CAST(start AS BIGINT), CAST(k.length AS BIGINT)) AS fragment FROM k JOIN l USING (doc_id) WHERE rn = 1""",
)
def corpus_passages(spark, sf_dir):
    """All documents against all benchmark items: runs of 40 characters and more."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return passages.corpus_passages(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), "doc_id", "item_id", "text")


@query(
    "merge_runs",
    """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
n AS (SELECT user_id, day, date_diff('day', DATE '2024-01-01', day) AS pos,
    row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn FROM d)
SELECT user_id, min(pos) AS start, count(*) AS length FROM n GROUP BY user_id, pos - rn""",
)
def merge_runs(spark, sf_dir):
    """Neighbouring days of activity as neighbouring positions."""
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    matches = table(spark, sf_dir, "events", "user_id", "ts").select("user_id", day.alias("pos"))
    return drift.merge_runs(matches, ["user_id"], "pos")


@query(
    "broken_refs",
    r"""WITH r AS (
  SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?i)<a\s[^>]*?href="([^"]*)"', 1)) AS ref
  FROM pages),
i AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS section FROM pages)
SELECT page_id, ref, count(*) AS uses FROM r
WHERE NOT regexp_matches(ref, '(?i)^https?:') AND regexp_extract(ref, '^/*([^/?#]*)', 1) NOT IN (SELECT section FROM i) GROUP BY ALL""",
)
def broken_refs(spark, sf_dir):
    """Links by the section their path begins with, against the sections that exist."""
    pages = texts(spark, sf_dir, "pages", "page_id", "url", "html")
    links = html.explode_html_elements(pages, "page_id", "html", "a")
    refs = links.select("page_id", html.attribute(F.col("attrs"), "href").alias("full"))
    refs = refs.withColumn("ref", F.when(text.is_absolute_url(F.col("full")), F.col("full")).otherwise(F.regexp_extract("full", r"^/*([^/?#]*)", 1)))
    inventory = pages.select(F.regexp_extract("url", r"^https?://[^/]+/([^/?#]*)", 1).alias("path")).distinct()
    broken = drift.broken_refs(refs, inventory, "page_id")
    return broken.groupBy("page_id", F.col("full").alias("ref")).agg(F.count(F.lit(1)).alias("uses"))


@query(
    "visual_mix",
    r"""WITH s AS (
  SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host,
    regexp_matches(html, '(?i)<b>') AS img, regexp_matches(html, '(?i)<table') AS svg
  FROM (SELECT url, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS html FROM pages)),
c AS (
  SELECT host, count(*) AS slides, count(*) FILTER (img) AS shots, count(*) FILTER (svg) AS drawings,
    count(*) FILTER (NOT img AND NOT svg) AS text_only FROM s GROUP BY 1)
SELECT host, slides, shots, drawings, text_only, round(text_only / slides, 6) AS text_only_ratio,
  CASE WHEN shots < 1 THEN 'fail' WHEN text_only / slides > 0.7 THEN 'warn' ELSE 'pass' END AS verdict FROM c""",
)
def visual_mix(spark, sf_dir):
    """Pages of a host as slides; bold text stands for images, tables for drawings."""
    slides = table(spark, sf_dir, "pages", "url", "html").select(
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"),
        html.without_comments(F.col("html")).alias("body"),
    )
    mix = drift.visual_mix(slides, "host", image="(?i)<b>", drawing="(?i)<table")
    return mix.withColumn("text_only_ratio", F.round("text_only_ratio", 6))


@query(
    "three_way_drift",
    """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'missing_bc' ELSE 'missing_c' END
    WHEN doc_id % 5 = 0 THEN 'missing_b' WHEN doc_id % 7 = 0 AND doc_id % 3 = 0 THEN 'all_differ'
    WHEN doc_id % 7 = 0 THEN 'b_differs' WHEN doc_id % 3 = 0 THEN 'c_differs' ELSE 'same' END AS drift
FROM documents""",
)
def three_way_drift(spark, sf_dir):
    a = documents(spark, sf_dir)
    # A copy without a text is missing like one without a row.
    there = lambda n, c: F.when(F.col("doc_id") % n != 0, c)
    b = a.withColumn(
        "text", there(5, F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" zwei"))).otherwise(F.concat(F.lit(" **"), "text")))
    )
    c = a.withColumn(
        "text", there(11, F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" trois"))).otherwise(F.concat("text", F.lit("!\n"))))
    )
    return drift.three_way_drift(a, b, c, "doc_id", "text")


CHANGED_SQL = r"""
changed AS (
  SELECT doc_id, text AS base, CASE doc_id % 3 WHEN 0 THEN replace(text, ' ', '  ')
    WHEN 1 THEN regexp_replace(text, '\n[^\n]*$', '') ELSE text || chr(10) || 'added' END AS new FROM documents)"""


def changed(docs: DataFrame) -> DataFrame:
    rest = F.col("doc_id") % 3
    new = (
        F.when(rest == 0, F.replace("text", F.lit(" "), F.lit("  ")))
        .when(rest == 1, F.regexp_replace("text", r"\n[^\n]*\z", ""))
        .otherwise(F.concat("text", F.lit("\nadded")))
    )
    return docs.withColumn("text", new)


@query(
    "baseline_diff",
    f"""WITH {CHANGED_SQL}
SELECT doc_id, length(base) AS chars_before, length(new) AS chars_after,
  {Q.squeeze('base')} = {Q.squeeze('new')} AS same_text FROM changed""",
)
def baseline_diff(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return drift.baseline_diff(changed(docs), docs, "doc_id", "text")


@query(
    "line_changes",
    f"""WITH {CHANGED_SQL}, l AS (
  SELECT doc_id, unnest({Q.lines('new')}) AS line, 1 AS s FROM changed
  UNION ALL SELECT doc_id, unnest({Q.lines('base')}), -1 FROM changed),
n AS (SELECT doc_id, line, sum(s) AS net FROM l GROUP BY ALL HAVING sum(s) <> 0)
SELECT doc_id, CASE WHEN net > 0 THEN 'added' ELSE 'removed' END AS change, sha256(line) AS line_sha,
  abs(net) AS copies FROM n""",
)
def line_changes(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = drift.line_changes(changed(docs), docs, "doc_id", "text")
    return found.select("doc_id", "change", F.sha2("line", 256).alias("line_sha"), "copies")


@query(
    "ordered_changes",
    f"""WITH {CHANGED_SQL}, l AS (SELECT doc_id, {Q.lines('base')} AS old, {Q.lines('new')} AS new FROM changed),
s AS (
  SELECT doc_id, 'removed' AS change, i AS line_no, old[i] AS line FROM (SELECT *, unnest(range(1, len(old) + 1)) AS i FROM l)
  WHERE old[i] IS DISTINCT FROM new[i]
  UNION ALL SELECT doc_id, 'added', i, new[i] FROM (SELECT *, unnest(range(1, len(new) + 1)) AS i FROM l) WHERE old[i] IS DISTINCT FROM new[i])
SELECT doc_id, change, line_no, sha256(line) AS line_sha FROM s""",
)
def ordered_changes(spark, sf_dir):
    """The changes leave each line at its place, so the SQL compares places; the query does not know that."""
    docs = documents(spark, sf_dir)
    found = linediff.ordered_changes(changed(docs), docs, "doc_id", "text")
    return found.select("doc_id", "change", "line_no", F.sha2("line", 256).alias("line_sha"))


@query(
    "apply_changes",
    f"""WITH {CHANGED_SQL} SELECT doc_id, sha256(array_to_string({Q.lines('new')}, chr(10))) AS text_sha FROM changed""",
)
def apply_changes(spark, sf_dir):
    docs = documents(spark, sf_dir)
    script = linediff.ordered_changes(changed(docs), docs, "doc_id", "text")
    return linediff.apply_changes(docs, script, "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("text_sha"))


# ---- layout ---------------------------------------------------------------

BOXES_SQL = """
boxes AS (
  SELECT l_orderkey AS deck, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS pos, 'e' || l_suppkey % 5 AS element,
    l_quantity * 4 - 20.5 AS top, l_quantity * 16 + l_linenumber AS bottom,
    l_discount * 100 AS width, CASE WHEN l_discount = 0 THEN 0.0 ELSE 5.0 END AS height FROM lineitem)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("deck"),
        (F.col("l_linenumber") * 1_000_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("pos"),
        F.concat(F.lit("e"), F.col("l_suppkey") % 5).alias("element"),
        (F.col("l_quantity") * 4 - 20.5).alias("top"),
        (F.col("l_quantity") * 16 + F.col("l_linenumber")).alias("bottom"),
        (F.col("l_discount") * 100).alias("width"),
        F.when(F.col("l_discount") == 0, 0.0).otherwise(5.0).alias("height"),
    )


@query(
    "extents",
    f"""WITH {BOXES_SQL}, v AS (SELECT * FROM boxes WHERE NOT (width = 0 AND height = 0)),
g AS (
  SELECT deck, min(top) AS t, max(bottom) AS b,
    first(element ORDER BY bottom DESC, pos) AS lowest, first(element ORDER BY top, pos) AS highest FROM v GROUP BY 1)
SELECT d.deck, CAST(floor(t + 0.5) AS DOUBLE) AS top, CAST(floor(b + 0.5) AS DOUBLE) AS bottom, b > 720 AS over,
  greatest(0, CAST(floor(b - 720 + 0.5) AS DOUBLE)) AS over_by, t < 0 AS above, lowest, highest,
  CASE WHEN b IS NULL THEN 'unmeasured' WHEN b > 720 OR t < 0 THEN 'fail' WHEN floor(b + 0.5) > 680 THEN 'tight' ELSE 'pass' END AS status
FROM (SELECT DISTINCT deck FROM boxes) d LEFT JOIN g ON g.deck = d.deck""",
)
def extents(spark, sf_dir):
    found = layout.extents(boxes(spark, sf_dir), ["deck"], 720.0, 40.0)
    # with nothing measured there is no amount either
    return found.select(
        "deck", F.col("top").cast("double"), F.col("bottom").cast("double"), "over",
        F.col("over_by").cast("double"), "above", "lowest", "highest", "status",
    )


@query(
    "invalid_measurements",
    """SELECT l_orderkey AS deck, count(*) FILTER (l_tax = 0 OR l_returnflag = 'R') AS unloaded FROM lineitem
GROUP BY 1 HAVING count(*) FILTER (l_tax = 0 OR l_returnflag = 'R') > 0""",
)
def invalid_measurements(spark, sf_dir):
    """Untaxed lines are images that did not load, returned ones were not looked at."""
    images = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("deck"),
        F.when(F.col("l_returnflag") != "R", F.col("l_tax") != 0).alias("loaded"),
    )
    return layout.invalid_measurements(images, ["deck"])


@query(
    "page_rollup",
    """SELECT l_suppkey AS doc, count(DISTINCT l_linenumber) AS pages, sum(length(l_returnflag || l_linestatus)) AS chars,
  count(*) FILTER (l_quantity * 12 > 595 - 5) AS overflow_lines,
  round(min(l_quantity) / 72 * 25.4, 6) AS left_mm, round(min(l_tax) / 72 * 25.4, 6) AS top_mm,
  round(max(l_quantity * 12) / 72 * 25.4, 6) AS right_mm, round(max(l_discount * 100) / 72 * 25.4, 6) AS bottom_mm
FROM lineitem GROUP BY 1""",
)
def page_rollup(spark, sf_dir):
    page_lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), F.lit(595.0).alias("page_width"),
        F.col("l_quantity").alias("x0"), F.col("l_tax").alias("y0"), (F.col("l_quantity") * 12).alias("x1"),
        (F.col("l_discount") * 100).alias("y1"), F.concat("l_returnflag", "l_linestatus").alias("text"),
    )
    rolled = layout.page_rollup(page_lines, "doc")
    return rolled.select(
        "doc", "pages", "chars", "overflow_lines",
        *[F.round(c, 6).alias(c) for c in ("left_mm", "top_mm", "right_mm", "bottom_mm")],
    )


@query(
    "page_expectation",
    """WITH r AS (
  SELECT l_suppkey AS doc, count(DISTINCT l_linenumber) AS pages, count(*) FILTER (l_quantity * 12 > 590) AS o
  FROM lineitem GROUP BY 1)
SELECT s_suppkey AS doc, CASE WHEN pages IS NULL THEN 'unmeasured'
  WHEN pages = 6 + s_suppkey % 2 AND o = 0 THEN 'pass' ELSE 'fail' END AS status
FROM supplier LEFT JOIN r ON doc = s_suppkey""",
)
def page_expectation(spark, sf_dir):
    page_lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), F.lit(595.0).alias("page_width"),
        F.col("l_quantity").alias("x0"), F.col("l_tax").alias("y0"), (F.col("l_quantity") * 12).alias("x1"),
        F.col("l_tax").alias("y1"), F.col("l_returnflag").alias("text"),
    )
    expected = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("doc"), (6 + F.col("s_suppkey") % 2).alias("expected_pages")
    )
    judged = layout.page_expectation(layout.page_rollup(page_lines, "doc"), expected, "doc")
    return judged.select("doc", "status")


@query(
    "image_sizes",
    """SELECT l_suppkey AS doc, l_linenumber AS page, round(l_quantity / 72 * 25.4, 6) AS w_mm, round(l_tax / 72 * 25.4, 6) AS h_mm,
  round(l_discount / 72 * 25.4, 6) AS x_mm, round(l_linenumber / 72 * 25.4, 6) AS y_mm FROM lineitem""",
)
def image_sizes(spark, sf_dir):
    images = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("w"),
        F.col("l_tax").alias("h"), F.col("l_discount").alias("x"), F.col("l_linenumber").alias("y"),
    )
    sized = layout.image_sizes(images, "doc")
    return sized.select("doc", "page", *[F.round(c, 6).alias(c) for c in ("w_mm", "h_mm", "x_mm", "y_mm")])


@query(
    "height_fit",
    """SELECT l_orderkey AS doc, sum(l_quantity) AS required_mm, 150 - sum(l_quantity) AS spare_mm, sum(l_quantity) <= 150 AS fits
FROM lineitem GROUP BY 1""",
)
def height_fit(spark, sf_dir):
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_quantity").alias("height_mm"))
    return layout.height_fit(blocks, ["doc"], 150.0)


@query(
    "segment_of",
    """WITH u AS (SELECT event_id, (date_part('hour', ts) * 60 + date_part('minute', ts)) / 100.0 AS m FROM events)
SELECT event_id, CASE WHEN m < 1 THEN 'hook' WHEN m < 3 THEN 'result' WHEN m < 6 THEN 'practice'
  WHEN m < 13 THEN 'immersion' ELSE 'overrun' END AS segment, m >= 6 AND m < 13 AS cta_allowed FROM u""",
)
def segment_of(spark, sf_dir):
    utterances = table(spark, sf_dir, "events", "event_id", "ts").select(
        "event_id", ((F.hour("ts") * 60 + F.minute("ts")) / 100.0).alias("at_min")
    )
    return layout.segment_of(utterances, "at_min").select("event_id", "segment", "cta_allowed")


@query(
    "segments_of_deck",
    """WITH u AS (
  SELECT event_id, length(event_type) AS deck, (date_part('hour', ts) * 60 + date_part('minute', ts)) / 100.0 AS m FROM events),
s AS (
  SELECT r_regionkey + 4 AS deck, 's' || k AS segment, k * 2.5 AS a, k * 2.5 + 1.75 AS b
  FROM region, range(0, 6) t(k))
SELECT event_id, CASE WHEN segment IS NOT NULL THEN segment
  WHEN m < (SELECT max(b) FROM s e WHERE e.deck = u.deck) THEN 'gap' ELSE 'overrun' END AS segment
FROM u LEFT JOIN s ON u.deck = s.deck AND m >= a AND m < b""",
)
def segments_of_deck(spark, sf_dir):
    utterances = table(spark, sf_dir, "events", "event_id", "event_type", "ts").select(
        "event_id", F.length("event_type").alias("deck"), ((F.hour("ts") * 60 + F.minute("ts")) / 100.0).alias("at_min")
    )
    step = F.explode(F.sequence(F.lit(0), F.lit(5)))
    segments = (
        table(spark, sf_dir, "region")
        .select((F.col("r_regionkey") + 4).alias("deck"), step.alias("k"))
        .select(
            "deck", F.concat(F.lit("s"), "k").alias("segment"), (F.col("k") * 2.5).alias("from_min"),
            (F.col("k") * 2.5 + 1.75).alias("to_min"), F.lit(True).alias("cta_allowed"),
        )
    )
    return layout.segments_of_deck(utterances, segments, "deck").select("event_id", "segment")


@query(
    "pacing",
    """WITH u AS (
  SELECT user_id AS deck, CAST(ts AS DATE) AS slide, (date_part('hour', ts) * 60 + date_part('minute', ts)) / 100.0 AS m FROM events)
SELECT deck, count(DISTINCT slide) AS slides, round(max(m), 6) AS minutes, round(count(DISTINCT slide) / max(m), 6) AS slides_per_minute,
  round(greatest(0, max(m) - 13.0), 6) AS overrun FROM u GROUP BY 1""",
)
def pacing(spark, sf_dir):
    utterances = table(spark, sf_dir, "events", "user_id", "ts").select(
        F.col("user_id").alias("deck"), F.to_date("ts").alias("slide"),
        ((F.hour("ts") * 60 + F.minute("ts")) / 100.0).alias("at_min"),
    )
    found = layout.pacing(utterances, "deck", "at_min", "slide", 13.0)
    return found.select(
        "deck", "slides", *[F.round(c, 6).alias(c) for c in ("minutes", "slides_per_minute", "overrun")]
    )


@query(
    "prompter_cues",
    rf"""WITH s AS (
  SELECT conv_id, turn + 1 AS slide_no, len(list_filter(string_split(regexp_replace(text, '[.]\s', '|', 'g'), '|'),
      lambda p: {Q.strip('p')} <> '')) AS paragraphs,
    CASE WHEN role = 'assistant' THEN '(none)' ELSE substr({Q.collapse('text')}, 1, 40) END AS title FROM conversations)
SELECT conv_id, slide_no, paragraphs, count(*) OVER (PARTITION BY conv_id) AS total,
  round(slide_no * 100.0 / count(*) OVER (PARTITION BY conv_id), 6) AS progress, title,
  coalesce(lead(title) OVER (PARTITION BY conv_id ORDER BY slide_no), '(last)') AS next_title FROM s""",
)
def prompter_cues(spark, sf_dir):
    slides = table(spark, sf_dir, "conversations").select(
        "conv_id", (F.col("turn") + 1).alias("slide_no"), F.regexp_replace("text", r"[.]\s", "|").alias("script"),
        F.when(F.col("role") != "assistant", F.col("text")).alias("title"),
    )
    cues = layout.prompter_cues(slides, "conv_id")
    return cues.withColumn("progress", F.round("progress", 6))


# ---- forms ---------------------------------------------------------------


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def form_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a form: three cells per line, the last one sometimes empty.

    A line number that an order has twice repeats its addresses, as a nested table does.
    """

    def cell(line: Column, col: int, *runs) -> Column:
        return F.concat(
            F.lit('<hp:tc name=""><hp:subList><hp:p id="0">'), *runs,
            F.lit(f'</hp:p></hp:subList><hp:cellAddr colAddr="{col}" rowAddr="'), line, F.lit('"/></hp:tc>'),
        )

    def run(value) -> Column:
        return F.concat(F.lit('<hp:run charPrIDRef="1"><hp:t>'), value, F.lit("</hp:t></hp:run>"))

    def row(r: Column) -> Column:
        line = r["l_linenumber"].cast("string")
        last = F.when(r["l_discount"] == 0, F.lit('<hp:run charPrIDRef="7"/>')).otherwise(run(r["l_linestatus"]))
        picture = F.when(r["l_tax"] == 0, F.lit("<hp:pic id='1'/>")).otherwise(F.lit(""))
        return F.concat(
            cell(line, 0, run(r["l_quantity"].cast("int").cast("string"))),
            cell(line, 1, run(r["l_returnflag"]), run(r["l_linestatus"])),
            cell(line, 2, last),
            picture,
        )

    used = [*LINE_ORDER, "l_quantity", "l_returnflag", "l_linestatus", "l_discount", "l_tax"]
    # the lines of one order, a handful; they are gathered as they are stored, the markup is made in the row
    gathered = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(*used)).alias("_l"))
    rows = F.array_sort(F.transform("_l", lambda r: F.struct(*[r[c].alias(c) for c in LINE_ORDER], row(r).alias("row"))))
    return gathered.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("section"),
        F.array_join(F.transform(rows, lambda r: r["row"]), "").alias("xml"),
    )


CELLS_SQL = """
cells AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS row, c AS col,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, c) - 1 AS idx,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber, c ORDER BY l_partkey, l_suppkey, l_extendedprice) - 1 AS occurrence,
    CASE c WHEN 0 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) WHEN 1 THEN l_returnflag || l_linestatus
      ELSE CASE WHEN l_discount = 0 THEN '' ELSE l_linestatus END END AS text,
    c = 2 AND l_discount = 0 AS is_empty, l_returnflag, l_linestatus
  FROM lineitem, range(0, 3) t(c))"""


@query("form_cell_inventory", f"WITH {CELLS_SQL} SELECT doc_id, idx, row, col, text, is_empty FROM cells")
def form_cell_inventory(spark, sf_dir):
    cells = form_source.form_cell_inventory(form_sections(spark, sf_dir))
    return cells.select("doc_id", "idx", "row", "col", "text", "is_empty")


@query(
    "form_rollup",
    """SELECT l_orderkey AS doc_id, 3 * count(*) AS cells, count(*) FILTER (l_discount = 0) AS empties,
  3 * count(*) AS paragraphs, count(*) FILTER (l_tax = 0) AS pictures FROM lineitem GROUP BY 1""",
)
def form_rollup(spark, sf_dir):
    sections = form_sections(spark, sf_dir)
    rolled = forms.form_rollup(
        form_source.form_cell_inventory(sections), form_source.section_counts(sections)
    )
    return rolled.select("doc_id", "cells", "empties", "paragraphs", "pictures")


@query(
    "document_rollup",
    """SELECT l_orderkey % 100 AS doc_id, count(DISTINCT l_orderkey) AS sections, 3 * count(*) AS cells,
  count(*) FILTER (l_discount = 0) AS empties, 3 * count(*) AS paragraphs, count(*) FILTER (l_tax = 0) AS pictures
FROM lineitem GROUP BY 1""",
)
def document_rollup(spark, sf_dir):
    """Orders as the sections of a hundred documents."""
    sections = form_sections(spark, sf_dir).select(
        (F.col("doc_id") % 100).alias("doc_id"), F.col("doc_id").alias("section"), "xml"
    )
    rolled = forms.form_rollup(form_source.form_cell_inventory(sections), form_source.section_counts(sections))
    return forms.document_rollup(rolled)


FILL_SQL = f"""
WITH {CELLS_SQL}, v AS (
  SELECT o_orderkey AS doc_id, o_custkey % 8 AS row, o_custkey % 3 AS col,
    (['set', 'whole', 'append', 'prepend'])[1 + o_orderkey % 4] AS mode FROM orders)
SELECT coalesce(c.doc_id, v.doc_id) AS doc_id, coalesce(c.row, v.row) AS row, coalesce(c.col, v.col) AS col,
  CASE WHEN c.doc_id IS NULL THEN 'none' WHEN mode IS NULL THEN text WHEN mode = 'whole' THEN 'Q&amp;A'
    WHEN mode = 'append' THEN text || 'Q&amp;A' WHEN mode = 'prepend' THEN 'Q&amp;A' || text
    WHEN c.col = 1 THEN 'Q&amp;A' || l_linestatus ELSE 'Q&amp;A' END AS text,
  CASE WHEN c.doc_id IS NULL THEN 'error' WHEN mode IS NULL THEN 'untouched' ELSE 'filled' END AS status
FROM cells c FULL JOIN v ON c.doc_id = v.doc_id AND c.row = v.row AND c.col = v.col AND c.occurrence = 0"""


@query("fill_cells", FILL_SQL)
def fill_cells(spark, sf_dir):
    cells = form_source.form_cell_inventory(form_sections(spark, sf_dir))
    modes = F.array(*[F.lit(m) for m in ("set", "whole", "append", "prepend")])
    values = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("section"),
        (F.col("o_custkey") % 8).cast("int").alias("row"), (F.col("o_custkey") % 3).cast("int").alias("col"),
        F.lit(0).alias("occurrence"),
        F.element_at(modes, (1 + F.col("o_orderkey") % 4).cast("int")).alias("mode"), F.lit("Q&A").alias("value"),
    )
    filled = forms.fill_cells(cells, values)
    return filled.select("doc_id", "row", "col", F.coalesce("text", F.lit("none")).alias("text"), "status")


@query(
    "counted_replace",
    """SELECT l_orderkey AS doc_id, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS hits FROM lineitem GROUP BY 1""",
)
def counted_replace(spark, sf_dir):
    return forms.counted_replace(form_sections(spark, sf_dir), "R", "A&B").select("doc_id", "hits")


@query(
    "reconcile_keys",
    """WITH h AS (SELECT l_orderkey, count(*) AS hits FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(o_orderkey, l_orderkey) AS key, coalesce(hits, 0) AS hits, CASE WHEN o_orderkey IS NULL THEN 'unexpected'
  WHEN hits IS NULL THEN 'missing' WHEN hits <> 1 THEN 'wrong_count' ELSE 'ok' END AS status
FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o FULL JOIN h ON o_orderkey = l_orderkey""",
)
def reconcile_keys(spark, sf_dir):
    """Orders that are not pending should have exactly one returned line."""
    expected = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("key"))
    actual = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("key"))
    return forms.reconcile_keys(expected, actual, "key")


@query(
    "reconcile_verdict",
    """WITH h AS (SELECT l_orderkey, count(*) AS hits FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
j AS (
  SELECT o_orderkey, l_orderkey, hits FROM orders FULL JOIN h ON o_orderkey = l_orderkey)
SELECT count(*) FILTER (o_orderkey IS NOT NULL AND hits = 1) AS ok, count(*) FILTER (hits IS NULL) AS missing,
  count(*) FILTER (o_orderkey IS NULL) AS unexpected, count(*) FILTER (o_orderkey IS NOT NULL AND hits > 1) AS wrong_count,
  'fail' AS verdict FROM j""",
)
def reconcile_verdict(spark, sf_dir):
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    actual = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("key"))
    return forms.reconcile_verdict(forms.reconcile_keys(expected, actual, "key"))


@query(
    "label_value_pairs",
    """WITH l AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS col FROM lineitem)
SELECT l_orderkey AS doc_id, col, l_returnflag AS label, coalesce((
    SELECT min(n.col) FROM l n
    WHERE n.l_orderkey = l.l_orderkey AND n.col > l.col AND n.l_discount < 0.03), -1) AS value_col
FROM l WHERE l_discount >= 0.03""",
)
def label_value_pairs(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    cells = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("section"), F.lit(0).alias("row"),
        place.alias("col"), F.col("l_returnflag").alias("text"),
        (F.col("l_discount") < 0.03).alias("is_empty"),
    )
    return forms.label_value_pairs(cells).select("doc_id", "col", "label", "value_col")


STYLES_SQL = """
styles AS (
  SELECT p_brand AS doc_id, p_partkey AS style_id, p_size * 100 AS height,
    CASE WHEN p_size % 3 = 0 THEN '#000000' ELSE '#FF0000' END AS color FROM part),
used AS (
  SELECT p_brand AS doc_id, l_partkey AS style_id, count(*) AS runs FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""


def styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the styles of their brand, read from style headers."""
    black = F.when(F.col("p_size") % 3 == 0, "#000000").otherwise("#FF0000")
    headers = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("doc_id"),
        F.concat(
            F.lit('<hh:charPr id="'), "p_partkey", F.lit('" height="'), F.col("p_size") * 100,
            F.lit('" textColor="'), black, F.lit('" shade="x"><hh:spacing hangul="-5"/></hh:charPr>'),
        ).alias("xml"),
    )
    return form_source.style_table(headers)


@query(
    "style_usage",
    f"""WITH {STYLES_SQL} SELECT doc_id, style_id, height, color, coalesce(runs, 0) AS runs
FROM styles LEFT JOIN used USING (doc_id, style_id)""",
)
def style_usage(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("doc_id"))
    runs = table(spark, sf_dir, "lineitem", "l_partkey").join(parts, "l_partkey").select(
        "doc_id", F.col("l_partkey").cast("int").alias("style_id")
    )
    used = forms.style_usage(runs, styles(spark, sf_dir))
    return used.select("doc_id", "style_id", "height", "color", "runs")


@query(
    "body_styles",
    f"""WITH {STYLES_SQL}, r AS (
  SELECT doc_id, style_id, row_number() OVER (PARTITION BY doc_id ORDER BY style_id) AS rank FROM styles WHERE color = '#000000')
SELECT * FROM r WHERE rank <= 14""",
)
def body_styles(spark, sf_dir):
    return forms.body_styles(styles(spark, sf_dir)).select("doc_id", "style_id", "rank")


@query(
    "next_fragment",
    f"""WITH l AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, {Q.lines('text')} AS ls FROM documents)),
h AS (SELECT doc_id, min(pos) FILTER (contains(line, 'que')) AS hit FROM l GROUP BY 1)
SELECT h.doc_id, coalesce(hit, -1) AS anchor_pos, sha256(coalesce(line, '')) AS following_sha,
  CASE WHEN hit IS NULL THEN 'no_anchor' WHEN line IS NULL THEN 'nothing_follows' ELSE 'ok' END AS status
FROM h LEFT JOIN l ON l.doc_id = h.doc_id AND l.pos = hit + 1""",
)
def next_fragment(spark, sf_dir):
    exploded = lines.explode_lines(documents(spark, sf_dir), "doc_id", "text")
    fragments = exploded.select("doc_id", (F.col("line_no") - 1).alias("pos"), F.col("line").alias("text"))
    found = forms.next_fragment(fragments, ["doc_id"], "que")
    return found.select("doc_id", "anchor_pos", F.sha2("following", 256).alias("following_sha"), "status")


@query(
    "width_slack",
    """SELECT o_custkey, o_orderkey, max(length(o_orderpriority)) OVER (PARTITION BY o_custkey) - length(o_orderpriority) AS slack
FROM orders""",
)
def width_slack(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderpriority")
    return forms.width_slack(orders, ["o_custkey"], "o_orderpriority").select("o_custkey", "o_orderkey", "slack")


# ---- rule tables ---------------------------------------------------------------

RULE_ROWS = [
    ("view", "at_least", 20.0, 0.5, None, True, "visitor"),
    ("click", "at_most", 20.0, 0.0, None, False, "visitor"),
    ("error", "within", 20.0, 6.0, "quality", True, "visitor"),
    ("signup", "equals", 0.0, 0.0, "quality", True, "visitor"),
    ("view", "at_least", 25.0, 0.0, None, True, "member"),
    ("error", "at_most", 30.0, 0.0, None, False, "member"),
]

JUDGED_SQL = """
rules(kind, metric, cmp, bound, tol, info_mode, mandatory) AS (VALUES
  ('visitor', 'view', 'ge', 20.0, 0.5, NULL, true), ('visitor', 'click', 'le', 20.0, 0.0, NULL, false),
  ('visitor', 'error', 'in', 20.0, 6.0, 'quality', true), ('visitor', 'signup', 'eq', 0.0, 0.0, 'quality', true),
  ('member', 'view', 'ge', 25.0, 0.0, NULL, true), ('member', 'error', 'le', 30.0, 0.0, NULL, false)),
k AS (
  SELECT *, CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 7 = 1 THEN 'guest'
    WHEN user_id % 7 = 2 AND event_type = 'view' THEN 'member' WHEN user_id % 2 = 0 THEN 'visitor' ELSE 'member' END AS kind FROM events),
m AS (
  SELECT user_id, kind, event_type AS metric, CASE WHEN user_id % 10 <> 0 OR event_type <> 'view' THEN median(value) END AS value
  FROM k GROUP BY user_id, kind, event_type),
u AS (SELECT DISTINCT user_id, kind, CASE WHEN user_id % 3 = 0 THEN 'quality' END AS mode FROM k),
judged AS (
  SELECT u.user_id, u.kind, r.metric, CASE WHEN info_mode = mode THEN 'info' WHEN value IS NULL THEN 'unmeasured'
    WHEN CASE cmp WHEN 'ge' THEN value >= bound - tol WHEN 'le' THEN value <= bound + tol
      WHEN 'in' THEN abs(value - bound) <= tol ELSE value = bound END THEN 'pass'
    WHEN mandatory THEN 'fail' ELSE 'warn' END AS status
  FROM u LEFT JOIN rules r USING (kind) LEFT JOIN m ON m.user_id = u.user_id AND m.kind = u.kind AND m.metric = r.metric)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median values per user and event type; every tenth user has no views measured.

    Of seven users one has no kind, one a kind without rules, and one two kinds.
    """
    events = table(spark, sf_dir, "events", "user_id", "event_type", "value")
    kept = (F.col("user_id") % 10 != 0) | (F.col("metric") != "view")
    rest = F.col("user_id") % 7
    kind = (
        F.when(rest == 0, F.lit(None))
        .when(rest == 1, "guest")
        .when((rest == 2) & (F.col("event_type") == "view"), "member")
        .when(F.col("user_id") % 2 == 0, "visitor")
        .otherwise("member")
    )
    measures = events.groupBy("user_id", kind.alias("kind"), F.col("event_type").alias("metric")).agg(F.median("value").alias("value"))
    measures = measures.withColumns({
        "value": F.when(kept, F.col("value")),
        "mode": F.when(F.col("user_id") % 3 == 0, "quality"),
    })
    rule_table = spark.createDataFrame(RULE_ROWS, RULES)
    return rules.judge(measures, rule_table, ["user_id"], "kind", "mode")


@query("judge", f"WITH {JUDGED_SQL} SELECT user_id, kind, metric, status FROM judged")
def judge(spark, sf_dir):
    return judged(spark, sf_dir).select("user_id", "kind", "metric", "status")


@query(
    "overall",
    f"""WITH {JUDGED_SQL}
SELECT CASE WHEN count(*) = 0 THEN 'not_measured' WHEN count(*) FILTER (status = 'fail') > 0 THEN 'fail'
  WHEN count(*) FILTER (status IN ('unmeasured', 'warn')) > 0 THEN 'pass_with_warnings' ELSE 'pass' END AS verdict,
  coalesce(string_agg(DISTINCT metric, ',' ORDER BY metric) FILTER (status = 'fail'), '') AS failures FROM judged""",
)
def overall(spark, sf_dir):
    return rules.overall(judged(spark, sf_dir))


@query(
    "verdict",
    f"""WITH {JUDGED_SQL}
SELECT user_id, CASE WHEN bool_or(status = 'fail') THEN 'fail'
    WHEN bool_or(status IN ('unmeasured', 'warn')) THEN 'pass_with_warnings' ELSE 'pass' END AS verdict,
  coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (status = 'fail'), '') AS failures
FROM judged GROUP BY 1""",
)
def verdict(spark, sf_dir):
    return rules.verdict(judged(spark, sf_dir), ["user_id"])


@query(
    "contract_check",
    """WITH e AS (
  SELECT c_custkey, [
    CASE WHEN c_custkey % 6 = 1 THEN 'missing:positioning' END,
    CASE WHEN c_custkey % 6 = 2 THEN 'blank:tone' END,
    CASE WHEN c_custkey % 6 = 5 THEN 'blank:pillars' END,
    CASE WHEN c_custkey % 6 = 3 THEN 'too_many:pillars' END,
    CASE WHEN c_custkey % 6 = 4 THEN 'not_a_list:forbidden' END] AS errors FROM customer)
SELECT c_custkey, c_custkey % 7 <> 0 AND c_custkey % 6 = 0 AS ok, CASE WHEN c_custkey % 7 = 0 THEN 'no_header'
  ELSE array_to_string(list_filter(errors, lambda x: x IS NOT NULL), ',') END AS errors FROM e""",
)
def contract_check(spark, sf_dir):
    """Customers as channel files, a different defect for each remainder."""
    rest = F.col("c_custkey") % 6
    header = F.concat(
        F.lit("---\nchannel: \""), "c_name", F.lit("\"\n"),
        F.when(rest == 1, "").otherwise("positioning: not A but B # why\n"),
        F.lit("target: 0-1K\ntone: "), F.when(rest == 2, "<how it sounds>").otherwise("plain"),
        F.lit("\npillars:\n"),
        F.when(rest == 5, "").when(rest == 3, "  - a\n  - b\n  - c\n  - d\n").otherwise("  - a\n  # note\n  - b\n"),
        F.when(rest == 4, "forbidden: all\n").otherwise("forbidden:\n  - wide words\n"),
        F.lit("---\nbody"),
    )
    files = table(spark, sf_dir, "customer", "c_custkey", "c_name").select(
        "c_custkey", F.when(F.col("c_custkey") % 7 == 0, "# only a title").otherwise(header).alias("body")
    )
    found = rules.contract_check(
        lines.front_matter(files, "c_custkey", "body"), "c_custkey",
        ["channel", "positioning", "target", "tone", "pillars", "forbidden"], {"pillars": 3, "forbidden": None},
    )
    return found.select("c_custkey", "ok", F.array_join("errors", ",").alias("errors"))


@query(
    "blank_fields",
    """SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 5 = 0 THEN 'c_name' END, CASE WHEN c_custkey % 3 = 0 THEN 'c_mktsegment' END) AS blanks
FROM customer""",
)
def blank_fields(spark, sf_dir):
    covers = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    covers = covers.withColumn("c_name", F.when(F.col("c_custkey") % 5 == 0, "<name>").otherwise(F.col("c_name"))).withColumn(
        "c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    )
    return rules.blank_fields(covers, "c_custkey", ["c_name", "c_mktsegment"])


@query(
    "resolve_precedence",
    """WITH c AS (
  SELECT l_partkey, l_suppkey, 1 + l_linenumber % 4 AS priority FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY priority, l_suppkey) AS rn FROM c)
SELECT l_partkey, min(l_suppkey) FILTER (rn = 1) AS value, 's' || min(priority) AS source,
  count(DISTINCT l_suppkey) > 1 AS conflict, min(priority) >= 4 AS unsupported FROM r GROUP BY 1""",
)
def resolve_precedence(spark, sf_dir):
    priority = 1 + F.col("l_linenumber") % 4
    claims = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.col("l_suppkey").alias("value"), priority.alias("priority"),
        F.concat(F.lit("s"), priority).alias("source"),
    )
    return rules.resolve_precedence(claims, ["l_partkey"], weakest=4)


@query(
    "group_distinct",
    """SELECT p_brand || p_size AS script, count(*) AS plans, count(DISTINCT p_type) AS kinds,
  count(*) = 3 AND count(DISTINCT p_type) = 3 AS ok FROM part GROUP BY 1""",
)
def group_distinct(spark, sf_dir):
    plans = table(spark, sf_dir, "part").select(F.concat("p_brand", "p_size").alias("script"), "p_type")
    return rules.group_distinct(plans, "script", "p_type", 3)


@query(
    "setting_vs_result",
    """WITH s AS (
  SELECT user_id, max(value) FILTER (event_type = 'view' AND user_id % 5 <> 0) AS a, max(value) FILTER (event_type = 'click') AS b,
    max(value) FILTER (event_type = 'error') AS c FROM events GROUP BY 1),
p AS (
  SELECT user_id, 'width' AS metric, coalesce(a, b) AS configured FROM s
  UNION ALL SELECT user_id, 'fps', c FROM s WHERE c IS NOT NULL),
m AS (SELECT user_id, 'width' AS metric, max(value) AS measured FROM events WHERE event_type IN ('click', 'signup') GROUP BY 1)
SELECT coalesce(p.user_id, m.user_id) AS asset, coalesce(p.metric, m.metric) AS metric,
  CASE WHEN configured IS NULL OR measured IS NULL THEN 'unmeasured' WHEN configured = measured THEN 'same' ELSE 'differs' END AS status
FROM p FULL JOIN m ON p.user_id = m.user_id AND p.metric = m.metric
WHERE coalesce(configured, measured) IS NOT NULL""",
)
def setting_vs_result(spark, sf_dir):
    events = table(spark, sf_dir, "events", "user_id", "event_type", "value").withColumnRenamed("user_id", "asset")
    filled = F.when((F.col("asset") % 5 != 0) | (F.col("event_type") != "view"), F.col("value"))
    settings = events.groupBy("asset", F.col("event_type").alias("key")).agg(F.max(filled).alias("value"))
    measured = events.filter(F.col("event_type").isin("click", "signup")).groupBy("asset").agg(F.max("value").alias("value"))
    found = rules.setting_vs_result(
        settings, measured.withColumn("metric", F.lit("width")), {"width": ["view", "click"], "fps": ["error"]}
    )
    return found.select("asset", "metric", "status")


@query(
    "geometry_units",
    """SELECT l_orderkey, l_linenumber, round(l_quantity / 72 * 25.4, 6) AS mm, round(l_quantity * 283.46, 6) AS units,
  round(l_quantity / 96 * 25.4, 6) AS pixel_mm, greatest(1, CAST(round_even(l_quantity / 25.4 * 96, 0) AS INT)) AS pixels,
  round(l_quantity * 120 / 400, 6) AS visible FROM lineitem""",
)
def geometry_units(spark, sf_dir):
    size = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select(
        "l_orderkey", "l_linenumber",
        F.round(bands.points_to_mm(size), 6).alias("mm"), F.round(bands.mm_to_form_units(size), 6).alias("units"),
        F.round(bands.pixels_to_mm(size), 6).alias("pixel_mm"), bands.mm_to_pixels(size).alias("pixels"),
        F.round(bands.visible_points(size, F.lit(120), F.lit(400)), 6).alias("visible"),
    )


@query(
    "changed_records",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 'insert' WHEN o_orderkey % 10 = 2 THEN 'kept'
  WHEN o_orderkey % 10 = 3 THEN 'update' ELSE 'unchanged' END AS action,
  CASE WHEN o_orderkey % 10 = 3 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders""",
)
def changed_records(spark, sf_dir):
    new, stored = perturbed(spark, sf_dir)
    return sinks.changed_records(new, stored, "o_orderkey", ["o_orderstatus", "o_custkey"]).drop("o_custkey")


def perturbed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as sent now and as stored before."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_custkey")
    rest = F.col("o_orderkey") % 10
    new = orders.filter(rest != 2).withColumn(
        "o_orderstatus", F.when(rest == 3, "new").otherwise(F.col("o_orderstatus"))
    )
    return new, orders.filter(rest != 1)


@query(
    "upsert_changed",
    """SELECT o_orderkey, o_orderkey % 10 AS part, CASE WHEN o_orderkey % 10 = 3 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders""",
)
def upsert_changed(spark, sf_dir):
    """The store after the old orders and then the new ones were merged into it."""
    path = scratch_path(spark, "upsert")
    new, stored = perturbed(spark, sf_dir)
    for rows in (stored, new):
        rows = rows.select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 10).alias("part"))
        sinks.upsert_changed(rows, path, "o_orderkey", "part")
    return spark.read.schema("o_orderkey long, o_orderstatus string, part long").parquet(path)
