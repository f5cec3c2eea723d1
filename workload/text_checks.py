"""Queries on texts: documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import lexicon, text
from galley.operators import drift, rules, textstyle
from galley.plans import style_gate
from galley.session import scratch_path
from galley.sources import assets, html, lines
from workload import sqltext as Q
from workload.registry import query, table, texts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents", "doc_id", "text")


@query(
    "read_marked_lines",
    f"""WITH l AS (
  SELECT 'conv-' || conv_id AS doc, unnest({Q.lines('text')}) AS line FROM conversations)
SELECT line, count(*) AS copies FROM l GROUP BY 1""",
)
def read_marked_lines(spark, sf_dir):
    """Turns written as text files, one folder per session, and read back as lines."""
    path = scratch_path(spark, "notes")
    turns = table(spark, sf_dir, "conversations", "conv_id", "text")
    turns.write.partitionBy("conv_id").text(path)
    found = lines.read_marked_lines(spark, f"{path}/*/*.txt")
    # A text file ends with a line break, so its last line is empty.
    last = found.groupBy("doc").agg(F.max("line_no").alias("_last"))
    kept = found.join(last, "doc").filter(F.col("line_no") < F.col("_last"))
    return kept.groupBy("line").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "explode_lines",
    f"""SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, sha256(unnest(ls)) AS line_sha
FROM (SELECT doc_id, {Q.lines('text')} AS ls FROM documents)""",
)
def explode_lines(spark, sf_dir):
    exploded = lines.explode_lines(documents(spark, sf_dir), "doc_id", "text")
    return exploded.select("doc_id", "line_no", F.sha2("line", 256).alias("line_sha"))


@query(
    "carry_forward_sections",
    f"""WITH l AS (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS raw
  FROM (SELECT doc_id, {Q.lines('text')} AS ls FROM documents)),
m AS (
  SELECT doc_id, line_no, {Q.strip('raw')} AS t FROM l),
s AS (
  SELECT doc_id, line_no, t,
    last_value(CASE WHEN line_no % 4 = 2 AND t <> '' THEN 'part ' || line_no END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM m)
SELECT doc_id, section, 'line' || line_no AS key, sha256(t) AS value_sha
FROM s WHERE section IS NOT NULL AND line_no % 4 <> 2 AND t <> ''""",
)
def carry_forward_sections(spark, sf_dir):
    """Every fourth line of a document becomes a header, the others settings."""
    def marked(line, i):
        number = (i + 1).cast("string")
        content = text.strip(line)
        return (
            F.when(content == "", "")
            .when(i % 4 == 1, F.concat(F.lit("[part "), number, F.lit("]")))
            .otherwise(F.concat(F.lit("line"), number, F.lit("="), content))
        )

    settings = F.array_join(F.transform(text.lines(F.col("text")), marked), "\n")
    found = lines.section_settings(documents(spark, sf_dir).withColumn("text", settings), "doc_id", "text")
    return found.select("doc_id", "section", "key", F.sha2("value", 256).alias("value_sha"))


@query(
    "html_elements",
    r"""WITH p AS (
  SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
e AS (
  SELECT page_id, tag, unnest(regexp_extract_all(h, '(?is)<' || tag || '(?:\s[^>]*)?>.*?</' || tag || '>')) AS w
  FROM p, (VALUES ('a'), ('li'), ('p')) t(tag))
SELECT page_id, tag, count(*) AS elements,
  sum(length(regexp_extract(w, '(?is)^<[^>]*>(.*)</', 1))) AS characters
FROM e GROUP BY ALL""",
)
def html_elements(spark, sf_dir):
    pages = texts(spark, sf_dir, "pages", "page_id", "html")
    found = html.explode_html_elements(pages, "page_id", "html", "a", "li", "p")
    return found.groupBy("page_id", "tag").agg(
        F.count(F.lit(1)).alias("elements"), F.sum(F.length("inner")).alias("characters")
    )


# A deck per document: each line is a slide with its script, every second one has a note.
SLIDE_LINE = "replace(replace(replace(replace(l, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(
    "slides",
    f"""WITH l AS (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS slide_no, unnest(ls) AS l FROM (SELECT doc_id, {Q.lines('text')} AS ls FROM documents))
SELECT doc_id, slide_no, sha256({SLIDE_LINE}) AS script_sha, CASE WHEN slide_no % 2 = 0 THEN 'note ' || slide_no ELSE '' END AS note,
  sha256('<p>' || {SLIDE_LINE} || '</p>') AS body_sha FROM l""",
)
def slides(spark, sf_dir):
    def section(line, i):
        safe = F.replace(text.escape(line), F.lit('"'), F.lit("&quot;"))
        number = (i + 1).cast("string")
        note = F.when(i % 2 == 1, F.concat(F.lit(' data-note="note '), number, F.lit('"'))).otherwise("")
        return F.concat(
            F.lit('<section id="s" class="slide" data-script="'), safe, F.lit('"'), note,
            F.lit("><p>"), safe, F.lit("</p><!-- not shown --></section>\n"),
        )

    deck = F.concat(F.lit("<html><body>"), F.array_join(F.transform(text.lines(F.col("text")), section), ""), F.lit("</body></html>"))
    found = html.slides(documents(spark, sf_dir).select("doc_id", deck.alias("html")), "doc_id", "html")
    return found.select("doc_id", "slide_no", F.sha2("script", 256).alias("script_sha"), "note", F.sha2("body", 256).alias("body_sha"))


@query(
    "image_refs",
    """WITH p AS (
  SELECT page_id, regexp_extract_all(html || '<img alt="x" src="a.png"> <img src="p/' || page_id || '.png">', '<img[^>]+src="([^"]+)"', 1) AS refs FROM pages)
SELECT page_id, unnest(range(0, len(refs))) AS pos, unnest(refs) AS ref FROM p""",
)
def image_refs(spark, sf_dir):
    """The pages with two images put below."""
    more = F.concat(F.col("html"), F.lit('<img alt="x" src="a.png"> <img src="p/'), F.col("page_id"), F.lit('.png">'))
    return html.image_refs(texts(spark, sf_dir, "pages", "page_id", "html").withColumn("html", more), "page_id", "html")


@query(
    "judge_assets",
    """WITH f AS (
  SELECT 'doc-' || doc_id AS path, CASE doc_id % 6 WHEN 0 THEN unhex('89504E470D0A1A0A') || encode(text) WHEN 1 THEN unhex('FFD8FF') || encode(text)
    WHEN 2 THEN encode('GIF87a' || text) WHEN 3 THEN encode('RIFFsizeWEBP' || text) WHEN 4 THEN encode(text) ELSE encode('short') END AS content FROM documents),
s AS (
  SELECT path, octet_length(content) AS bytes, CASE octet_length(content) > 8000 WHEN false THEN sha256(content) END AS sha,
    CASE WHEN octet_length(content) > 8000 THEN NULL WHEN path = 'doc-' THEN NULL ELSE kind END AS kind FROM (
    SELECT *, ['png', 'jpeg', 'gif', 'webp', NULL, NULL][CAST(substr(path, 5) AS BIGINT) % 6 + 1] AS kind FROM f))
SELECT path, bytes, kind, sha, min(path) OVER (PARTITION BY sha) AS same_as,
  CASE WHEN bytes > 8000 THEN 'too_large' WHEN bytes < 12 THEN 'too_small' WHEN kind IS NULL THEN 'unknown_kind'
    WHEN min(path) OVER (PARTITION BY sha) <> path THEN 'reused' ELSE 'accepted' END AS status
FROM s WHERE sha IS NOT NULL
UNION ALL SELECT path, bytes, NULL, NULL, NULL, 'too_large' FROM s WHERE sha IS NULL""",
)
def judge_assets(spark, sf_dir):
    """Documents behind the leading bytes of four image kinds, of none, and a file that is too short."""
    rest, raw = F.col("doc_id") % 6, F.col("text").cast("binary")
    lead = lambda h: F.concat(F.unhex(F.lit(h)), raw)
    content = (
        F.when(rest == 0, lead("89504E470D0A1A0A"))
        .when(rest == 1, lead("FFD8FF"))
        .when(rest == 2, F.concat(F.lit("GIF87a").cast("binary"), raw))
        .when(rest == 3, F.concat(F.lit("RIFFsizeWEBP").cast("binary"), raw))
        .when(rest == 4, raw)
        .otherwise(F.lit("short").cast("binary"))
    )
    files = documents(spark, sf_dir).select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("path"), content.alias("content"))
    return assets.judge_assets(files.withColumn("length", F.octet_length("content").cast("long")), max_bytes=8000)


@query(
    "placeholder_scan",
    r"""WITH d AS (
  SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' TODO ____% <NAME_1>' WHEN 1 THEN ' __ FIXME __ __ __ __'
    ELSE ' TODOS <ab>' END AS t FROM documents),
f AS (SELECT doc_id, regexp_extract_all(t, '__+%?|<[A-Z][A-Z0-9_]{2,}>|\bTODO\b|\bFIXME\b') AS m FROM d)
SELECT doc_id, len(m) AS marks, array_to_string(m[1:5], ',') AS first_five FROM f""",
)
def placeholder_scan(spark, sf_dir):
    injected = (
        F.when(F.col("doc_id") % 4 == 0, " TODO ____% <NAME_1>")
        .when(F.col("doc_id") % 4 == 1, " __ FIXME __ __ __ __")
        .otherwise(" TODOS <ab>")
    )
    docs = documents(spark, sf_dir).withColumn("text", F.concat("text", injected))
    return rules.placeholder_scan(docs, "doc_id", "text")


EMAIL_SQL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"


@query(
    "sensitive_scan",
    rf"""WITH m AS (
  SELECT doc_id, text, regexp_replace(regexp_replace(text, '{EMAIL_SQL}', '[email]', 'g'),
    '{text.PHONE}', '[phone]', 'g') AS masked FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '{EMAIL_SQL}') THEN 'email' END,
  CASE WHEN regexp_matches(text, '{text.PHONE}') THEN 'phone' END) AS kinds,
  sha256(masked) AS masked_sha FROM m""",
)
def sensitive_scan(spark, sf_dir):
    found = rules.sensitive_scan(documents(spark, sf_dir), "doc_id", "text")
    return found.select("doc_id", "kinds", F.sha2("masked", 256).alias("masked_sha"))


BANNED = {"article": r" the | der | que ", "closing_question": r"\?\s*$", "number": r"\d+"}


@query(
    "banned_phrases",
    "WITH h AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, {Q.count('text', p)} AS hits FROM documents" for k, p in BANNED.items()
    )
    + ") SELECT * FROM h WHERE hits > 0",
)
def banned_phrases(spark, sf_dir):
    return rules.banned_phrases(documents(spark, sf_dir), "doc_id", "text", BANNED)


@query(
    "length_bounds",
    f"""WITH l AS (SELECT doc_id, lang, length({Q.squeeze('text')}) AS chars FROM documents)
SELECT doc_id, lang, chars, CASE WHEN lang = 'en' THEN CASE WHEN chars < 200 THEN 'short' WHEN chars > 2000 THEN 'long' ELSE 'ok' END
  WHEN lang = 'fr' THEN CASE WHEN chars < 500 THEN 'short' ELSE 'ok' END
  WHEN lang = 'de' THEN CASE WHEN chars < 100 THEN 'short' WHEN chars > 900 THEN 'long' ELSE 'ok' END
  ELSE 'no_rule' END AS status FROM l""",
)
def length_bounds(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id", "lang", "text")
    bounds = {"en": (200, 2000), "fr": (500, None), "de": (100, 900)}
    return rules.length_bounds(docs, "doc_id", "lang", "text", bounds, count_spaces=False)


@query(
    "copy_line_lengths",
    rf"""WITH l AS (
  SELECT item_id, list_filter(list_transform(string_split_regex(text, '\||\\n|\n'), lambda r: {Q.strip('r')}),
    lambda r: r <> '') AS rows FROM benchmark),
e AS (SELECT item_id, unnest(range(0, len(rows))) AS pos, length(unnest(rows)) AS chars FROM l)
SELECT item_id, pos, CASE WHEN item_id % 2 = 0 THEN 'main' ELSE 'sub' END AS kind, chars,
  CASE WHEN chars < CASE WHEN item_id % 2 = 0 THEN 9 ELSE 14 END THEN 'short'
    WHEN chars > CASE WHEN item_id % 2 = 0 THEN 13 ELSE 22 END THEN 'long' ELSE 'ok' END AS status FROM e""",
)
def copy_line_lengths(spark, sf_dir):
    plans = table(spark, sf_dir, "benchmark").withColumn(
        "kind", F.when(F.col("item_id") % 2 == 0, "main").otherwise("sub")
    )
    return rules.copy_line_lengths(plans, "item_id", "kind", "text")


@query(
    "normalize_copy",
    f"""SELECT 'd' || doc_id AS id, sha256({Q.normalize_copy('text')}) AS copy_sha FROM documents
UNION ALL SELECT 'b' || item_id, sha256({Q.normalize_copy('text')}) FROM benchmark""",
)
def normalize_copy(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text")
    both = docs.unionByName(items)
    return both.select("id", F.sha2(text.normalize_copy(F.col("text")), 256).alias("copy_sha"))


# Line shapes given to the lines of a document in turn; the last of nine is bare.
SHAPES = ["> 주의 ", "> ", "### ", "## ", "| ", "- [ ] ", "- ", "# 3~6분 "]


@query(
    "spoken_lines",
    f"""WITH l AS (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS raw
  FROM (SELECT doc_id, {Q.lines('text')} AS ls FROM documents))
SELECT doc_id, line_no FROM l
WHERE line_no % 9 IN (2, 6) OR (line_no % 9 IN (1, 8) AND regexp_matches(raw, '\\S')
  AND NOT (line_no % 9 = 8 AND regexp_matches(raw, '^\\s*(\\||---\\s*$)')))""",
)
def spoken_lines(spark, sf_dir):
    """Lines of documents in the shapes of a script."""
    exploded = lines.explode_lines(documents(spark, sf_dir), "doc_id", "text")
    shaped = F.col("line")
    for remainder, prefix in enumerate(SHAPES):
        shaped = F.when(F.col("line_no") % 9 == remainder, F.concat(F.lit(prefix), "line")).otherwise(shaped)
    return drift.spoken_lines(exploded.withColumn("line", shaped)).select("doc_id", "line_no")


@query(
    "candidate_limits",
    rf"""WITH l AS (SELECT doc_id, unnest({Q.lines('text')}) AS line FROM documents),
f AS (
  SELECT doc_id, 'number' AS kind, unnest(regexp_extract_all(line, '(\d{{2,}})', 1)) AS value, line FROM l
  UNION ALL
  SELECT doc_id, 'ratio', unnest(regexp_extract_all(line, '(\w+)%', 1)), line FROM l)
SELECT doc_id, kind, value, count(*) AS found, false AS confirmed FROM f GROUP BY ALL""",
)
def candidate_limits(spark, sf_dir):
    found = rules.candidate_limits(
        documents(spark, sf_dir), "doc_id", "text", {"number": r"(\d{2,})", "ratio": r"(\w+)%"}
    )
    return found.groupBy("doc_id", "kind", "value", "confirmed").agg(F.count(F.lit(1)).alias("found"))


@query(
    "confirmed_limits",
    r"""WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\d{2,})', 1)) AS value FROM documents)
SELECT doc_id, value, count(*) AS found FROM l WHERE length(value) >= 4 GROUP BY ALL""",
)
def confirmed_limits(spark, sf_dir):
    """A person confirms the numbers of four digits and more."""
    found = rules.candidate_limits(documents(spark, sf_dir), "doc_id", "text", {"number": r"(\d{2,})"})
    confirmed = rules.confirmed_limits(found.withColumn("confirmed", F.length("value") >= 4))
    return confirmed.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("found"))


@query(
    "question_tags",
    f"""WITH q AS (
  SELECT conv_id, turn, text, {Q.tokens('text')} AS w FROM conversations WHERE role = 'user')
SELECT conv_id, turn,
  array_to_string(list_filter(['the', 'und', 'que'], lambda m: contains(lower(text), m)), ',') AS markers,
  coalesce(list_filter(w, lambda t: t IN ('der', 'de', 'of'))[1], 'none') AS head,
  len(list_filter(w, lambda t: t IN ('la', 'die'))) > 0 AS noise
FROM q""",
)
def question_tags(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    tagged = rules.question_tags(
        turns, "text", markers=("the", "und", "que"), heads=("der", "de", "of"), noise=("la", "die")
    )
    return tagged.select("conv_id", "turn", "markers", "head", "noise")


# A document with a heading, a code block and a table around its text.
FRAMED_SQL = """
framed AS (
  SELECT doc_id, '# Title' || chr(10) || text || chr(10) || '```py' || chr(10) || text || chr(10) || '```' || chr(10)
    || '| short | ' || substr(replace(replace(text, chr(10), ' '), '|', ' '), 1, 90) || ' |' || chr(10) || 'end' AS t FROM documents
)"""


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.substring(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit(" ")), 1, 90)
    return documents(spark, sf_dir).select(
        "doc_id",
        F.concat(
            F.lit("# Title\n"), "text", F.lit("\n```py\n"), "text", F.lit("\n```\n| short | "), cell, F.lit(" |\nend")
        ).alias("text"),
    )


BODY_SQL = rf"""
body AS (
  SELECT doc_id, length(t) AS doc_chars, array_to_string(list_filter(list_transform({Q.lines(
    "array_to_string(list_filter(string_split_regex(t, '(?m)^[ \\t]*```.*$'), lambda p, i: i % 2 = 1), chr(10))"
  )}, lambda r: CASE WHEN regexp_matches(r, '^\s*#') THEN NULL
    WHEN regexp_matches(r, '^\s*\|') THEN nullif(array_to_string(list_filter(list_transform(
      string_split(r, '|'), lambda c: {Q.strip('c')}), lambda c: length(c) >= 50), chr(10)), '')
    ELSE r END), lambda r: r IS NOT NULL), chr(10)) AS b FROM framed
)"""


@query(
    "body_scope",
    f"""WITH {FRAMED_SQL}, {BODY_SQL}
SELECT doc_id, sha256(b) AS body_sha, length(b) AS body_chars, doc_chars FROM body""",
)
def body_scope(spark, sf_dir):
    scoped = textstyle.body_scope(framed(spark, sf_dir), "doc_id", "text")
    return scoped.select("doc_id", F.sha2("body_text", 256).alias("body_sha"), "body_chars", "doc_chars")


@query(
    "running_fence",
    f"""WITH l AS (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line
  FROM (SELECT doc_id, {Q.lines('text')} AS ls FROM documents)),
f AS (SELECT doc_id, line_no, line_no % 5 = 0 OR regexp_matches(line, '^\\s*```') AS fence FROM l)
SELECT doc_id, line_no, fence OR sum(CAST(fence AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AS in_fence
FROM f""",
)
def running_fence(spark, sf_dir):
    """Every fifth line of a document becomes a fence."""
    fenced = F.array_join(F.transform(text.lines(F.col("text")), lambda l, i: F.when(i % 5 == 4, "```").otherwise(l)), "\n")
    docs = documents(spark, sf_dir).withColumn("text", fenced)
    return textstyle.fenced_lines(docs, "doc_id", "text").select("doc_id", "line_no", "in_fence")


ENDINGS = ("n", "e", "s", "r", "t")


def _ending(s: str) -> str:
    bare = rf"""regexp_replace({s}, '[.!?…"''”’)\]\s]+$', '')"""
    return f"CASE WHEN right({bare}, 1) IN ('n', 'e', 's', 'r', 't') THEN right({bare}, 1) END"


def metrics_sql(source: str, body: str, extra: str = "") -> str:
    narrative = (
        rf"NOT regexp_matches(p, '^\s*(?:[-*•]|\d+[.)])\s') AND len(list_filter({Q.sentences('p')}, "
        f"lambda s: ({_ending('s')}) IS NOT NULL)) > 0"
    )
    return f"""
parts AS (
  SELECT doc_id{extra}, {body} AS t, {Q.sentences(body)} AS ss, {Q.paragraphs(body)} AS ps FROM {source}),
ended AS (
  SELECT *, list_filter(list_transform(ss, lambda s: {_ending('s')}), lambda e: e IS NOT NULL) AS es,
    len(list_filter(ps, lambda p: {narrative})) AS narr FROM parts),
metrics AS (
  SELECT doc_id{extra}, length(t) AS body_chars, len(ss) AS sentence_count,
    CAST({Q.count('t', '[→①-⑳]')} AS DOUBLE) AS symbols,
    {Q.count('t', '[0-9]')} * 100.0 / nullif(length(t), 0) AS digits_per_100,
    len(es) * 100.0 / nullif(len(ss), 0) AS ending_ratio,
    narr * 100.0 / nullif(len(ps), 0) AS narrative_ratio,
    CAST(len(list_distinct(es)) AS DOUBLE) AS ending_variety,
    list_max(list_transform(['n', 'e', 's', 'r', 't'], lambda x: len(list_filter(es, lambda e: e = x)))) * 100.0
      / nullif(len(es), 0) AS top_ending_share,
    {Q.count('t', 'tion')} * 1000.0 / nullif(length(t), 0) AS cliche_per_1000,
    {Q.count('t', ' the ')} * 400.0 / nullif(length(t), 0) AS contrast_per_400 FROM ended)"""


LONG_SQL = "long AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{a}' AS axis, CAST({a} AS DOUBLE) AS value FROM metrics" for a in textstyle.AXES
) + ")"


def latin_metrics(docs: DataFrame) -> DataFrame:
    """Style metrics with endings of the languages in the tables."""
    return textstyle.style_metrics(
        docs, "doc_id", "text", min_hangul=0.0, endings=ENDINGS, cliches="tion", contrast=" the "
    )


@query(
    "style_metrics",
    f"""WITH {metrics_sql('documents', 'text')}, {LONG_SQL}
SELECT doc_id, axis, round(value, 6) AS value FROM long WHERE value IS NOT NULL""",
)
def style_metrics(spark, sf_dir):
    long = textstyle.axes_long(latin_metrics(documents(spark, sf_dir)), "doc_id")
    return long.withColumn("value", F.round("value", 6))


@query(
    "coverage_guard",
    f"""WITH {FRAMED_SQL}, {BODY_SQL}
SELECT doc_id, CASE WHEN length(b) / doc_chars >= 0.5 AND len({Q.sentences('b')}) > 0
  THEN 'measured' ELSE 'not_measured' END AS coverage FROM body""",
)
def coverage_guard(spark, sf_dir):
    scoped = textstyle.body_scope(framed(spark, sf_dir), "doc_id", "text")
    metrics = textstyle.style_metrics(
        scoped, "doc_id", "body_text", min_hangul=0.0, endings=ENDINGS, keep=["doc_chars"]
    )
    return textstyle.coverage_guard(metrics, min_share=0.5).select("doc_id", "coverage")


BROKEN_SQL = """
limits(axis, cmp, bound, severity) AS (VALUES
  ('symbols', 'max', 0.0, 'violation'), ('ending_ratio', 'min', 58.0, 'violation'),
  ('narrative_ratio', 'min', 25.0, 'warning'), ('digits_per_100', 'max', 4.5, 'warning'),
  ('ending_variety', 'min', 3.0, 'warning'), ('top_ending_share', 'max', 75.0, 'warning'),
  ('contrast_per_400', 'max', 1.0, 'warning'), ('cliche_per_1000', 'max', 4.0, 'warning')),
broken AS (
  SELECT doc_id, axis, value, bound, severity FROM long JOIN limits USING (axis)
  WHERE CASE cmp WHEN 'max' THEN value > bound ELSE value < bound END)"""


@query(
    "apply_profile",
    f"""WITH {metrics_sql('documents', 'text')}, {LONG_SQL}, {BROKEN_SQL}
SELECT doc_id, axis, round(value, 6) AS value, CAST(bound AS DOUBLE) AS bound, severity FROM broken""",
)
def apply_profile(spark, sf_dir):
    long = textstyle.axes_long(latin_metrics(documents(spark, sf_dir)), "doc_id")
    axes = [*lexicon.STYLE_AXES, ("cliche_per_1000", "at_most", 4.0, "warning")]
    return rules.apply_profile(long, "business_plan", axes=axes).withColumn("value", F.round("value", 6))


@query(
    "style_verdict",
    f"""WITH {FRAMED_SQL}, {BODY_SQL}, {metrics_sql('body', 'b', ', doc_chars')}, {LONG_SQL},
{BROKEN_SQL}, v AS (
  SELECT doc_id, coalesce(string_agg(axis, ',' ORDER BY axis) FILTER (severity = 'violation'), '') AS violations,
    coalesce(string_agg(axis, ',' ORDER BY axis) FILTER (severity = 'warning' AND axis <> 'contrast_per_400'), '') AS warnings
  FROM broken GROUP BY 1),
j AS (
  SELECT m.doc_id, coalesce(violations, '') AS violations, coalesce(warnings, '') AS warnings,
    CASE WHEN body_chars / doc_chars >= 0.3 AND sentence_count > 0 THEN 'measured' ELSE 'not_measured' END AS coverage
  FROM metrics m LEFT JOIN v USING (doc_id))
SELECT doc_id, coverage, violations, warnings, 'measured' AS evidence,
  CASE WHEN coverage = 'not_measured' THEN coverage WHEN violations <> '' THEN 'fail'
    WHEN warnings <> '' THEN 'pass_with_warnings' ELSE 'pass' END AS verdict FROM j""",
)
def style_verdict(spark, sf_dir):
    return style_gate.style_verdict(
        framed(spark, sf_dir), "doc_id", "text", "business_plan", min_share=0.3, min_hangul=0.0, endings=ENDINGS,
        cliches="tion", cliche_bound=4.0,
    )


@query(
    "markup_loss",
    rf"""WITH c AS (
  SELECT doc_id, {Q.count('text', r'\*\*[^*\n]+\*\*')} AS before,
    CASE WHEN doc_id % 2 = 0 THEN {Q.count("replace(text, '**', '')", r'\*\*[^*\n]+\*\*')}
      ELSE {Q.count('text', r'\*\*[^*\n]+\*\*')} END AS after FROM documents)
SELECT doc_id, before, after, after < before AS lost FROM c""",
)
def markup_loss(spark, sf_dir):
    before = documents(spark, sf_dir)
    stripped = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("**"), F.lit(""))).otherwise(F.col("text"))
    return textstyle.markup_loss(before, before.withColumn("text", stripped), "doc_id", "text")


@query(
    "cross_section_repeats",
    f"""WITH s AS (
  SELECT source, doc_id, unnest({Q.sentences('text')}) AS sentence FROM documents)
SELECT source, sha256(sentence) AS sentence_sha, count(DISTINCT doc_id) AS sections, count(*) AS copies
FROM s WHERE length(sentence) >= 20 GROUP BY source, sentence HAVING count(DISTINCT doc_id) > 1""",
)
def cross_section_repeats(spark, sf_dir):
    """A source is a document and its documents are the sections."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "source", "text")
    found = textstyle.cross_section_repeats(docs, "source", "doc_id", "text", 20)
    return found.select("source", F.sha2("sentence", 256).alias("sentence_sha"), "sections", "copies")


@query(
    "table_repeats",
    f"""WITH t AS (
  SELECT doc_id, text || chr(10) || array_to_string(list_transform({Q.lines('text')},
    lambda l: '| ' || replace(l, '|', ' ') || ' |'), chr(10)) AS t FROM documents),
r AS (SELECT doc_id, list_transform({Q.lines('t')}, lambda l: {Q.strip('l')}) AS ls FROM t),
c AS (
  SELECT doc_id, array_to_string(list_filter(ls, lambda l: NOT starts_with(l, '|')), chr(10)) AS prose,
    unnest(list_distinct(flatten(list_transform(list_filter(ls, lambda l: starts_with(l, '|')),
      lambda l: list_transform(string_split(l, '|'), lambda x: {Q.strip('x')}))))) AS cell FROM r)
SELECT doc_id, sha256(cell) AS cell_sha FROM c WHERE length(cell) >= 10 AND contains(prose, cell)""",
)
def table_repeats(spark, sf_dir):
    """Documents with a table of their own lines put below."""
    rows = F.array_join(
        F.transform(
            text.lines(F.col("text")),
            lambda line: F.concat(F.lit("| "), F.replace(line, F.lit("|"), F.lit(" ")), F.lit(" |")),
        ),
        "\n",
    )
    docs = documents(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\n"), rows))
    found = textstyle.table_repeats(docs, "doc_id", "text")
    return found.select("doc_id", F.sha2("cell", 256).alias("cell_sha"))


@query(
    "volume_bounds",
    """SELECT doc_id, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars > 5000 THEN 'long' ELSE 'ok' END AS chars_status,
  CASE WHEN doc_id % 6 = 0 THEN 'unmeasured' WHEN n_chars // 1000 < 1 THEN 'short' WHEN n_chars // 1000 > 4 THEN 'long' ELSE 'ok' END AS pages_status
FROM documents""",
)
def volume_bounds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "n_chars").withColumn(
        "pages", F.when(F.col("doc_id") % 6 != 0, F.floor(F.col("n_chars") / 1000))
    )
    return textstyle.volume_bounds(docs, "doc_id", "n_chars", "pages", (500, 5000), (1, 4))


@query(
    "signature_terms",
    f"""WITH t AS (SELECT lang, unnest({Q.tokens('text')}) AS token FROM documents),
c AS (SELECT lang, token, count(*) AS n FROM t GROUP BY ALL),
s AS (
  SELECT lang, token, n, (CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY lang))
    / (CAST(sum(n) OVER (PARTITION BY token) AS DOUBLE) / sum(n) OVER ()) AS score FROM c),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, n DESC, token) AS rank
  FROM s WHERE n >= 20)
SELECT lang, rank, token, n, round(score, 6) AS score FROM r WHERE rank <= 5""",
)
def signature_terms(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return textstyle.signature_terms(docs, "lang", "text", min_count=20, k=5)


@query(
    "format_mix",
    r"""WITH p AS (
  SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
b AS (
  SELECT page_id, kind, length(regexp_extract(w, '(?is)^<[^>]*>(.*)</', 1)) AS chars FROM (
    SELECT page_id, kind, unnest(regexp_extract_all(h, '(?is)<' || tag || '(?:\s[^>]*)?>.*?</' || tag || '>')) AS w
    FROM p, (VALUES ('p', 'text'), ('li', 'table'), ('h1', 'image')) t(tag, kind))),
s AS (
  SELECT page_id, kind, 100.0 * coalesce(sum(chars) FILTER (b.kind = k.kind), 0) AS part, target
  FROM b JOIN (VALUES ('text', 55.0), ('table', 25.0), ('image', 20.0)) k(kind, target) USING (kind) GROUP BY ALL),
a AS (SELECT page_id, sum(chars) AS total FROM b GROUP BY 1)
SELECT a.page_id, k.kind, round(coalesce(part, 0) / total, 6) AS share, CAST(k.target AS DOUBLE) AS target,
  abs(coalesce(part, 0) / total - k.target) <= 10 AS ok
FROM a CROSS JOIN (VALUES ('text', 55.0), ('table', 25.0), ('image', 20.0)) k(kind, target)
LEFT JOIN s ON s.page_id = a.page_id AND s.kind = k.kind""",
)
def format_mix(spark, sf_dir):
    """Paragraphs are text, list items stand for tables, headings for images."""
    pages = texts(spark, sf_dir, "pages", "page_id", "html")
    kinds = F.create_map(*[F.lit(x) for x in ("p", "text", "li", "table", "h1", "image")])
    blocks = html.explode_html_elements(pages, "page_id", "html", "p", "li", "h1").select(
        "page_id", kinds[F.col("tag")].alias("kind"), F.length("inner").alias("chars")
    )
    targets = {"text": 55.0, "table": 25.0, "image": 20.0}
    mix = textstyle.format_mix(blocks, "page_id", "kind", "chars", targets, tolerance=10.0)
    return mix.withColumn("share", F.round("share", 6))
