"""Checks against rule tables, with an explicit "not measured" state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import lexicon, text
from galley.schema import require


def judge(
    measures: DataFrame, rules: DataFrame, key: Sequence[str], kind: str, mode: str | None = None
) -> DataFrame:
    """One row per key and rule of each of its kinds: (key, kind, metric, value, status).

    `kind` names the column of both tables that tells which rules apply to a key;
    a key measured under several kinds answers to the rules of all of them, each
    with the values of its own kind. A missing row and a NULL value are both
    `unmeasured`, never a pass; so is a key under a kind without rules or without a
    kind, with one row that has no metric. Under its mode a rule is only `info`;
    an advisory rule warns instead of failing.
    """
    require(measures, *key, kind, "metric", "value", *([mode] if mode else []))
    require(rules, kind, "metric", "comparator", "bound", "tolerance", "info_mode", "mandatory")
    of_key = measures.groupBy(*key, kind).agg((F.max(mode) if mode else F.lit(None).cast("string")).alias("_mode"))
    expected = of_key.join(rules, kind, "left")
    joined = expected.join(measures.select(*key, kind, "metric", "value"), [*key, kind, "metric"], "left")
    value, bound, slack = F.col("value"), F.col("bound"), F.col("tolerance")
    holds = (
        F.when(F.col("comparator") == "equals", value == bound)
        .when(F.col("comparator") == "at_least", value >= bound - slack)
        .when(F.col("comparator") == "at_most", value <= bound + slack)
        .when(F.col("comparator") == "within", F.abs(value - bound) <= slack)
    )
    status = (
        F.when(F.col("info_mode") == F.col("_mode"), "info")
        .when(holds.isNull(), "unmeasured")
        .when(holds, "pass")
        .when(F.col("mandatory"), "fail")
        .otherwise("warn")
    )
    return joined.select(*key, kind, "metric", "value", status.alias("status"))


def _verdict_columns() -> list[Column]:
    status = F.col("status")
    return [
        F.when(F.count(F.lit(1)) == 0, "not_measured")
        .when(F.bool_or(status == "fail"), "fail")
        .when(F.bool_or(status.isin("unmeasured", "warn")), "pass_with_warnings")
        .otherwise("pass")
        .alias("verdict"),
        F.array_join(F.array_sort(F.collect_set(F.when(status == "fail", F.col("metric")))), ",").alias("failures"),
    ]


def verdict(judged: DataFrame, key: Sequence[str]) -> DataFrame:
    """One verdict per key. The failure list is bounded by the rule table."""
    require(judged, *key, "metric", "status")
    return judged.groupBy(*key).agg(*_verdict_columns())


def overall(judged: DataFrame) -> DataFrame:
    """One verdict over everything; an empty input is not a pass."""
    require(judged, "metric", "status")
    return judged.agg(*_verdict_columns())


def contract_check(
    records: DataFrame, key: str, required: Sequence[str], lists: Mapping[str, int | None]
) -> DataFrame:
    """(key, ok, errors) for records with `has_header` and `fields`.

    A value is blank when it is empty, an empty list, or still the <...> of the
    form. `lists` names the list fields and how many items each may hold.
    """
    require(records, key, "has_header", "fields")

    names = list(dict.fromkeys([*required, *lists]))

    def field(name: str) -> Column:
        return F.col(f"_f{names.index(name)}")

    def found_in(name: str) -> Column:
        """The last field of that name, with whether it is blank."""
        last = F.try_element_at(F.filter("fields", lambda f: f["name"] == name), F.lit(-1))
        blank_item = lambda i: (text.strip(i) == "") | text.strip(i).rlike(r"^<.*>$")
        return text.bind(
            last,
            lambda f: F.when(
                f.isNotNull(),
                F.struct(
                    f["is_list"].alias("is_list"),
                    F.size(f["items"]).alias("n"),
                    F.forall(f["items"], blank_item).alias("blank"),
                ),
            ),
        )

    errors = []
    for name in required:
        errors.append(
            F.when(field(name).isNull(), f"missing:{name}").when(field(name)["blank"], f"blank:{name}")
        )
    for name, most in lists.items():
        found = field(name)
        too_many = F.lit(False) if most is None else found["is_list"] & (found["n"] > most)
        errors.append(
            F.when(too_many, f"too_many:{name}").when(
                ~found["is_list"] & ~found["blank"], f"not_a_list:{name}"
            )
        )
    listed = F.when(F.col("has_header"), F.array_compact(F.array(*errors))).otherwise(
        F.array(F.lit("no_header"))
    )
    looked_up = records.select(
        key, "has_header", *[found_in(n).alias(f"_f{k}") for k, n in enumerate(names)]
    )
    return looked_up.select(key, listed.alias("errors")).select(
        key, (F.size("errors") == 0).alias("ok"), "errors"
    )


def resolve_precedence(claims: DataFrame, key: Sequence[str], weakest: int) -> DataFrame:
    """The claim of the best source per key: (key, value, source, conflict, unsupported).

    A value that only the weakest source states is marked, not trusted.
    """
    require(claims, *key, "source", "priority", "value")
    best = F.min(F.struct("priority", "value", "source"))
    return (
        claims.filter(F.col("value").isNotNull())
        .groupBy(*key)
        .agg(best.alias("_b"), (F.min("value") != F.max("value")).alias("conflict"))
        .select(
            *key,
            F.col("_b.value").alias("value"),
            F.col("_b.source").alias("source"),
            "conflict",
            (F.col("_b.priority") >= weakest).alias("unsupported"),
        )
    )


def placeholder_scan(
    docs: DataFrame, key: str, body: str, pattern: str = text.SCREEN_PLACEHOLDER
) -> DataFrame:
    """(key, marks, first_five): places that were never filled in."""
    require(docs, key, body)
    found = F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(0))
    return docs.select(
        key, F.size(found).alias("marks"), F.array_join(F.slice(found, 1, 5), ",").alias("first_five")
    )


def blank_fields(records: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, blanks): cover fields that are NULL, empty or still the <...> of the form."""
    require(records, key, *fields)

    def blank(name: str) -> Column:
        value = text.strip(F.coalesce(F.col(name).cast("string"), F.lit("")))
        return F.when((value == "") | value.rlike(r"^<.*>$"), name)

    return records.select(
        key, F.array_join(F.array_compact(F.array(*[blank(f) for f in fields])), ",").alias("blanks")
    )


def sensitive_scan(
    docs: DataFrame, key: str, body: str, patterns: Mapping[str, str] | None = None
) -> DataFrame:
    """(key, kinds, masked): which private data a text shows, and the text without it."""
    require(docs, key, body)
    kinds = dict(patterns or text.PRIVATE)
    found = [F.when(F.col(body).rlike(p), k) for k, p in kinds.items()]
    return docs.select(
        key,
        F.array_join(F.array_compact(F.array(*found)), ",").alias("kinds"),
        text.mask(F.col(body), kinds).alias("masked"),
    )


def banned_phrases(
    docs: DataFrame, key: str, body: str, banned: Mapping[str, str] | None = None
) -> DataFrame:
    """(key, kind, hits) for each rule with at least one hit; patterns per rule."""
    require(docs, key, body)
    rules = dict(banned or lexicon.BANNED)
    counts = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.regexp_count(F.col(body), F.lit(p)).alias("hits"))
            for k, p in rules.items()
        ]
    )
    return (
        docs.select(key, F.explode(counts).alias("_h")).select(key, "_h.*").filter(F.col("hits") > 0)
    )


def length_bounds(
    df: DataFrame,
    key: str,
    section: str,
    body: str,
    bounds: Mapping[str, tuple[int, int | None]] = lexicon.PAGE_LENGTHS,
    count_spaces: bool = True,
) -> DataFrame:
    """(key, section, chars, status) against the range of the section, by default that of the page kinds of a plan."""
    require(df, key, section, body)
    chars = F.length(F.col(body) if count_spaces else text.squeeze(F.col(body)))
    status = F.lit("no_rule")
    for name, (low, high) in bounds.items():
        here = F.when(F.col("chars") < low, "short")
        if high is not None:
            here = here.when(F.col("chars") > high, "long")
        status = F.when(F.col(section) == name, here.otherwise("ok")).otherwise(status)
    return df.select(key, section, chars.alias("chars")).withColumn("status", status)


def copy_line_lengths(
    plans: DataFrame, key: str, kind: str, body: str,
    bounds: Mapping[str, tuple[int, int]] = lexicon.COPY_LENGTHS,
) -> DataFrame:
    """Each line of a copy on its own; lines end at a bar, a line break or a written \\n."""
    require(plans, key, kind, body)
    rows = F.filter(F.transform(F.split(body, r"\||\\n|\n"), text.strip), lambda r: r != "")
    exploded = plans.select(key, kind, F.posexplode(rows).alias("pos", "line"))
    return length_bounds(exploded.withColumn("_id", F.struct(key, "pos")), "_id", kind, "line", bounds).select(
        F.col(f"_id.{key}").alias(key), F.col("_id.pos").alias("pos"), kind, "chars", "status"
    )


def question_tags(
    questions: DataFrame, body: str, markers: Sequence[str] = lexicon.COMMERCIAL_MARKERS,
    heads: Sequence[str] = (), noise: Sequence[str] = (),
) -> DataFrame:
    """Adds markers, head and noise. Noise is labelled and kept."""
    require(questions, body)
    low = F.lower(F.col(body))
    found = F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: low.contains(m))
    words = F.col("_words")
    head = F.filter(words, lambda w: w.isin(*heads)) if heads else F.array().cast("array<string>")
    is_noise = F.exists(words, lambda w: w.isin(*noise)) if noise else F.lit(False)
    return questions.withColumn("_words", text.tokens(F.col(body))).select(
        *questions.columns,
        F.array_join(found, ",").alias("markers"),
        F.coalesce(F.try_element_at(head, F.lit(1)), F.lit("none")).alias("head"),
        is_noise.alias("noise"),
    )


def catalog_bucket(
    names: DataFrame, name: str, by_prefix: Mapping[str, str], by_namespace: Mapping[str, str],
    builtin: Sequence[str] = (),
) -> DataFrame:
    """Adds bucket: by prefix of the last segment, then by namespace, else other.

    A name of a foreign namespace is `foreign`, a known built-in is `builtin`.
    """
    require(names, name)
    parts = F.split(name, ":")
    last, space = F.element_at(parts, -1), F.when(F.size(parts) > 1, parts[0])
    bucket = F.lit("other")
    if builtin:
        bucket = F.when(last.isin(*builtin), "builtin").otherwise(bucket)
    bucket = F.when(space.isNotNull(), "foreign").otherwise(bucket)
    for key, value in by_namespace.items():
        bucket = F.when(space == key, value).otherwise(bucket)
    ours = space.isNull() | space.isin(*by_namespace)
    for prefix, value in by_prefix.items():
        bucket = F.when(ours & last.startswith(prefix), value).otherwise(bucket)
    return names.withColumn("bucket", bucket)


def tenant_guard(rows: DataFrame, claims: DataFrame, token: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). The tenant comes from the token, never from the row.

    A token that stands for several tenants is rejected.
    """
    require(rows, token, "tenant_claimed")
    require(claims, token, "tenant")
    one = F.min("tenant") == F.max("tenant")
    owners = claims.groupBy(token).agg(
        F.when(one, F.min("tenant")).alias("tenant"), F.coalesce(~one, F.lit(False)).alias("_several")
    )
    joined = rows.join(owners, token, "left")
    fits = F.col("tenant").isNotNull() & (
        F.col("tenant_claimed").isNull() | (F.col("tenant_claimed") == F.col("tenant"))
    )
    accepted = joined.filter(fits).drop("tenant_claimed", "_several")
    reason = (
        F.when(F.col("_several"), "ambiguous_token")
        .when(F.col("tenant").isNull(), "unknown_token")
        .otherwise("tenant_mismatch")
    )
    return accepted, joined.filter(~fits).withColumn("reason", reason).drop("_several")


def candidate_limits(
    docs: DataFrame, key: str, body: str, patterns: Mapping[str, str] | None = None
) -> DataFrame:
    """(key, kind, value, line, confirmed): limits found in a call, none confirmed."""
    require(docs, key, body)
    per_line = docs.select(key, F.explode(text.lines(F.col(body))).alias("line"))

    def of_kind(kind: str, pattern: str) -> Column:
        return F.transform(
            F.regexp_extract_all("line", F.lit(pattern), F.lit(1)),
            lambda value: F.struct(F.lit(kind).alias("kind"), value.alias("value")),
        )

    found = [of_kind(k, p) for k, p in (patterns or lexicon.LIMIT_PATTERNS).items()]
    return per_line.select(key, "line", F.explode(F.concat(*found)).alias("_f")).select(
        key, "_f.*", "line", F.lit(False).alias("confirmed")
    )


def confirmed_limits(candidates: DataFrame) -> DataFrame:
    """Only what a person confirmed may be used downstream."""
    return require(candidates, "confirmed").filter("confirmed")


def active_axes(
    profile: str | None,
    axes: Sequence[tuple[str, str, float, str]] = lexicon.STYLE_AXES,
    profiles: Mapping[str, bool] = lexicon.STYLE_PROFILES,
) -> list[tuple[str, str, float, str]]:
    """The (axis, comparator, bound, severity) rows that hold for a profile.

    An unknown profile is refused before any plan is built. Without a profile,
    or with a provisional one, only the core axes count and only as warnings.
    """
    if profile is not None and profile not in profiles:
        raise ValueError(f"unknown_profile: {profile}")
    if profile is None or profiles[profile]:
        return [(a, c, b, "warning") for a, c, b, _ in axes if a in lexicon.CORE_AXES]
    return list(axes)


def out_of_bound(value: Column, comparator: str, bound: float) -> Column:
    """Whether a value breaks its limit; an unmeasured value does not."""
    broken = value > bound if comparator == "at_most" else value < bound
    return F.coalesce(broken, F.lit(False))


def apply_profile(metrics: DataFrame, profile: str | None, **tables) -> DataFrame:
    """(doc_id, axis, value, bound, severity) for each axis out of its limit."""
    require(metrics, "doc_id", "axis", "value")
    finding = F.lit(None).cast("struct<bound:double,severity:string>")
    for axis, comparator, limit, level in active_axes(profile, **tables):
        broken = (F.col("axis") == axis) & out_of_bound(F.col("value"), comparator, limit)
        finding = F.when(
            broken, F.struct(F.lit(limit).alias("bound"), F.lit(level).alias("severity"))
        ).otherwise(finding)
    return (
        metrics.withColumn("_f", finding)
        .filter(F.col("_f").isNotNull())
        .select("doc_id", "axis", "value", "_f.*")
    )


def profile_findings(profile: str | None, severity: str, **tables) -> Column:
    """Sorted names of the axes a wide metrics row breaks with this severity."""
    names = [
        F.when(out_of_bound(F.col(axis), comparator, limit), axis)
        for axis, comparator, limit, level in active_axes(profile, **tables)
        if level == severity
    ]
    if not names:
        return F.lit("")
    return F.array_join(F.array_sort(F.array_compact(F.array(*names))), ",")


def group_distinct(plans: DataFrame, key: str, kind: str, wanted: int = 3) -> DataFrame:
    """(key, plans, kinds, ok): plans of one script must differ in kind."""
    require(plans, key, kind)
    per_kind = plans.groupBy(key, kind).agg(F.count(F.lit(1)).alias("_n"))
    return per_kind.groupBy(key).agg(
        F.sum("_n").alias("plans"),
        F.count(kind).alias("kinds"),
        ((F.sum("_n") == wanted) & (F.count(kind) == wanted)).alias("ok"),
    )


def setting_vs_result(settings: DataFrame, measured: DataFrame, alternatives: Mapping[str, Sequence[str]]) -> DataFrame:
    """(asset, metric, configured, measured, status): what was set beside what came out.

    A metric may be set under several keys; the first that is filled counts.
    """
    require(settings, "asset", "key", "value")
    require(measured, "asset", "metric", "value")
    names = sorted({k for ks in alternatives.values() for k in ks})
    by_key = settings.filter(F.col("key").isin(*names)).groupBy("asset").agg(
        *[F.max(F.when(F.col("key") == n, F.col("value"))).alias(n) for n in names]
    )
    chosen = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.coalesce(*[F.col(f"`{k}`") for k in ks]).alias("configured"))
            for m, ks in alternatives.items()
        ]
    )
    configured = (
        by_key.select("asset", F.explode(chosen).alias("_c"))
        .select("asset", "_c.*")
        .filter(F.col("configured").isNotNull())
    )
    result = measured.select("asset", "metric", F.col("value").alias("measured"))
    status = (
        F.when(F.col("configured").isNull() | F.col("measured").isNull(), "unmeasured")
        .when(F.col("configured") == F.col("measured"), "same")
        .otherwise("differs")
    )
    return configured.join(result, ["asset", "metric"], "full_outer").withColumn("status", status)
