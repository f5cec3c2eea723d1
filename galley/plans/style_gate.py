"""Text style from raw documents to violations, with coverage checked first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.functions import lexicon
from galley.operators import rules, textstyle


def style_verdict(
    docs: DataFrame, key: str, body: str, profile: str | None, *, min_share: float, min_hangul: float,
    endings: Sequence[str] = lexicon.ENDINGS, cliches: str | None = None, cliche_bound: float | None = None,
) -> DataFrame:
    """(key, coverage, violations, warnings, evidence, verdict).

    Phrases of the trade have no published limit: who gives a pattern of them
    gives the bound per 1000 characters too, and a text above it is warned.

    A document of which too little was measured gets no pass, however clean
    the measured part is. All of it happens inside the row of the document.
    """
    if (cliches is None) != (cliche_bound is None):
        raise ValueError("give cliches and cliche_bound together")
    axes = list(lexicon.STYLE_AXES)
    if cliche_bound is not None:
        axes.append(("cliche_per_1000", "at_most", cliche_bound, "warning"))
    findings = [rules.profile_findings(profile, s, axes=axes).alias(f"{s}s") for s in ("violation", "warning")]
    scoped = textstyle.body_scope(docs, key, body)
    metrics = textstyle.style_metrics(
        scoped, key, "body_text", min_hangul=min_hangul, endings=endings, cliches=cliches, keep=["doc_chars"]
    )
    judged = textstyle.coverage_guard(metrics, min_share=min_share).select(key, "coverage", *findings)
    provisional = profile is None or lexicon.STYLE_PROFILES[profile]
    return judged.select(
        "*",
        F.lit("provisional" if provisional else "measured").alias("evidence"),
        F.when(F.col("coverage") == "not_measured", "not_measured")
        .when(F.col("violations") != "", "fail")
        .when(F.col("warnings") != "", "pass_with_warnings")
        .otherwise("pass")
        .alias("verdict"),
    )
