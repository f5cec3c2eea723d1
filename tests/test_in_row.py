"""Forms that work inside the row give what the forms on lines give, without an exchange."""

import random

import pytest

from galley.operators import textstyle
from galley.sources import lines


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(pieces, seed, n=150):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))) for i in range(n)] + [(n, None), (n + 1, "")]


@pytest.mark.parametrize("seed", range(2))
def test_fences(spark, seed):
    rows = texts(["```", " ```py", "\t```", "text", "\n", "\r\n", "\n\n", " ", "\r", "``"], seed)
    docs = spark.createDataFrame(rows, "doc long, body string").repartition(3)
    got = textstyle.fenced_lines(docs, "doc", "body")
    wanted = textstyle.running_fence(lines.explode_lines(docs, "doc", "body"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.select(got.columns).collect()))


@pytest.mark.parametrize("seed", range(2))
def test_sections(spark, seed):
    rows = texts(["[a]", "[b c]", "k=v", "k=", "=x", "m = n=o", "; note", "\n", "\n", "\r\n", " ", "[", "plain", "[]"], seed, 1200)
    docs = spark.createDataFrame(rows, "doc long, body string").repartition(3)
    got = lines.section_settings(docs, "doc", "body")
    wanted = lines.carry_forward_sections(lines.explode_lines(docs, "doc", "body"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) and got.count() > 20


def test_no_exchange(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for df in (textstyle.fenced_lines(docs, "doc_id", "text"), lines.section_settings(docs, "doc_id", "text")):
        assert "Exchange" not in plan(df)
