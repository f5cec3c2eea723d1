"""Queries on tables that are stored as folders of files, as Spark writes them."""

import pytest

from workload import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("folders"))
    for name in ("conversations", "documents", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{path}/{name}.parquet")
    for name in ("orders", "nation", "part", "benchmark", "customer", "supplier"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", ["stream_prompts", "stream_route", "stream_immediate"])
def test_stream_of_a_folder(spark, folders, name):
    got, wanted = QUERIES[name](spark, folders), QUERIES[name](spark, SF)
    assert wanted.count() > 0
    assert got.exceptAll(wanted).count() == 0
    assert wanted.exceptAll(got).count() == 0


def test_markup_is_made_after_the_shuffle(spark, tmp_path):
    """What is gathered per order are the columns of its lines, not their markup."""
    from workload.drift_forms import form_sections

    line = "1L l_orderkey, 2L l_partkey, 3L l_suppkey, 1 l_linenumber, 4.0D l_quantity, 9.5D l_extendedprice, 0D l_discount, 0D l_tax, 'R' l_returnflag, 'O' l_linestatus"
    spark.sql(f"SELECT {line} UNION ALL SELECT {line.replace('3L', '2L').replace(chr(39) + 'R', chr(39) + 'N')}").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = form_sections(spark, str(tmp_path))
    xml = found.first().xml
    assert xml.count("<hp:tc ") == 6 and xml.index("<hp:t>N</hp:t>") < xml.index("<hp:t>R</hp:t>")
    plan = found._jdf.queryExecution().executedPlan().toString()
    shuffled = plan[plan.index("Exchange") :]
    assert "l_orderkey" in shuffled and "hp:tc" not in shuffled


def test_batches_to_python_are_bounded_in_bytes(spark):
    """A worker holds some megabytes at once, however long the texts of a table are."""
    from galley.operators import linediff
    from galley.session import apply_defaults

    docs = apply_defaults(spark).range(0, 200, 1, 1).selectExpr("id", "concat(repeat('word ', 20000), '\n', id) AS text")
    sizes = lambda batches: (__import__("pyarrow").RecordBatch.from_arrays([[b.nbytes]], names=["n"]) for b in batches)
    assert docs.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] < 8 << 20
    changed = docs.selectExpr("id", "concat(text, '\nmore') AS text")
    assert sorted(r.line for r in linediff.ordered_changes(changed, docs, "id", "text").collect()) == ["more"] * 200
