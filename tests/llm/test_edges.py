"""Every operator and stage on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from galley.llm import (
    byte_bpe,
    edit_match,
    html_lstm,
    language_crf,
    lattice_lm,
    ngram_join,
    passage_dedup,
    pii_semicrf,
    quality_net,
    vector_dedup,
)

LONG = "the quick brown fox jumps over a lazy dog and runs far away " * 3000
GERMAN = "der schnelle braune fuchs springt ueber den faulen hund und rennt weit weg davon"
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, LONG, "en"),
    (5, GERMAN, "de"),
    (5, GERMAN, "de"),
    (None, "a text without an id", "en"),
    (7, "éè 中文 \t\n    x", None),
    (8, " ", "de"),
    (9, "12345 67890 !!!", "en"),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def items(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def test_bpe_edges(docs, nothing):
    out = byte_bpe.round_trip(docs).collect()
    assert len(out) == len(ROWS)
    for row in out:
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
        assert row["n_tokens"] == (row["ids"].count(",") + 1 if row["ids"] else 0)
    assert byte_bpe.round_trip(nothing).count() == 0


def test_pii_edges(docs, nothing, spark):
    clash = docs.withColumn("spans", F.lit(1)).withColumn("n_chars", F.lit(0).cast("long"))
    assert pii_semicrf.find_personal_data(clash).count() == len(ROWS)
    masked = pii_semicrf.mask_personal_data(clash)
    assert masked.columns == clash.columns and masked.count() == len(ROWS)
    assert pii_semicrf.find_personal_data(nothing).count() == 0


def test_language_edges(docs, nothing):
    model = language_crf.trained(docs)
    out = {(r["doc_id"], r["text"]): r for r in language_crf.identify_languages(docs, model).collect()}
    for key, row in out.items():
        assert 0 <= row["score"] <= 1
        if key[1] in (None, "", " ", "12345 67890 !!!"):
            assert row["lang_pred"] == "und"
        else:
            assert row["lang_pred"] in ("en", "de")
    assert language_crf.trained(nothing) is None
    assert language_crf.identify_languages(docs, None).where("lang_pred <> 'und'").count() == 0


def test_join_edges(docs, nothing):
    out = ngram_join.ngram_jaccard_join(docs).collect()
    assert len(out) == len(ROWS)
    same = [r for r in out if r["doc_id"] in (2, 3)]  # a null text counts as empty
    assert {r["class_id"] for r in same} == {2} and {r["n_links"] for r in same} == {1}
    clash = docs.withColumn("digest", F.lit("x")).withColumn("component", F.lit(2))
    kept = ngram_join.one_of_each(clash)
    assert kept.columns == clash.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "5", "7", "8", "9", "None"]
    assert ngram_join.ngram_jaccard_join(nothing).count() == 0
    assert ngram_join.one_of_each(nothing).count() == 0


def test_match_edges(docs, nothing, spark):
    wanted = items(spark, None, "", "short", GERMAN, GERMAN)
    found = edit_match.find_leaks(docs, wanted).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(5, 3), (5, 3), (5, 4), (5, 4)]
    assert edit_match.find_leaks(nothing, wanted).count() == 0
    assert edit_match.find_leaks(docs, items(spark)).count() == 0
    assert edit_match.without_leaks(docs, wanted).count() == len(ROWS) - 2


def test_short_items_and_items_without_id(docs, spark):
    wanted = spark.createDataFrame([(None, GERMAN), (1, "Lazy  DOG"), (2, "azy dog"), (3, "")], "item_id int, text string")
    found = edit_match.find_leaks(docs, wanted).collect()
    assert sorted((r["doc_id"], str(r["item_id"]), r["distance"]) for r in found) == [(1, "1", 0), (4, "1", 0), (5, "None", 0), (5, "None", 0)]
    assert all((ROWS[0][1] if r["doc_id"] == 1 else LONG)[r["start"] : r["end"]] == "lazy dog" for r in found if r["item_id"])
    assert sorted(str(r["doc_id"]) for r in edit_match.without_leaks(docs, wanted).collect()) == ["2", "3", "7", "8", "9", "None"]


def test_passage_edges(docs, nothing, spark):
    out = passage_dedup.remove_repeats(docs, 3).collect()
    assert len(out) == len(ROWS) and all(r["n_removed"] == 0 for r in out)  # equal ids do not cut each other
    twice = spark.createDataFrame([(1, LONG), (2, "x" + GERMAN), (3, GERMAN + "y"), (9, LONG)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in passage_dedup.remove_repeats(twice, 3).collect()}
    assert got[9] == (len(LONG), b"") and got[3] == (len(GERMAN), b"y") and got[1][0] == got[2][0] == 0
    assert passage_dedup.remove_repeats(nothing, 3).count() == 0


def test_lattice_edges(docs, nothing):
    weights = ({"▁": -2.0, "a": -2.0, "the": -1.0}, [-6.0] * 256, 3)
    out = lattice_lm.score_texts(docs, "doc_id < 5", "doc_id >= 5", weights).collect()
    assert len(out) == len(ROWS)
    assert {r["n_tokens"] for r in out if r["doc_id"] in (2, 3, 8)} == {1}
    assert all(r["score"] < 0 for r in out)
    assert lattice_lm.score_texts(nothing, "true", "false", weights).count() == 0
    assert lattice_lm.score_texts(docs, "false", "true", weights).where("n_known > 0").count() == 0


def test_quality_edges(docs, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (4, 1), (None, 1), (9, None)], "doc_id long, quality int")
    shared, net = quality_net.trained(docs, labels)
    out = quality_net.score_quality(docs, shared, net).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    shared, net = quality_net.trained(nothing, labels.limit(0))
    assert net is None
    assert {r["score"] for r in quality_net.score_quality(docs, shared, net).collect()} == {0.5}


def test_html_edges(spark):
    pages = [(1, None), (2, ""), (3, "<p>open &amp; unclosed"), (4, "no marks at all"), (5, "<" * 2000), (6, "<div>" * 3000 + "deep"), (6, "x")]
    frame = spark.createDataFrame(pages, "page_id long, html string").withColumn("text", F.lit("clash"))
    out = html_lstm.extract_main_text(frame).collect()
    assert len(out) == len(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert {r["text"] for r in out if r["page_id"] < 3} == {""}
    assert html_lstm.extract_main_text(frame.limit(0)).count() == 0


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.001]), (3, 1, [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, 0, None), (6, 0, [0.0, 0.0]),
        (7, 0, [nan, 1.0]), (8, 0, [inf, 1.0]), (9, 0, [None, 1.0]), (10, 0, []), (11, 0, [1.0]), (12, 0, [2.0, 0.0]),
        (None, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (13, 0, [1.0, 0.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_vectors(frame).collect()}
    assert len(out) == 14
    assert all(out[k] == (3, 1, k == 1) for k in (1, 2, 12, 13))
    assert all(out[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert vector_dedup.near_vectors(frame.limit(0)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, tmp_path, name, stage):
    items(spark, GERMAN, None).write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = (
        spark.createDataFrame(ROWS, SCHEMA)
        .withColumn("source", F.lit(None).cast("string"))
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("score", F.lit("clash"))
        .withColumn("digest", F.lit("clash"))
    )
    out = stage(spark, frame, str(tmp_path))
    rows = out.collect()
    if name != "tokens":
        assert out.columns == frame.columns
    else:
        assert all(r["decodes"] for r in rows) and len(rows) == len(ROWS)
    assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0

