"""The corpus pipeline: five stages, each written as Parquet and read back as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import byte_bpe, edit_match, language_crf, ngram_join, pii_semicrf
from galley.llm.common import prepare, stored

LEAST_LANGUAGE_SCORE = 0.3


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents without a language, or with one that stays unsure, go."""
    prepare(spark, 1500)
    model = language_crf.trained(docs)
    found = language_crf.identify_languages(docs, model, prefix="_op8_")
    if model is None:  # nothing to learn from: no text is rejected for its language
        return docs
    sure = (F.col("_op8_lang_pred") != language_crf.UNKNOWN) & (F.col("_op8_score") >= LEAST_LANGUAGE_SCORE)
    return found.where(sure).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each group of near copies stays, that of the smallest id."""
    prepare(spark)
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark item go; those without an id are searched as well."""
    prepare(spark)
    return edit_match.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: personal data is replaced by its kind."""
    prepare(spark)
    return pii_semicrf.mask_personal_data(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the ids of each text, and whether they decode to it."""
    out = byte_bpe.round_trip(docs, prefix="_op2_")
    same = F.col("_op2_decoded") == F.coalesce("text", F.lit("")).cast("binary")
    plain = [c for c in docs.columns if c not in ("n_tokens", "ids", "decodes")]
    return out.select(
        *plain, F.col("_op2_n_tokens").alias("n_tokens"), F.col("_op2_ids").alias("ids"), same.alias("decodes")
    )


STAGES = [
    ("language", identify),
    ("near copies", deduplicate),
    ("decontamination", decontaminate),
    ("personal data", mask),
    ("tokens", tokenize),
]

#: The models and the edit distance have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
