"""Training-data pipeline over ``documents``: stages that filter, mix and encode, each read from the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from galley.llm import decontamination, langid, mixing, queries, simhash, tokenids
from galley.llm.common import saved


def small_batches(spark: SparkSession) -> None:
    """Texts are long: a worker gets them in Arrow batches of about 8 MB, not of ten thousand rows or 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents in no language that the corpus teaches go."""
    small_batches(spark)
    return langid.spoken(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of every group of near-duplicates (five-word shingles, similarity 0.8) the least id stays."""
    small_batches(spark)
    return simhash.distinct_documents(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a passage of the benchmark go."""
    small_batches(spark)
    return decontamination.without_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents as often as the mix takes them; those that it takes zero times go."""
    small_batches(spark)
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: token files, and what is read back from them for every document."""
    small_batches(spark)
    # The workers of the stages before it live on beside it, so its encoder remembers less.
    return tokenids.token_ids(docs, queries.vocabulary(), cached=50_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language id", language),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing", mixed),
    ("token ids", encoded),
]

# Rank profiles, fingerprints, edit matching, dependent rounding and tokenization are beyond SQL; the tests compare
# every stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; every stage reads what the one before wrote to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}").df
    return STAGES[-1][1](spark, docs, sf_dir)
