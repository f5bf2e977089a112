"""A corpus pipeline: quality classifier, quality rules, near-duplicate removal, source mixing, packing.

Each stage is called with the documents that the stage before it left.  All but the last return the columns of
documents, extra ones with clashing names included; the last returns windows.  Models are fitted on the labelled rows of
the documents table itself.

Defined results: ids may be of any type.  A null, empty or blank text is rejected by the first stage.  A null doc_id is
judged by its text like any other, is never a near copy, and takes part in mixing and packing as a value.  Of repeated rows near-duplicate
removal keeps one.  An empty table gives no windows; without labels the first two stages reject blank texts alone.

A batch of whole texts is held by Parquet's reader (by default 4096 rows) on the heap of each task, and another on the way to
Python (64 MB): each stage lowers both to BOUNDS for its session, which stays so, as its result is read later.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sondeur.llm import mixing, neardup, packing, quality
from sondeur.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The most rows that Parquet's reader decodes at a time, and bytes sent to Python at a time: long texts are many bytes a row.
BOUNDS = {"spark.sql.parquet.columnarReaderBatchSize": 64, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Set BOUNDS, but for those that the session has lower."""
    for key, most in BOUNDS.items():
        now = int(spark.conf.get(key).rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(key, most)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.only_good(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.only_ordinary(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return neardup.deduplicated(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.mixture(docs)


def related_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near-duplicate removal", minhash_near_dedup),
    ("source mixing", mixing_sources),
    ("packing", related_packing),
]

#: Trained models and minimum hashes are beyond SQL; a brute-force version in the tests takes its place.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
