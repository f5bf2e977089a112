"""The queries of this subpackage, and SQL for those that SQL can express.

Each query applies its operator, as in production, to the whole of its table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, licences, mixing, neardup, packing, phrases, quality, tokencount, warc
from .common import shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.table_turns(table(spark, sf_dir, "conversations"))


def op4_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_warc(table(spark, sf_dir, "pages"), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")


def op5_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrase_groups(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "size", "copy", "keep")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_related_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_source_mixing, op3_chat_formatting, op4_warc_writer, op5_phrase_fingerprints,
        op6_token_counts, op7_minhash_near_dedup, op8_quality_classifier, op9_related_packing, op10_licence_scan,
    )
}
ORACLE: dict[str, str] = {
    "op2_source_mixing": mixing.oracle(),
    "op3_chat_formatting": chat.oracle(),
    "op10_licence_scan": licences.oracle(),
}
