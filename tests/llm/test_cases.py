"""Each operator over tables of hard cases, and over empty ones; and each query with SQL against that SQL."""

import os
import uuid
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sondeur.llm import chat, licences, mixing, neardup, packing, phrases, quality, tokencount, warc
from sondeur.llm.common import shared_folder
from sondeur.llm.queries import ORACLE, QUERIES

OPERATORS = {
    "op1": lambda d, labels: quality.quality_rules(d, labels),
    "op1 filter": lambda d, labels: quality.only_ordinary(d, d, labels),
    "op2": lambda d, labels: mixing.mixed(d),
    "op2 rows": lambda d, labels: mixing.mixture(d),
    "op3": lambda d, labels: chat.table_turns(d.withColumn("turn", F.col("doc_id")).withColumn("role", F.col("lang")), "doc_id"),
    "op4": lambda d, labels: _written(d),
    "op5": lambda d, labels: phrases.phrase_groups(d),
    "op6": lambda d, labels: tokencount.token_counts(d),
    "op7": lambda d, labels: neardup.near_duplicates(d),
    "op7 filter": lambda d, labels: neardup.deduplicated(d),
    "op8": lambda d, labels: quality.quality_classifier(d, labels),
    "op8 filter": lambda d, labels: quality.only_good(d, d, labels),
    "op9": lambda d, labels: packing.packed(d),
    "op10": lambda d, labels: licences.licence_scan(d),
}


def _written(d):
    """The table as pages; their ids are doc_ids."""
    pages = d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumn("url", F.concat(F.lit("http://x.org/"), "source"))
    return warc.write_warc(pages, f"{shared_folder(d.sparkSession)}/warc-{uuid.uuid4().hex}", roll=100_000).withColumnRenamed("page_id", "doc_id")


ONE_FOR_EACH = {"op1", "op3", "op4", "op5", "op6", "op8", "op10"}


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_cases(name, messy, labels):
    rows = OPERATORS[name](messy, labels).collect()
    ids = Counter(r["doc_id"] for r in messy.select("doc_id").collect())
    got = Counter(r["doc_id"] for r in rows)
    if name in ONE_FOR_EACH:
        assert got == ids
    assert set(got) <= set(ids)
    if name.endswith(("filter", "rows")):
        assert OPERATORS[name](messy, labels).columns == messy.columns


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, nothing, messy, labels):
    none = labels.where(F.lit(False))
    assert OPERATORS[name](nothing, none).count() == 0
    assert OPERATORS[name](nothing, labels).count() == 0
    if name[:3] in ("op1", "op8") and name != "op10":
        OPERATORS[name](messy, none).collect()  # without labels, only blank texts go


def test_without_labels_only_blank_texts_go(messy, labels):
    none = labels.where(F.lit(False))
    for f in (quality.only_good, quality.only_ordinary):
        kept = Counter(r["doc_id"] for r in f(messy, messy, none).collect())
        blank = Counter(r["doc_id"] for r in messy.where(r"text IS NULL OR NOT text RLIKE '\\S'").collect())
        assert kept == Counter(r["doc_id"] for r in messy.collect()) - blank


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(name, spark, sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    own, there = QUERIES[name](spark, sf), con.execute(ORACLE[name])
    columns = [d[0] for d in there.description]
    assert sorted(columns) == sorted(own.columns)
    assert Counter(tuple(r) for r in own.select(*columns).collect()) == Counter(there.fetchall())


def test_nothing_is_dropped_by_sql_of_hard_cases(spark, messy, tmp_path):
    """Source mixing and licence scans over the hard cases, against their SQL over the same rows."""
    messy.select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    for f, sql in ((mixing.mixed, mixing.oracle()), (licences.licence_scan, licences.oracle())):
        there = con.execute(sql)
        columns = [d[0] for d in there.description]
        assert Counter(tuple(r) for r in f(messy).select(*columns).collect()) == Counter(there.fetchall())
