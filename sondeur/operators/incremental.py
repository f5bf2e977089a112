"""Keeping an index up to date: what changed, and segments of postings with a table of deleted documents.

An index that is maintained is a folder of segments, each laid out like an index of its own (by bucket and term, with its
own share of the dictionary), and a table of deleted doc_ids.  An update writes a segment of new and changed documents, the
deletion of their old versions, and what both change in the document frequencies; then it commits by one small file.  Readers take
committed segments only, so they see an update whole or not at all; an update that runs again writes the same again.
Statistics come from what is left, so results equal those of a rebuild.

Deleted documents are found from the table of documents, not from postings; a look-up in the dictionary adds up a few
rows a segment; and a query reads the directories of its terms in each segment, which `compact` makes one again.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..sources.files import Loaders, load_folder, number_documents, walk
from ..storage import exists, remove, stored
from .index import VERSION, Index, _laid, build_index, frequencies


def fingerprints(files: DataFrame, by_content: bool = True) -> DataFrame:
    """(path, hash) of files (path, content, modified): of their content, or of their time of change."""
    return files.select("path", (F.crc32("content") if by_content else F.unix_micros("modified")).alias("hash"))


def with_links(hashes: DataFrame, links: DataFrame) -> DataFrame:
    """(path, hash) in which a file's hash covers the files (path, linked) that it takes in, so far as they are there."""
    more = links.select("path", F.explode("linked").alias("to")).join(hashes.select(F.col("path").alias("to"), F.col("hash").alias("h")), "to")
    own = more.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("to", "h"))).alias("all"))
    return hashes.join(own, "path", "left").select("path", F.when(F.col("all").isNull(), F.col("hash")).otherwise(F.xxhash64("hash", "all")).alias("hash"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two tables (path, hash): "added", "changed", "deleted" or "same"."""
    both = old.select("path", F.col("hash").alias("was")).join(new.select("path", F.col("hash").alias("now")), "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return both.select("path", change.alias("change"))


def settings(config: IndexConfig, by_content: bool = True) -> str:
    """What an index depends on; if it differs, the index is built anew."""
    return json.dumps({"version": VERSION, "by_content": by_content, "config": asdict(config)}, sort_keys=True)


def needs_rebuild(spark: SparkSession, folder: str, config: IndexConfig, by_content: bool = True) -> bool:
    """Whether a folder holds no index, or one of another version, configuration or way of telling changes."""
    if not exists(spark, f"{folder}/settings"):
        return True
    return [r[0].strip() for r in spark.read.text(f"{folder}/settings", wholetext=True).collect()] != [settings(config, by_content)]


def committed(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the segments that readers see."""
    return sorted(r["segment"] for r in spark.read.parquet(f"{folder}/commits").collect()) if exists(spark, f"{folder}/commits") else []


def create(folder: str, collection: DataFrame, config: IndexConfig, by_content: bool = True) -> None:
    """A new index of one segment; a folder that holds another is replaced."""
    spark = collection.sparkSession
    remove(spark, folder)
    _write(spark, folder, build_index(collection, config), 0)
    spark.createDataFrame([(settings(config, by_content),)], "value string").coalesce(1).write.text(f"{folder}/settings")


def _write(spark: SparkSession, folder: str, index: Index, segment: int, gone: DataFrame | None = None) -> None:
    """A segment of an index's documents, which deletes their older versions and the documents of `gone` (doc_id)."""
    index.write_postings(f"{folder}/postings/segment={segment}", "overwrite")
    index.docs.write.mode("overwrite").parquet(f"{folder}/docs/segment={segment}")
    ids = spark.read.parquet(f"{folder}/docs/segment={segment}").select("doc_id")
    ids = (ids if gone is None else ids.unionByName(gone.select("doc_id"))).distinct()
    before = [s for s in committed(spark, folder) if s < segment]
    postings, _ = _laid(spark.read.parquet(f"{folder}/postings/segment={segment}"))
    counts = frequencies(postings)
    if before:
        live, docs, _ = _state(spark, folder, before)
        victims = stored(docs.select("doc_id", "segment").join(ids, "doc_id", "left_semi"), "victims")
        if not victims.isEmpty():
            lost = live.join(victims, ["doc_id", "segment"], "left_semi").groupBy("term").agg((-F.count("*")).alias("df"))
            counts = counts.unionByName(lost).groupBy("term").agg(F.sum("df").alias("df"))
        deleted = victims.select("doc_id", F.col("segment").alias("of"))
    else:
        deleted = ids.where(F.lit(False)).select("doc_id", F.lit(0).alias("of"))
    deleted.write.mode("overwrite").parquet(f"{folder}/deleted/by={segment}")
    counts.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/dictionary/segment={segment}")
    spark.createDataFrame([(VERSION,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/segment={segment}")


def update(folder: str, config: IndexConfig, segment: int, collection: DataFrame | None = None, gone: DataFrame | None = None) -> None:
    """Segment `segment`: documents of a collection, new or instead of older ones of their doc_id, and doc_ids to delete."""
    spark = (collection if collection is not None else gone).sparkSession
    if collection is None:
        collection = _nothing(spark, folder, config)
    _write(spark, folder, build_index(collection, config), segment, gone)


def _nothing(spark: SparkSession, folder: str, config: IndexConfig) -> DataFrame:
    kind = dict(spark.read.parquet(f"{folder}/docs").dtypes)
    facets = "".join(f", `{f.name}` string" for f in config.fields if {"enum", "i64"} & set(f.storage))
    return spark.createDataFrame([], f"doc_id {kind['doc_id']}, zones array<struct<field:string,text:string,separation:int>>{facets}")


def append(folder: str, collection: DataFrame, config: IndexConfig, segment: int) -> None:
    update(folder, config, segment, collection)


def delete(folder: str, ids: DataFrame, config: IndexConfig, segment: int) -> None:
    update(folder, config, segment, None, ids)


def _state(spark: SparkSession, folder: str, segments: list[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, docs, lengths) of the live documents of some segments, each with its segment."""
    seen = F.col("segment").isin(*segments)
    postings, lengths = _laid(spark.read.option("mergeSchema", "false").parquet(f"{folder}/postings").where(seen))
    docs = spark.read.parquet(f"{folder}/docs").where(seen)
    gone = spark.read.parquet(f"{folder}/deleted").where(F.col("by").isin(*segments)).select("doc_id", F.col("of").alias("segment")).distinct()
    if gone.isEmpty():
        return postings, docs, lengths
    return tuple(x.join(gone, ["doc_id", "segment"], "left_anti") for x in (postings, docs, lengths))


def read(spark: SparkSession, folder: str, config: IndexConfig) -> Index:
    """The index of all live documents."""
    segments = committed(spark, folder)
    postings, docs, lengths = (x.drop("segment") for x in _state(spark, folder, segments))
    dictionary = spark.read.parquet(f"{folder}/dictionary").where(F.col("segment").isin(*segments)).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    return Index(config, postings, docs, dictionary, lengths)


def compact(spark: SparkSession, folder: str, into: str, config: IndexConfig, by_content: bool = True) -> None:
    """One segment of what is live, in a new folder."""
    _write(spark, into, read(spark, folder, config), 0)
    spark.createDataFrame([(settings(config, by_content),)], "value string").coalesce(1).write.text(f"{into}/settings")


# A folder of files and its index


def _snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """(path, hash, ids, linked) of the files that the last committed segment has seen."""
    return spark.read.parquet(f"{folder}/files/segment={committed(spark, folder)[-1]}")


def _by_file(docs: DataFrame) -> DataFrame:
    return docs.groupBy("path").agg(F.collect_list("doc_id").alias("ids"), F.array_distinct(F.flatten(F.collect_list("linked"))).alias("linked"))


def update_folder(spark: SparkSession, source: str, folder: str, config: IndexConfig, loaders: Loaders | None = None, include: list[str] | None = None, exclude: list[str] | None = None, by_content: bool = True) -> dict[str, int]:
    """Bring an index up to date with a folder of files: how many files were added, changed, deleted or the same.

    A file counts as changed if it, or one that it links in, was changed, or if a linked one has come or gone.  Changed files'
    documents are deleted and their new ones appended under new doc_ids; others aren't read but for their hash.  With no
    index there, or one of other settings, all is built anew.
    """
    hashes = stored(fingerprints(walk(spark, source, include, exclude), by_content), "hashes")
    none = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    if needs_rebuild(spark, folder, config, by_content):
        docs = stored(number_documents(load_folder(spark, source, loaders, include, exclude)), "loaded")
        remove(spark, folder)
        by = _by_file(docs)
        seen = with_links(hashes, by).join(by, "path", "left").select("path", "hash", F.coalesce("ids", none[0]).alias("ids"), F.coalesce("linked", none[1]).alias("linked"))
        seen.write.parquet(f"{folder}/files/segment=0")
        _write(spark, folder, build_index(docs.select("doc_id", "zones"), config), 0)
        spark.createDataFrame([(settings(config, by_content),)], "value string").coalesce(1).write.text(f"{folder}/settings")
        return {"added": hashes.count()}
    old = _snapshot(spark, folder)
    found = stored(changes(old, with_links(hashes, old)), "changes")
    counts = {r["change"]: r["count"] for r in found.groupBy("change").count().collect()}
    if not counts.keys() - {"same"}:
        return counts
    segment = committed(spark, folder)[-1] + 1
    touched = found.where("change IN ('added', 'changed')").select("path")
    gone = old.join(found.where("change IN ('changed', 'deleted')"), "path", "left_semi").select(F.explode("ids").alias("doc_id"))
    last = spark.read.parquet(f"{folder}/docs").agg(F.max("doc_id")).first()[0]
    docs = stored(number_documents(load_folder(spark, source, loaders, include, exclude, touched), -1 if last is None else last), "loaded")
    by = _by_file(docs)
    kept = old.join(found.where("change = 'same'"), "path", "left_semi").select("path", "ids", "linked")
    now = kept.unionByName(touched.join(by, "path", "left").select("path", F.coalesce("ids", none[0]).alias("ids"), F.coalesce("linked", none[1]).alias("linked")))
    with_links(hashes, now).join(now, "path").select("path", "hash", "ids", "linked").write.mode("overwrite").parquet(f"{folder}/files/segment={segment}")
    update(folder, config, segment, docs.select("doc_id", "zones"), gone)
    return counts
