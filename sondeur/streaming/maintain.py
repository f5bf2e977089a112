"""A stream of documents into a maintained index: each micro-batch is a segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import IndexConfig
from ..operators.incremental import update


def maintain(changes: DataFrame, folder: str, config: IndexConfig, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Apply a stream of collection rows; a column `deleted` that is true deletes a document instead.

    Batch n becomes segment n + 1, deletions and all, and is seen once it is committed.  A batch that runs again after a failure
    writes the same segment again.  Of several rows of a document in one batch one counts: the one with the greatest `version`,
    where there is such a column, and of equal ones the one with the greatest hash.
    """

    def apply(batch: DataFrame, number: int) -> None:
        version = [F.col("version")] if "version" in batch.columns else []
        one = batch.groupBy("doc_id").agg(F.max_by(F.struct("*"), F.struct(*version, F.xxhash64(F.to_json(F.struct("*"))))).alias("row"))
        rows = one.select("row.*").drop("version")
        gone, kept = None, rows
        if "deleted" in rows.columns:
            gone, kept = rows.where("deleted").select("doc_id"), rows.where("NOT coalesce(deleted, false)").drop("deleted")
        update(folder, config, number + 1, kept, gone)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
