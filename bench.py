"""Times headline queries: python bench.py prints one JSON line.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of cores.  Each query runs once to warm up what a running
engine has warm, then three times; the median counts.  Building an index is timed apart, and once.
"""

from __future__ import annotations

import json
import os
import statistics
import time


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from sondeur import queries as engine

    def timed(name: str) -> float:
        began = time.perf_counter()
        engine.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    spark.range(1).count()
    out: dict[str, float] = {}
    began = time.perf_counter()
    engine.document_index(spark, folder)
    out["build_index"] = time.perf_counter() - began
    names = ("bm25_term", "bm25_or", "bool_and", "bool_mixed", "bool_inverted", "phrase2", "proximity", "wildcard", "auto_suffix", "spell_query", "facet_both", "sort_num_desc", "topk", "page2", "res_highlight", "idx_postings", "idx_dictionary", "src_html_zones")
    for name in names:
        timed(name)
        out[name] = statistics.median(timed(name) for _ in range(3))
    out = {k: round(v, 3) for k, v in out.items()}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": folder.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
