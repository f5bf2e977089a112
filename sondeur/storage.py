"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Inputs of fewer bytes a core are spread over all cores before slow work: few row groups may hold them.
SMALL = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where it is unset, a fresh folder of this machine, as in tests, but never on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isDefined():
            return context.getCheckpointDir().get()
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again."""
    at = fresh(df.sparkSession, name)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._stored_at = at
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete stored tables that no plan reads any more; others, and None, are passed over."""
    for df in tables:
        if df is not None and (at := getattr(df, "_stored_at", None)):
            remove(df.sparkSession, at)


def _at(spark: SparkSession, path: str):  # noqa: ANN202 - a file system and a path of the JVM
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), made


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _at(spark, path)
    return system.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    system, at = _at(spark, path)
    system.delete(at, True)


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file."""
    system, at = _at(spark, path)
    out = system.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def drop_stored(spark: SparkSession) -> None:
    """Delete all tables that this application stored, when none of their readers is needed any more."""
    remove(spark, _tables(spark))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is known to be small; a large one keeps its partitions and isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df
