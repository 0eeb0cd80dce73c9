"""Tables in the folder that driver and executors share, where a plan has to be cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths that this process has made, by application, in order.
_MADE: dict[str, list[str]] = {}
#: Names of the tables by buckets at these paths.
_TABLES: dict[str, str] = {}
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    known = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if known:
        return known
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: driver and executors need a shared folder")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A new path for one run's files below the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    made_paths(spark).append(path)
    return path


def settled(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written once and read again: lineage is cut, lost executors lose nothing, the size is known, and what follows
    uses it many times and does not compute it again.

    by: a key that df's partitions already lie by. The table then keeps them as buckets, and groups and joins by this key
    and others do not move its rows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if by is None:
        writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    clustered(spark)
    buckets, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"settled_{path.rpartition('-')[2]}"
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, str(buckets))  # a task has a bucket, or a few small ones: no sort by bucket
    try:
        writer.format("parquet").bucketBy(buckets, by).option("path", path).saveAsTable(table)
    finally:
        spark.conf.set(_WRITERS, before)
    _TABLES[path] = table
    return spark.table(table)


def clustered(spark: SparkSession) -> None:
    """Joins by several keys take rows that lie by one of them as they lie."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def made_paths(spark: SparkSession) -> list[str]:
    """What new_path() has given out in this application and release() has not yet removed."""
    return _MADE.setdefault(spark.sparkContext.applicationId, [])


def release(spark: SparkSession, since: int = 0) -> None:
    """Removes the files of all paths given out after the first `since` ones: for callers that have written their
    results, as tables that are still to be read from would be gone."""
    paths = made_paths(spark)
    for path in paths[since:]:
        remove(spark, path)
    del paths[since:]


def remove(spark: SparkSession, path: str) -> None:
    if path in _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
