"""Files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.statements import payloads, read_exports
from ..sources import hash_index
from ..sources.files import BINARY, with_identity
from ..sources.store import made_paths, release, settled

HISTORY = (
    "id string, filename string, carrier string, uploaded_at timestamp, row_count long, failsafe string, exported_total double, "
    "source_suffix string, source_sha256 string, first_copy string, warnings array<string>, payload string"
)
#: The index of contents: below the history, where its readers do not look.
_HASHES = "_hashes"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The history so far: of a statement that was written twice the later batch counts."""
    if not _exists(spark, path):
        return spark.createDataFrame([], HISTORY)
    rows = spark.read.schema(f"{HISTORY}, batch long").parquet(path)
    fields = [c for c in rows.columns if c not in ("id", "batch")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*fields), "batch").alias("r")).select("id", "r.*")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(folder) and len(system.listStatus(folder)) > 0


def ingest_batch(files: DataFrame, batch: int, history_path: str) -> None:
    """Clean, reconcile and keep the files of one batch. A batch that is run again replaces what it wrote.

    A file whose content an earlier statement has is kept and marked with that statement's id. Earlier contents are
    looked up in an index of hashes, which merges its runs as it grows: the history itself is not read, and of the index
    only what has the batch's own prefixes.
    """
    spark, index = files.sparkSession, f"{history_path}/{_HASHES}"
    mark = len(made_paths(spark))
    hash_index.merge(spark, index, before=batch)
    statements, cells = read_exports(with_identity(files))
    first = F.min(F.struct("uploaded_at", "stmt_id"))
    within = settled(statements.groupBy("sha256").agg(first.alias("_new")), "batch-hashes")
    earlier = settled(hash_index.lookup(index, within, batch), "batch-known")
    marked = statements.join(within, "sha256").join(earlier.select("sha256", F.col("first_id").alias("_old")), "sha256", "left")
    first = F.coalesce("_old", "_new.stmt_id")
    rows = payloads(marked, cells).select(
        F.col("stmt_id").alias("id"), "filename", F.col("template").alias("carrier"), "uploaded_at", F.col("n_rows").alias("row_count"), F.col("status").alias("failsafe"), "exported_total",
        F.col("suffix").alias("source_suffix"), F.col("sha256").alias("source_sha256"), F.when(first != F.col("stmt_id"), first).alias("first_copy"), "warnings", "payload",
    )
    rows.write.mode("overwrite").parquet(f"{history_path}/batch={batch}")
    # What is known with an earlier statement already needs no second entry.
    own = within.join(earlier.select("sha256", "first_at"), "sha256", "left").filter("first_at IS NULL OR first_at > _new.uploaded_at")
    hash_index.add(index, own.select("sha256", F.col("_new.stmt_id").alias("first_id"), F.col("_new.uploaded_at").alias("first_at")), batch)
    release(spark, mark)


def ingest_stream(spark: SparkSession, inbox: str, history_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Follow a folder of delimited exports; each new file becomes a statement of the history, once.

    Restarts go on from the checkpoint. Ids are a hash of path and modification time, so a batch that is
    replayed gives the same ids, and each batch has a folder of its own that it overwrites.
    """
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.{csv,tsv,txt,CSV,TSV,TXT}").load(inbox)
    writer = files.writeStream.foreachBatch(lambda df, batch: ingest_batch(df, batch, history_path)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
