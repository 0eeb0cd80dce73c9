"""Which content was seen first: a log-structured index of hashes for tables that grow by small batches.

A batch adds one run. FANOUT runs of a level become one run of the next, so that some FANOUT runs a level are all there
ever is, and each entry is rewritten once a level. A small run is one file; a larger one has one file for each prefix of
two digits. The manifest names runs and their prefixes: a batch lists no folder that it does not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest

#: Runs of a level that become one of the next; entries up to which a run is one file.
FANOUT, SMALL = 8, 100_000
#: Of each content the statement that had it first, and the batch that told.
ENTRIES = "sha256 string, first_id string, first_at timestamp, batch long"
_PREFIX = "substring(sha256, 1, 2)"


def _write(entries: DataFrame, index: str, level: int, rows: int, small: int) -> dict:
    """Writes a run of entries, about `rows` of them; what the manifest says of it."""
    spark, path = entries.sparkSession, f"run-{level}-{uuid.uuid4().hex}"
    if rows <= small:
        entries.coalesce(1).sortWithinPartitions("sha256").write.parquet(f"{index}/{path}")
        return {"path": path, "level": level, "rows": rows, "prefixes": []}
    placed = entries.withColumn("prefix", F.expr(_PREFIX)).repartition(min(256, -(-rows // small)), "prefix")
    placed.sortWithinPartitions("prefix", "sha256").write.partitionBy("prefix").parquet(f"{index}/{path}")
    prefixes = spark.read.schema("prefix string").parquet(f"{index}/{path}").distinct().collect()  # from names of folders
    return {"path": path, "level": level, "rows": rows, "prefixes": sorted(r.prefix for r in prefixes)}


def _files(index: str, run: dict, prefixes: set[str] | None = None) -> list[str]:
    """The folders of a run that can hold hashes of these prefixes (all, if None)."""
    if not run["prefixes"]:
        return [f"{index}/{run['path']}"]
    return [f"{index}/{run['path']}/prefix={p}" for p in run["prefixes"] if prefixes is None or p in prefixes]


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(ENTRIES).parquet(*paths) if paths else spark.createDataFrame([], ENTRIES)


def _first(entries: DataFrame) -> DataFrame:
    """One entry a hash: that of the earliest statement."""
    best = entries.groupBy("sha256").agg(F.min(F.struct("first_at", "first_id", "batch")).alias("b"))
    return best.select("sha256", "b.first_id", "b.first_at", "b.batch")


def lookup(index: str, hashes: DataFrame, batch: int) -> DataFrame:
    """`sha256, first_id, first_at` of those `sha256` of hashes that batches other than `batch` have seen."""
    spark = hashes.sparkSession
    runs = manifest.latest(spark, index)[1].get("runs", [])
    wanted = {r[0] for r in hashes.select(F.expr(_PREFIX)).distinct().collect()} if runs else set()  # 256 at most
    known = _read(spark, [p for run in runs for p in _files(index, run, wanted)]).filter(F.col("batch") != batch)
    return _first(known.join(hashes.select("sha256").distinct(), "sha256", "left_semi")).drop("batch")


def merge(spark: SparkSession, index: str, before: int, fanout: int = FANOUT, small: int = SMALL) -> None:
    """Makes one run of the next level of every `fanout` runs of a level that hold only batches below `before`: batches
    that cannot be run again, of which one entry a hash is enough."""
    while True:
        seen, state = manifest.latest(spark, index)
        runs = state.get("runs", [])
        full = next((same for lv in sorted({r["level"] for r in runs}) if len(same := [r for r in runs if r["level"] == lv and r["high"] < before]) >= fanout), None)
        if full is None:
            return
        entries = _first(_read(spark, [p for run in full for p in _files(index, run)]))
        merged = _write(entries, index, full[0]["level"] + 1, sum(r["rows"] for r in full), small)
        merged |= {"low": min(r["low"] for r in full), "high": max(r["high"] for r in full)}
        gone = [r["path"] for r in full]
        manifest.swap(spark, index, seen, {"runs": [r for r in runs if r["path"] not in gone] + [merged]}, gone)


def add(index: str, entries: DataFrame, batch: int, small: int = SMALL) -> None:
    """Puts entries (`sha256, first_id, first_at`, each hash once) in as those of `batch`, in the place of any it had."""
    spark = entries.sparkSession
    seen, state = manifest.latest(spark, index)
    runs = state.get("runs", [])
    own = entries.select("sha256", "first_id", "first_at", F.lit(batch).cast("long").alias("batch"))
    own = _write(own, index, 0, entries.count(), small) | {"low": batch, "high": batch}
    gone = [r["path"] for r in runs if r["level"] == 0 and r["low"] == r["high"] == batch]
    manifest.swap(spark, index, seen, {"runs": [r for r in runs if r["path"] not in gone] + [own]}, gone)


def listed(spark: SparkSession, index: str) -> tuple[int, int]:
    """(runs, folders) that the index consists of."""
    runs = manifest.latest(spark, index)[1].get("runs", [])
    return len(runs), sum(len(_files(index, r)) for r in runs)
