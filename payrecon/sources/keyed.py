"""Tables that are changed in place by key: copy on write, a bucket of the key's hash at a time.

Rows lie in buckets by the low bits of their key's hash. A change reads the buckets of its keys, writes those that
come out different under new names, and swaps the manifest last; all others stay the files they are. The number of
buckets doubles as rows grow, but a bucket is split only when a change rewrites it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import manifest
from .store import settled

#: Rows of a bucket, beyond which the number of buckets doubles.
BUCKET_ROWS = 500_000


def _place(key: Column, bits: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1)).cast("long")


def _places(keys: DataFrame, key: Column, bits: int) -> set[int]:
    return {r[0] for r in keys.select(_place(key, bits)).distinct().collect()}  # one a bucket at most


def _holding(buckets: list[dict], places: set[int]) -> dict[int, dict]:
    """For each place of the finest buckets the bucket that holds it, where there is one."""
    by = {(b["bits"], b["value"]): b for b in buckets}
    depths = {b["bits"] for b in buckets}
    return {p: b for p in places for d in depths if (b := by.get((d, p & ((1 << d) - 1))))}


def _read(spark: SparkSession, folder: str, state: dict, buckets) -> DataFrame:
    schema = StructType.fromJson(state["schema"])
    paths = sorted({f"{folder}/{b['path']}" for b in buckets})
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _state(spark: SparkSession, folder: str) -> tuple[int, dict]:
    seen, state = manifest.latest(spark, folder)
    if not state:
        raise FileNotFoundError(f"no table at {folder}")
    return seen, state


def _replace(spark: SparkSession, folder: str, seen: int, state: dict, gone: list[dict], rows: DataFrame, bits: int) -> int:
    """Puts rows in the place of the buckets `gone`; the number of buckets written."""
    path = f"data-{uuid.uuid4().hex}"
    placed = rows.withColumn("bucket", _place(F.col(f"`{state['key']}`"), bits))
    placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{path}")
    counts = spark.read.schema("bucket long").parquet(f"{folder}/{path}").groupBy("bucket").count().collect()  # a row a bucket, from footers
    written = [{"bits": bits, "value": r["bucket"], "path": f"{path}/bucket={r['bucket']}", "rows": r["count"]} for r in counts]
    names = {b["path"] for b in gone}
    manifest.swap(spark, folder, seen, state | {"bits": bits, "buckets": [b for b in state["buckets"] if b["path"] not in names] + written}, sorted(names))
    return len(written)


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    """All rows. A table that was never written to is refused."""
    _, state = _state(spark, folder)
    return _read(spark, folder, state, state["buckets"])


def rows_of(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is listed; buckets without such a key are not read. A null key finds nothing."""
    _, state = _state(spark, folder)
    key = F.col(f"`{state['key']}`")
    found = _read(spark, folder, state, _holding(state["buckets"], _places(keys, key, state["bits"])).values())
    return found.join(keys.select(key), state["key"], "left_semi")


def upsert(folder: str, new: DataFrame, key: str = "id", time: str = "uploaded_at", bucket_rows: int = BUCKET_ROWS) -> int:
    """Rows of new come in, or in the place of those with their key; the number of buckets that were written.

    Of several new rows with a key the latest counts, of equally late ones the one with the largest hash. An upsert
    that is run again finds its rows there and writes nothing. A null key is a key like any other; an empty `new`
    changes nothing, and makes an empty table where there is none; columns must be those of the table, `bucket` not
    among them. A writer that another one overtakes fails with manifest.Conflict and has changed nothing.
    """
    spark = new.sparkSession
    seen, state = manifest.latest(spark, folder)
    fresh = not state
    state = state or {"key": key, "bits": 0, "buckets": [], "schema": new.schema.jsonValue()}
    names = {f["name"] for f in state["schema"]["fields"]}
    if state["key"] != key or set(new.columns) != names or "bucket" in names:
        raise ValueError("another key or other columns than the table's")
    columns, own = [F.col(f"`{c}`") for c in new.columns], F.col(f"`{key}`")
    best = F.max_by(F.struct(*columns), F.struct(F.col(f"`{time}`"), F.xxhash64(*columns)))
    staged = settled(new.groupBy(own).agg(best.alias("_row")).select("_row.*"), "upsert-rows")
    grown, bits = sum(b["rows"] for b in state["buckets"]) + staged.count(), state["bits"]
    while grown > bucket_rows << bits:
        bits += 1
    places = _places(staged, own, bits)
    holding = _holding(state["buckets"], places)
    match = F.col(f"n.`{key}`").eqNullSafe(F.col(f"o.`{key}`"))
    same = reduce(Column.__and__, [F.col(f"n.`{c}`").eqNullSafe(F.col(f"o.`{c}`")) for c in new.columns], F.col("_there").isNotNull())
    old = _read(spark, folder, state, holding.values()).withColumn("_there", F.lit(True))
    changed = _places(staged.alias("n").join(old.alias("o"), match, "left").filter(~same), F.col(f"n.`{key}`"), bits)
    if not changed and not fresh:
        return 0
    gone = {b["path"]: b for p, b in holding.items() if p in changed}
    again = [p for p in places if p in changed or p in holding and holding[p]["path"] in gone]
    kept = _read(spark, folder, state, gone.values()).alias("o").join(staged.alias("n"), match, "left_anti")
    rows = kept.unionByName(staged if len(again) == len(places) else staged.filter(_place(own, bits).isin(again)))
    return _replace(spark, folder, seen, state, [*gone.values()], rows, bits)


def delete(folder: str, keys: DataFrame) -> int:
    """Takes out the rows whose key is listed; the number of buckets that held any and are written anew."""
    spark = keys.sparkSession
    seen, state = _state(spark, folder)
    own, bits = F.col(f"`{state['key']}`"), state["bits"]
    holding = _holding(state["buckets"], _places(keys, own, bits))
    listed = keys.select(own).distinct()
    hit = _places(_read(spark, folder, state, holding.values()).join(listed, state["key"], "left_semi"), own, bits)
    gone = {holding[p]["path"]: holding[p] for p in hit}
    if not gone:
        return 0
    kept = _read(spark, folder, state, gone.values()).join(listed, state["key"], "left_anti")
    return _replace(spark, folder, seen, state, [*gone.values()], kept, bits)
