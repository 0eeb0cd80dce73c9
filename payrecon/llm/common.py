"""What the operators of this subpackage share: tables, the shared scratch folder, row identity."""

from __future__ import annotations

import pickle

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import new_path, settled

#: A word of the space-separated kind: anything between ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


scratch, stored = new_path, settled


def unused(name: str, *dfs: DataFrame) -> str:
    """`name`, with as many underscores in front as make it none of the tables' columns."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of texts that go to a Python worker at a time: Spark's own 64 MB take several times that on both sides.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to BATCH_BYTES, unless it is lower already."""
    now = spark.conf.get(_BATCH, None)
    if now is None or not now.removesuffix("b").isdigit() or int(now.removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


#: Bits of a filter of keys: 4 MB at most, whatever the number of keys.
FILTER_BITS = 1 << 25


def parted(rows: DataFrame, keys: list[Column], known: DataFrame, known_keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose keys may be among those of `known`, rows whose keys are not).

    A bitmap of the hashes of known keys, 4 MB at most and so broadcast, tells them apart where they are: only the
    first part, true partners and false alarms, has to be moved for an exact join. The more keys there are the more
    false alarms; none is ever missed. Keys that are null on both sides count as equal.
    """
    slot = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(FILTER_BITS)) + 1
    at, bucket, bits = unused("_at", rows), unused("_bucket", rows), unused("_bits", rows)
    slots = known.select(slot(known_keys).alias(at))
    pieces = slots.groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits))
    pieces = F.broadcast(stored(pieces, "key-filter"))  # FILTER_BITS / 8 bytes at most
    marked = rows.withColumn(at, slot(keys)).join(pieces, F.bitmap_bucket_number(at) == F.col(bucket), "left")
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return tuple(marked.filter(x).select(*[F.col(f"`{c}`") for c in rows.columns]) for x in (may, ~may))


def crc_of_id(id_col: str) -> Column:
    """crc32 of the id as text, which fixes the learning and the held-out rows."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def hash_share(id_col: str, seed: int, *more: str) -> Column:
    """A number in [0, 1) that only the seed, the id and `more` columns fix: the same rows are sampled in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), *more), F.lit(1 << 40)) / F.lit(float(1 << 40))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Shipped:
    """A value for the tasks, broadcast together with its classes; get() unpacks it once a task."""

    def __init__(self, spark: SparkSession, value) -> None:
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.value = []

    def __getstate__(self) -> dict:
        return {"packed": self.packed, "value": []}

    def get(self):
        if not self.value:
            self.value.append(pickle.loads(self.packed.value))
        return self.value[0]
