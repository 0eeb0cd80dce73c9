"""Operator 9, SimHash near-dedup with multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, parted, stored, table, unused
from .graph import components

SEED = 42
BITS = 64
MAX_DISTANCE = 3
SHINGLE = 3


def simhash(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text as a signed 64-bit number; 0 without a word.

    bytes.lower() lower-cases A-Z alone and bytes.split() cuts at ASCII white space alone.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], dtype="<u8")
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`_id, _th, _fp` of every row, stored, so that texts are read once."""

    bounded_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(x.as_py()) for x in texts], pa.int64())

    rows = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"), of(F.col(text_col).cast("binary")).alias("_fp")
    )
    return stored(rows, "simhash")


def _segments(fp: Column) -> list[Column]:
    low = F.lit(0xFFFFFFFF).cast("long")
    return [F.shiftrightunsigned(fp, 32), fp.bitwiseAND(low)]


def near_links(prints: DataFrame) -> DataFrame:
    """Pairs `u < v` of different fingerprints `_fp` that differ in at most three bits.

    The 64 bits are two segments of 32. Two fingerprints within three bits agree up to one bit in one of the
    segments, so the table holds each fingerprint under both of its segments, and each fingerprint asks for its
    own segments and for those with one 0 raised to 1: of two segments that differ in one bit, exactly one asks
    for the other. That is 2 rows stored and some 34 asked for a fingerprint, whatever the data. The complete
    distance is part of the join condition, so that nothing but links leaves the join.
    """
    marks = [F.lit(i << 32).cast("long") for i in range(2)]
    fp = F.col("_fp")

    def ball(i: int, segment: Column) -> Column:
        raised = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: segment.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
        return F.transform(F.array_distinct(raised), lambda x: x + marks[i])

    own = F.array(*[s + m for s, m in zip(_segments(fp), marks, strict=True)])
    kept = prints.select(F.explode(own).alias("_key"), fp.alias("u"))
    asked = F.array_union(own, F.concat(*[ball(i, s) for i, s in enumerate(_segments(fp))]))
    asks = prints.select(F.explode(asked).alias("_key"), fp.alias("v"))
    near = (F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_DISTANCE)
    found = kept.hint("merge").join(asks, "_key").filter(near)
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, groups): `_id, _th, _fp` of every row, and per fingerprint of a group of two rows or more
    `_fp, _group` (a fingerprint that names the component) and `_first` (its smallest id, null if all are)."""
    rows = fingerprints(docs, id_col, text_col)
    prints = stored(rows.groupBy("_fp").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_least")), "simhash-kinds")
    linked = components(stored(near_links(prints.select("_fp")), "simhash-links"))
    grouped = prints.join(linked, prints["_fp"] == linked["node"], "left").withColumn("_group", F.coalesce("root", "_fp"))
    grouped = grouped.filter("_n > 1 OR root IS NOT NULL").select("_fp", "_group", "_least")
    first = grouped.groupBy("_group").agg(F.min("_least").alias("_first"))
    return rows, stored(grouped.join(first, "_group").select("_fp", "_group", "_first"), "simhash-groups")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, fingerprint, component_id` for every row.

    Words are cut at ASCII white space after lower-casing A-Z; a fingerprint bit is set if over half of the
    hashes of the 3-word shingles (repeats included) have it. Fingerprints link at three differing bits or
    fewer, and a component's id is the smallest doc_id that links reach.

    Defined cases: null and empty texts and texts of white space have fingerprint 0 and link like any other; a
    text of one or two words is one shingle; repeated rows are rows of one component; a null id belongs to its
    component like any other and the component takes its smallest known id, null if there is none; an empty
    table gives an empty table; other columns are not read.

    At scale: equal fingerprints meet by a map-side minimum before any join, so that copies cost one row; keys
    of 32 bits and more keep the candidates of a key few; links, components and groups are stored tables; the
    join of rows with groups is over two plain exchanges, of which Spark splits hot partitions.
    """
    rows, groups = near_groups(docs, id_col, text_col)
    out = rows.join(groups.select("_fp", "_first"), "_fp", "left").withColumn("_in", F.col("_first").isNotNull())
    return out.select(
        F.col("_id").alias("doc_id"),
        F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("_in"), F.col("_first")).otherwise(F.col("_id")).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that with the smallest id (known ids first, then by hash of text).

    Of rows that repeat both id and text one stays. The columns are those of docs. Texts of rows that stay without
    question are not moved, see parted().
    """
    rows, groups = near_groups(docs, id_col, text_col)
    known = rows.join(groups.select("_fp", "_group"), "_fp", "left").select(
        F.coalesce("_group", "_fp").alias("_group"), F.struct(F.col("_id").isNull().alias("no"), "_id", "_th").alias("_row"),
        F.col("_group").isNotNull().alias("_many"),
    )
    many = stored(known.filter("_many").groupBy("_group", "_row").agg(F.count(F.lit(1)).alias("_n")), "simhash-many")
    best = stored(many.groupBy("_group").agg(F.min("_row").alias("_best")), "simhash-best")
    # Rows of groups, less their best ones: they go. Best ones that are repeated: all but one copy go.
    judged = many.join(best, "_group").select("_row.*", (F.col("_row") != F.col("_best")).alias("_goes"), (F.col("_n") > 1).alias("_again"))
    losers = stored(judged.filter("_goes OR _again").select(F.col("_id").alias("_id2"), F.col("_th").alias("_th2"), "_goes"), "simhash-losers")
    th = unused("_th", docs)
    here = docs.withColumn(th, F.xxhash64(F.col(text_col)))
    asked, apart = parted(here, [F.col(id_col), F.col(th)], losers, ["_id2", "_th2"])
    match = F.col(id_col).eqNullSafe(F.col("_id2")) & (F.col(th) == F.col("_th2"))
    alone = asked.join(losers, match, "left_anti")
    again = asked.join(losers.filter("NOT _goes"), match, "left_semi").dropDuplicates([id_col, th])
    return apart.unionByName(alone).unionByName(again).select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
