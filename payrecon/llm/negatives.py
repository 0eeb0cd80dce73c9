"""Operator 13, hard negatives from embeddings by Kronecker-packed products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

#: Components are multiplied by this and cut down to integers.
SCALE = 256
#: Rows of a block of candidates and of a block of anchors: what a task compares at a time.
BLOCK, ANCHOR_BLOCK = 4096, 512
#: Bits of the wide integers; scores must be below 2 ** WIDE.
WIDE = 63


def integers(lists: pa.Array) -> np.ndarray:
    """floor(SCALE * x) of every component, a row a vector; shorter vectors are filled up with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(SCALE * lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    if np.abs(flat).max(initial=0) >= 1 << WIDE:
        raise ArithmeticError("a component is too large for scores of 64 bits")
    out = np.zeros((len(sizes), max(sizes, default=0)), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat.astype(np.int64)
    return out


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products, a row an anchor and a column a candidate.

    A bias makes the components of both sides no negatives. Those of several candidates stand in separate fields of one
    wide integer (field j of integer k belongs to candidate j * width + k), each wide enough for a whole sum of products,
    so that one product with a component of an anchor serves all of them. In the end the fields are taken apart and what
    the biases have added is taken off. The more bits the components need the fewer fields there are.
    """
    parts, n = min(anchors.shape[1], candidates.shape[1]), len(candidates)  # zeros have no part in a product
    anchors, candidates = anchors[:, :parts], candidates[:, :parts]
    a_bias, c_bias = (int(np.abs(x).max(initial=0)) for x in (anchors, candidates))
    bits = max(1, (4 * a_bias * c_bias * parts).bit_length())
    if bits > WIDE:
        raise ArithmeticError("scores may not fit 64 bits")
    fields = WIDE // bits
    width = -(-n // fields)
    raised = np.zeros((fields * width, parts), dtype=np.uint64)
    raised[:n] = candidates + c_bias
    packed = np.zeros((parts, width), dtype=np.uint64)
    for j in range(fields):
        packed |= raised[j * width : (j + 1) * width].T << np.uint64(j * bits)
    total, factors = np.zeros((len(anchors), width), dtype=np.uint64), (anchors + a_bias).astype(np.uint64)
    product = np.empty_like(total)
    for d in range(parts):
        total += np.multiply.outer(factors[:, d], packed[d], out=product)
    mask = np.uint64((1 << bits) - 1)
    sums = np.concatenate([(total >> np.uint64(j * bits)) & mask for j in range(fields)], axis=1)[:, :n].astype(np.int64)
    return sums - a_bias * candidates.sum(axis=1) - c_bias * (anchors.sum(axis=1) + parts * a_bias)[:, None]


def first(scores: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """(row, column) of the k largest allowed scores of each row, largest first; of equals the left one first."""
    n, low = scores.shape[1], np.iinfo(np.int64).min
    if np.abs(scores).max(initial=0) >= (1 << 62) // max(n, 1):
        for r in range(len(scores)):
            columns = np.flatnonzero(allowed[r])
            yield from ((r, int(c)) for c in columns[np.argsort(-scores[r, columns], kind="stable")[:k]])
        return
    keys = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), low)  # no two allowed ones are equal
    best = np.argpartition(keys, n - k, axis=1)[:, n - k :] if n > k else np.tile(np.arange(n), (len(keys), 1))
    best = np.take_along_axis(best, np.argsort(-np.take_along_axis(keys, best, axis=1), axis=1), axis=1)
    for r, i in zip(*np.nonzero(np.take_along_axis(keys, best, axis=1) > low), strict=True):
        yield int(r), int(best[r, i])


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """`id, label, vector` of the rows that take part: id and label known, a vector, all its components finite."""
    sound = F.forall(F.col(vector_col).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    known = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & sound)
    return known.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(batches).sort_by("id")
    ends = pa.array([0, whole.num_rows], pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays(whole[c].chunks)) for c in whole.column_names]
    return pa.RecordBatch.from_arrays(lists, whole.column_names)


def _blocks(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """Rows packed where they lie into rows of up to `size`: a list a column, by ascending id."""
    schema = T.StructType([T.StructField(f"{prefix}{f.name}", T.ArrayType(f.dataType)) for f in rows.schema])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in (batch.slice(at, size) for at in range(0, batch.num_rows, size)):
                if n + part.num_rows > size:
                    yield _one(held).rename_columns(schema.names)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield _one(held).rename_columns(schema.names)

    return rows.mapInArrow(pack, schema)


#: What a comparison finds: the anchor, the number of its positive (-1 without), and the candidate with its score.
_FOUND = "no long, at int, found long, score long"


def _compare(anchors: DataFrame, candidates: DataFrame, most: int, ratio: tuple[int, int] | None = None) -> DataFrame:
    """The first `most` candidates of each anchor, with `rank`: without a ratio those of its label; with one those of other
    labels, for each of its positives, within [ratio of the positive's score, that score]."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in batch.schema.names}
                no, ids, labels = (row[c].to_numpy(zero_copy_only=False) for c in ("a_no", "c_id", "c_label"))
                scores = products(integers(row["a_vector"]), integers(row["c_vector"]))
                same = row["a_label"].to_numpy(zero_copy_only=False)[:, None] == labels
                found = []
                if ratio is None:
                    other = row["a_id"].to_numpy(zero_copy_only=False)[:, None] != ids
                    found = [(no[r], -1, ids[c], scores[r, c]) for r, c in first(scores, same & other, most)]
                else:
                    of = row["a_scores"].to_pylist()
                    for at in range(max(map(len, of), default=0)):
                        rows = [r for r, own in enumerate(of) if len(own) > at]
                        upper = np.array([of[r][at] for r in rows], dtype=np.int64)[:, None]
                        lower = np.array([-(-ratio[0] * of[r][at] // ratio[1]) for r in rows], dtype=np.int64)[:, None]
                        part = scores[rows]
                        found += [(no[rows[r]], at, ids[c], part[r, c]) for r, c in first(part, ~same[rows] & (lower <= part) & (part <= upper), most)]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                columns = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["no", "at", "found", "score"])

    pairs = candidates.crossJoin(anchors)  # the stated query set against all rows; a row is a block
    order = Window.partitionBy("no", "at").orderBy(F.desc("score"), "found")
    return pairs.mapInArrow(compare, _FOUND).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, ratio: tuple[int, int] = (80, 100)) -> DataFrame:
    """`anchor_id, positive_id, rank, negative_id, positive_score, negative_score` for usable() rows `id, label, vector`.

    Scores are inner products of the components as integers, floor(256 x). Anchors are the rows whose id `every`
    divides. An anchor's positives are its first `positives` other rows of its label; for each, the first `negatives`
    rows of other labels count whose score lies between ratio[0] / ratio[1] of the positive's and the positive's.
    Higher scores come first, then smaller ids.

    Defined cases: a row without id takes no part, as it could not be named; vectors of different length are compared
    over the shorter length, and one without components scores 0 with all; rows that share an id are rows of their
    own, but none is a positive of an anchor of its own id; a repeated anchor gives its rows as often; a positive score
    below 0 admits nothing; an empty table gives an empty table; scores that might not fit 64 bits fail the job with an
    ArithmeticError, as sums of Spark's own do.

    At scale: every anchor has to meet every row, so the work is their product. Rows lie in blocks of 4,096, anchors in
    blocks of 512, and what Spark joins is blocks: it broadcasts the anchors' while they are below its threshold, else
    it pairs partitions, without a shuffle of vectors. Of each pair of blocks the first few candidates of an anchor leave
    the task, and Spark cuts these down again before it shuffles them.
    """
    candidates = stored(_blocks(rows, BLOCK, "c_"), "negatives-rows")
    asked = stored(rows.filter(F.col("id") % every == 0).withColumn("no", F.monotonically_increasing_id()), "negatives-anchors")
    parts = max(1, -(-asked.count() // ANCHOR_BLOCK))
    dealt = lambda df: stored(_blocks(df.repartition(parts), ANCHOR_BLOCK, "a_"), "negatives-blocks")
    best = stored(_compare(dealt(asked), candidates, positives).select("no", "rank", "found", "score"), "negatives-positives")
    lists = best.groupBy("no").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    near = _compare(dealt(asked.join(lists, "no")), candidates, negatives, ratio)
    names = asked.select(F.col("no").alias("_no"), F.col("id").alias("anchor_id"))
    known = best.join(names, F.col("no") == F.col("_no")).select(
        "_no", "anchor_id", (F.col("rank") - 1).alias("_at"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")
    )
    both = near.join(known, (F.col("no") == F.col("_no")) & (F.col("at") == F.col("_at")))
    return both.select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return hard_negatives(rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


SQL = {
    "op13_hard_negatives": """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER own AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW own AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY rank <= 5
"""
}
