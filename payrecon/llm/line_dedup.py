"""Operator 1, line dedup over overlapping windows of three lines (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parted, stored, table


def line_windows(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """One row per window of consecutive lines that holds a word: `_id, _th, _pos, _h1, _h2`.

    `_h1, _h2` are 128 bits of hash of its lines, `_th` tells texts of the same id apart.
    """
    lines = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(F.col(text_col)).alias("_th"),
        F.split(F.col(text_col), "\n", -1).alias("_lines"),
    ).filter(F.size("_lines") >= window)
    hashed = lines.select(
        "_id",
        "_th",
        F.transform("_lines", lambda x: F.xxhash64(x)).alias("_a"),
        F.transform("_lines", lambda x: F.xxhash64(F.lit(window), x)).alias("_b"),
        F.transform("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_has"),
    )

    def at(column: str, i, j: int):
        return F.get(F.col(column), i + j)

    steps = range(window)
    starts = F.filter(
        F.sequence(F.lit(0), F.size("_a") - window),
        lambda i: F.array_contains(F.array(*[at("_has", i, j) for j in steps]), True),
    )
    windows = F.transform(
        starts,
        lambda i: F.struct(
            i.alias("_pos"),
            F.xxhash64(*[at("_a", i, j) for j in steps]).alias("_h1"),
            F.xxhash64(*[at("_b", i, j) for j in steps]).alias("_h2"),
        ),
    )
    return hashed.select("_id", "_th", F.inline(windows))


def dedup_lines(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop every line that a later occurrence of a repeated window of `window` lines covers.

    A window is `window` consecutive \\n-split lines of one text, at least one of them with a word. Of all
    windows with the same lines the first by (id, position) stays, here or in any other document; of the others
    the covered positions are merged and their lines removed. Returns `doc_id, text, n_lines, n_removed`.

    Defined cases: null texts stay null with 0 lines; texts of fewer lines than the window stay as they are; a
    null id sorts first; rows that repeat both id and text count as one document and get the same result; texts
    of which all lines go become empty; an empty table gives an empty table; other columns are not read.

    At scale: the window hashes are stored once (some 30 bytes a line); repeats are found by a map-side minimum,
    and joined back by sort-merge over two plain exchanges, which Spark splits when a window is hot. Texts that lose
    no line are not moved, see parted().
    """
    windows = stored(line_windows(docs, window, id_col, text_col), "line-windows")
    place = F.struct("_id", "_th", "_pos")
    firsts = windows.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first"))
    firsts = stored(firsts.filter("_n > 1").drop("_n"), "line-firsts")
    later = windows.join(firsts, ["_h1", "_h2"]).filter(~place.eqNullSafe(F.col("_first")))
    covered = stored(later.groupBy("_id", "_th").agg(F.collect_set("_pos").alias("_at")), "line-covered")

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_th2"))
    asked, apart = parted(texts, [F.col("doc_id"), F.col("_th2")], covered, ["_id", "_th"])
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th2") == F.col("_th"))
    joined = asked.join(covered, same, "left")
    lines = F.split(F.col("_text"), "\n", -1)
    gone = F.array_distinct(F.flatten(F.transform("_at", lambda p: F.sequence(p, p + (window - 1)))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    n_lines = F.coalesce(F.array_size("_lines"), F.lit(0)).cast("long").alias("n_lines")
    cut = joined.withColumn("_lines", lines).withColumn("_gone", gone).select(
        "doc_id",
        F.when(F.col("_gone").isNull(), F.col("_text"))
        .otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n"))
        .alias("text"),
        n_lines,
        F.coalesce(F.array_size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
    whole = apart.withColumn("_lines", lines).select("doc_id", F.col("_text").alias("text"), n_lines, F.lit(0).cast("long").alias("n_removed"))
    return whole.unionByName(cut)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


SQL = {
    "op1_line_dedup": r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(range(0, len(lines) - 2)) AS pos, lines FROM l WHERE len(lines) >= 3),
x AS (SELECT doc_id, pos, lines[pos + 1 : pos + 3] AS win FROM w
      WHERE regexp_matches(lines[pos + 1] || ' ' || lines[pos + 2] || ' ' || lines[pos + 3], '[^\x20\x09-\x0D]')),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS rn FROM x),
g AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM r WHERE rn > 1),
c AS (SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN gone IS NULL THEN d.text ELSE
    array_to_string(list_transform(list_filter(range(0, len(lines)), lambda i: NOT list_contains(gone, i)),
                                   lambda i: lines[i + 1]), chr(10)) END AS text,
  coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)""",
}
