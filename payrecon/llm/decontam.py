"""Operator 10, benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, parted, stored, table, unused

WINDOW = 13
GRAM = 5
#: Bits of the filter of test fingerprints: 8 MB at most, whatever the size of the benchmark.
FILTER_BITS = 1 << 26
#: What is not part of a word becomes a blank; A-Z become a-z; all bytes from 0x80 up belong to words.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of one text: bytes, where each starts and ends, and a 64-bit hash of each.

    Hashes come from prefix sums of a polynomial modulo 2^64, so that a text costs a few passes over its bytes.
    """

    _known = (_powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16))  # longer texts make their own, and leave nothing

    def __init__(self, text: bytes | None) -> None:
        self.raw = (text or b"").translate(_TABLE)
        chars = np.frombuffer(self.raw, dtype=np.uint8)
        edge = np.diff(np.concatenate(([0], (chars != 32).view(np.int8), [0])))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        powers, inverses = Words._known if len(chars) <= 1 << 16 else (_powers(_BASE, len(chars)), _powers(_INVERSE, len(chars)))
        sums = np.zeros(len(chars) + 1, dtype=np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * powers[: len(chars)], out=sums[1:])
        self.hashes = _mixed((sums[self.end] - sums[self.start]) * inverses[self.start])

    def __len__(self) -> int:
        return len(self.start)

    def text(self, i: int, j: int) -> str:
        """Words i to j, one blank between."""
        return b" ".join(self.raw[self.start[i] : self.end[j - 1]].split()).decode("utf-8", "replace") if i < j else ""

    def grams(self, k: int) -> np.ndarray:
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        out = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            out = out * _MIX[1] + self.hashes[j : j + n]
        return _mixed(out)


def winnowed(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the minimum of some `width` consecutive hashes (the rightmost of equal ones)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, width)
    last = width - 1 - np.argmin(views[:, ::-1], axis=1)
    return np.unique(np.arange(n) + last)


#: The columns of a marked position: its hash, its place, the words of the gram and those around it.
_MARKS = "_hash long, _pos int, _left string, _mid string, _right string"


def _marked(words: Words, k: int, reach: int, at: np.ndarray, hashes: np.ndarray) -> list[tuple]:
    """Rows of _MARKS for grams of k words at the positions `at`, with up to `reach` words on either side."""
    n = len(words)
    return [
        (h, i, words.text(max(0, i - reach), i), words.text(i, i + k), words.text(i + k, min(n, i + k + reach)))
        for h, i in zip(hashes.view(np.int64).tolist(), at.tolist(), strict=True)
    ]


def kept_grams(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed k-grams: of window - k + 1 in a row, which `window` words hold, one stays."""
    grams = words.grams(k)
    at = winnowed(grams, window - k + 1)
    return at, grams[at]


def whole_grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all grams of n words, kept apart from those of other lengths: for short items."""
    grams = words.grams(n)
    return np.arange(len(grams)), grams ^ np.uint64(n)


def _common(a: Column, b: Column, backwards: bool) -> Column:
    """How many words of two contexts agree, counted from the gram outwards."""
    x, y = (F.filter(F.split(c, " "), lambda w: w != "") for c in (a, b))
    if backwards:
        x, y = F.reverse(x), F.reverse(y)
    differ = F.array_position(F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: F.coalesce(p["x"] == p["y"], F.lit(False))), False)
    return F.when(differ > 0, differ - 1).otherwise(F.least(F.size(x), F.size(y))).cast("int")


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)


_ARROW = [("_hash", pa.int64()), ("_pos", pa.int32()), ("_left", pa.string()), ("_mid", pa.string()), ("_right", pa.string())]


def benchmark_marks(benchmark: DataFrame, window: int, k: int, item_col: str, text_col: str) -> DataFrame:
    """The fingerprints of the test items: `_item, _len` (words in a row that the item needs) and the marks."""
    types = pa.schema([("_item", pa.string()), ("_len", pa.int32()), *_ARROW])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Words(text)
                n = len(words)
                if n >= window:
                    rows += [(item, window, *x) for x in _marked(words, k, window - k, *kept_grams(words, window, k))]
                elif n:
                    rows += [(item, n, *x) for x in _marked(words, n, 0, *whole_grams(words, n))]
            yield _batch(rows, types)

    items = benchmark.select(F.col(item_col).cast("string").alias("_item"), F.col(text_col).cast("binary").alias("_text"))
    return items.mapInArrow(of, f"_item string, _len int, {_MARKS}")


def _filter_of(tests: DataFrame) -> dict[int, bytes]:
    """A bitmap of the test fingerprints modulo FILTER_BITS, in pieces of 4 KB: 8 MB at most reach the driver."""
    slot = F.pmod(F.col("_hash"), F.lit(FILTER_BITS)) + 1
    pieces = tests.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    return {r["b"]: bytes(r["bits"]) for r in pieces.collect()}


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Per row of docs: words, words inside any occurrence of a test window, and the items that occur.

    Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. A window is `window`
    consecutive words of an item; an item of fewer words is one window. Returns `_id, _th` (hash of the text),
    `n_words, n_hit, items`.

    Both sides keep the minimum k-gram hash of each window - k + 1 in a row, so that every shared span of
    `window` words has a fingerprint in common; test and training fingerprints are joined, and each hit is
    extended word by word over its context, so that no count rests on a hash. Items of fewer words than the
    window are looked up by grams of their own length.

    Defined cases: null texts have no words; items without words never occur; items that repeat count once by
    item id, null item ids not at all; rows that repeat id and text have the same result each; a null id is an
    id like any other; empty tables give rows without hits or no rows; other columns are not read.

    At scale: a bitmap of fixed size drops training fingerprints that no test has before they leave the task
    (false alarms meet no partner in the join); the test side is a stored table, so Spark broadcasts it only
    below the session's threshold; what is grouped per document are its hits. Texts are never shuffled.
    """
    bounded_batches(docs.sparkSession)
    tests = stored(benchmark_marks(benchmark, window, k, item_col, item_text_col), "winnow-tests")
    lengths = sorted(r[0] for r in tests.filter(F.col("_len") < window).select("_len").distinct().collect())  # fewer than `window`
    pieces = docs.sparkSession.sparkContext.broadcast(_filter_of(tests))
    types = pa.schema([("_row", pa.int32()), ("_n", pa.int64()), *_ARROW])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for b, piece in pieces.value.items():
            bits[(b - 1) * 4096 : b * 4096] = np.frombuffer(piece, dtype=np.uint8)

        def known(at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            slot = hashes & np.uint64(FILTER_BITS - 1)
            hit = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
            return at[hit], hashes[hit]

        for batch in batches:
            rows = []
            for row, text in enumerate(batch.column(2)):
                words = Words(text.as_py())
                n = len(words)
                rows.append((row, n, None, None, None, None, None))
                rows += [(row, n, *x) for x in _marked(words, k, window - k, *known(*kept_grams(words, window, k)))]
                for size in lengths:
                    rows += [(row, n, *x) for x in _marked(words, size, 0, *known(*whole_grams(words, size)))]
            made = _batch(rows, types)
            who = batch.select([0, 1]).take(made.column(0))
            yield pa.RecordBatch.from_arrays([*who.columns, *made.columns[1:]], schema=pa.schema([*who.schema, *list(types)[1:]]))

    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"), F.col(text_col).cast("binary").alias("_text"))
    id_type = texts.schema["_id"].dataType.simpleString()
    found = stored(texts.mapInArrow(of, f"_id {id_type}, _th long, _n long, {_MARKS}"), "winnow-docs")
    hits = found.filter("_hash IS NOT NULL").join(tests.select(*(F.col(c).alias(f"t{c}") for c in tests.columns)), F.col("_hash") == F.col("t_hash"))
    left, right = _common(F.col("_left"), F.col("t_left"), True), _common(F.col("_right"), F.col("t_right"), False)
    hits = hits.filter(F.col("_mid") == F.col("t_mid")).withColumn("_l", left).withColumn("_r", right)
    size = F.size(F.split("_mid", " "))
    hits = hits.filter(F.col("_l") + F.col("_r") + size >= F.col("t_len"))
    spans = hits.select("_id", "_th", (F.col("_pos") - F.col("_l")).alias("s"), (F.col("_pos") + size + F.col("_r")).alias("e"), F.col("t_item").alias("item"))
    # Copies of one row give the same spans: sets, not lists.
    per = spans.groupBy("_id", "_th").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("_spans"), F.sort_array(F.collect_set("item")).alias("items"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    merged = F.aggregate(
        "_spans", start,
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end")),
    )["n"]
    per = per.select(F.col("_id").alias("_id2"), F.col("_th").alias("_th2"), merged.cast("long").alias("n_hit"), "items")
    words = found.filter("_hash IS NULL").select("_id", "_th", F.col("_n").alias("n_words"))
    out = words.join(per, words["_id"].eqNullSafe(per["_id2"]) & (words["_th"] == per["_th2"]), "left")
    none = F.array().cast("array<string>")
    return out.select("_id", "_th", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def is_contaminated() -> Column:
    """A twentieth of the words or more lies in test windows."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that is_contaminated() holds for, with the same columns; see contamination()."""
    bad = contamination(docs, benchmark, id_col=id_col, text_col=text_col).filter(is_contaminated()).select(F.col("_id").alias("_id2"), F.col("_th").alias("_th2"))
    th = unused("_th", docs)
    here = docs.withColumn(th, F.xxhash64(F.col(text_col)))
    bad = stored(bad.distinct(), "contaminated")
    asked, apart = parted(here, [F.col(id_col), F.col(th)], bad, ["_id2", "_th2"])
    alone = asked.join(bad, F.col(id_col).eqNullSafe(F.col("_id2")) & (F.col(th) == F.col("_th2")), "left_anti")
    return apart.unionByName(alone).select(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


SQL = {
    "op10_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bg AS (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM bg),
ks AS (SELECT DISTINCT k FROM bw),
dg AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
h AS (SELECT doc_id, i, dw.k, item_id FROM (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM dg) dw JOIN bw ON bw.g = dw.g AND bw.k = dw.k),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
