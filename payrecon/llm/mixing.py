"""Operator 2, mixing sources to target weights, by Poisson replication (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, stored, table, unused

#: exp(-rate) stays far from the smallest double; larger rates are sums of several Poisson numbers.
LARGEST_STEP = 500.0
OWN = ("mix_copy", "mix_order")
#: Copies that one array holds; rows of sources with higher rates are dealt out in blocks of as many.
BLOCK = 1000


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1): 52 bits of the MD5 of the parts."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def _cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until what is left is below the grain of the uniform number."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    zero = F.exp(-rate)
    start = F.struct(zero.alias("p"), F.array(zero).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + p).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None, source_col: str = "source") -> DataFrame:
    """One row per source: rows, mean repetition rate, and what is needed to invert its distribution.

    rate = (weight / all weights) * all rows / rows of the source. Without weights every source gets the same
    share; sources that `weights` does not name get none.
    """
    counted = docs.groupBy(F.col(source_col).alias("_src")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        counted = counted.withColumn("_w", F.lit(1.0))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        known = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
        counted = counted.withColumn("_w", F.coalesce(F.try_element_at(known, F.coalesce(F.col("_src"), F.lit(""))), F.lit(0.0)))
    counted = stored(counted, "mix-counts")  # one row per source
    total = counted.agg(F.sum("_n").alias("_all"), F.sum("_w").alias("_weights"))
    rates = counted.join(F.broadcast(total)).withColumn(  # `total` is one row
        "_rate", F.coalesce(F.try_divide(F.col("_w") * F.col("_all"), F.col("_weights") * F.col("_n")), F.lit(0.0))
    )
    rates = rates.withColumn("_steps", F.greatest(F.lit(1), F.ceil(F.col("_rate") / LARGEST_STEP)).cast("int"))
    rates = rates.withColumn("_step_rate", F.col("_rate") / F.col("_steps"))
    return stored(rates.withColumn("_cdf", _cdf(F.col("_step_rate"))).select("_src", "_rate", "_steps", "_cdf"), "mix-rates")


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Repeat each document by its own Poisson number and shuffle all copies.

    The number is the inverse of the Poisson distribution of the source's rate at a uniform number which the
    seed and the id fix, so every run and every partitioning gives the same copies. Returns the columns of docs
    with `mix_copy` (1, 2, ...) and `mix_order` (rows come in this order within a partition, and which
    partition a row is in follows from it too).

    Defined cases: a null source is a source of its own; a null id takes the MD5 of the text for it; repeated
    rows get the same number of copies each; empty texts count as rows; an empty table gives an empty table;
    input columns named mix_copy or mix_order are replaced, all others come out as they are. A weight of 0 drops
    the source.

    At scale: rows are counted per source with map-side sums; the table of rates is stored, so that Spark
    broadcasts it if its size is below the session's threshold and else sorts and merges, splitting the
    partition of a hot source; copies are dealt by a hash of id and copy number, which no source can skew. A row of
    which there are more than some BLOCK copies is first repeated by blocks, which other tasks then repeat.
    """
    docs = docs.drop(*OWN)
    rates = source_rates(docs, weights, source_col)
    who_of = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    mix, block = unused("_mix", docs), unused("_block", docs)
    rates = rates.select("_src", F.struct("_rate", "_steps", "_cdf").alias(mix))
    known = docs.join(rates.withColumnRenamed("_src", block), F.col(source_col).eqNullSafe(F.col(block))).drop(block)
    known = known.withColumn(mix, F.struct(f"{mix}.*", who_of.alias("_who")))

    def one(step: Column) -> Column:
        u = _uniform(F.lit(str(seed)), step.cast("string"), F.col(f"{mix}._who"))
        return let(u, lambda x: F.size(F.filter(F.col(f"{mix}._cdf"), lambda c: c < x)))

    n = F.aggregate(F.sequence(F.lit(1), F.col(f"{mix}._steps")), F.lit(0).cast("long"), lambda acc, j: acc + one(j))
    counted = known.withColumn(mix, F.struct(f"{mix}._rate", f"{mix}._who", n.alias("n"))).filter(F.col(f"{mix}.n") > 0)
    numbers = lambda a, b: F.explode(F.sequence(a, b))
    copies = counted.filter(F.col(f"{mix}._rate") <= BLOCK).withColumn("mix_copy", numbers(F.lit(1).cast("long"), F.col(f"{mix}.n")))
    if (rates.agg(F.max(f"{mix}._rate")).first()[0] or 0) > BLOCK:
        many = counted.filter(F.col(f"{mix}._rate") > BLOCK)
        many = many.withColumn(block, numbers(F.lit(0).cast("long"), F.floor((F.col(f"{mix}.n") - 1) / BLOCK))).repartition(F.col(f"{mix}._who"), F.col(block))
        last = F.least((F.col(block) + 1) * BLOCK, F.col(f"{mix}.n"))
        copies = copies.unionByName(many.withColumn("mix_copy", numbers(F.col(block) * BLOCK + 1, last)).drop(block))
    order = F.conv(
        F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), F.col(f"{mix}._who"), F.col("mix_copy").cast("string")).cast("binary")), 1, 15), 16, 10
    ).cast("long")
    copies = copies.withColumn("mix_order", order).select(*docs.columns, *OWN)
    return copies.repartition("mix_order").sortWithinPartitions("mix_order")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, all sources at the same share."""
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "mix_copy", "mix_order", "text")


SQL = {
    "op2_mix_sources": """
WITH RECURSIVE s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n) AS n, count(*) AS k FROM s),
r AS (SELECT s.source, (1.0::DOUBLE * t.n) / (t.k * s.n) AS rate FROM s, t),
c(source, rate, k, p, cdf) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM c
  WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
a AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source),
d AS (SELECT doc_id, documents.source, text, cdf,
        (('0x' || substr(md5('17|1|' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM documents JOIN a ON documents.source IS NOT DISTINCT FROM a.source),
e AS (SELECT doc_id, source, text, unnest(range(1, 1 + len(list_filter(cdf, lambda x: x < u)))) AS mix_copy FROM d)
SELECT doc_id, source, mix_copy::BIGINT AS mix_copy,
  ('0x' || substr(md5('17-order|' || doc_id || '|' || mix_copy), 1, 15))::BIGINT AS mix_order, text
FROM e""",
}
