"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large(links: DataFrame) -> DataFrame:
    """Every node tells its larger neighbours the smallest node it knows."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    told = both.join(least, both["u"] == least["c"]).filter("v > u").select(F.col("m").alias("u"), "v")
    return told.distinct()


def _small(links: DataFrame) -> DataFrame:
    """Every node ties its smaller neighbours and itself to the smallest of them."""
    least = links.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("c"), "m")
    told = links.join(least, links["v"] == least["c"])
    tied = told.filter("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return tied.union(least.select(F.col("m").alias("u"), F.col("c").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """`node, root` for every node of the links `u < v`; root is the smallest node of its component.

    Rounds of large and small stars end when a round changes nothing; their number grows with the logarithm
    of the nodes. Each round is a stored table; the driver sees a count and a checksum of it.
    """
    at, seen = links.select("u", "v"), None
    while True:
        at = stored(_small(stored(_large(at), "stars-large")), "stars-small")
        now = at.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.lit(0))).first()
        if now == seen:
            break
        seen = now
    roots = at.select("u").distinct()
    return stored(at.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots.select(F.col("u").alias("node"), F.col("u").alias("root"))), "components")
