"""Connected components of a links table by alternating stars; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tasks_for

#: Rounds before an error; each at least halves the longest way to a smallest id in practice.
ROUNDS = 200


def _stars(links: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    ends = links.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the smallest id reachable from each id in ``links`` (columns a, b); ids only, no nulls.

    Each round joins every id's larger neighbours to its smallest one, then its smaller ones,
    until the links are stars. Ids without links do not appear.
    """
    now = scratch.keep(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    with tasks_for(scratch.spark, scratch.rows["cc"]):
        for _ in range(ROUNDS):
            if _stars(now):
                break
            both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u")
            new = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
            now = scratch.keep(new, "cc")
        else:
            raise RuntimeError(f"links are no stars after {ROUNDS} rounds")
        return scratch.keep(now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v")).distinct(), "stars")
