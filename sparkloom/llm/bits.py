"""A set of ids as a bit table of a fixed size: it tells which rows surely are not in the set.

Rows that pass still go through a join. A fuller table lets more rows through, and that is all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 22


def _word(column: str):
    return F.shiftright(F.pmod(F.xxhash64(column), F.lit(BITS)), 6).cast("int").alias("_w")


def _bit(column: str):
    return F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), {BITS}L) % 64 as int))")


def bit_table(ids: DataFrame) -> DataFrame:
    """_w, _bits from the column ``id``: at most BITS / 64 rows."""
    return ids.select(_word("id"), _bit("id").alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_bits"))


def flag(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Adds _maybe: false where ``column`` is surely not in ``ids`` (column id)."""
    held = df.withColumn("_w", _word(column)).join(F.broadcast(bit_table(ids)), "_w", "left")
    return held.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(_bit(column)) != 0, F.lit(False))).drop("_w", "_bits")


def without(df: DataFrame, keys: list[str], gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``keys`` are not in ``gone``; only rows that may be are shuffled. Null keys stay."""
    held = flag(df, keys[0], gone.select(F.col(keys[0]).alias("id")).distinct())
    stay = held.filter("NOT _maybe").drop("_maybe")
    return stay.union(held.filter("_maybe").drop("_maybe").join(gone.select(*keys).distinct(), keys, "leftanti").select(*stay.columns))
