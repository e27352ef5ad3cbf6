"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` arcs of a ring of hashes. A row's key is its text, so equal texts
stand at one point of the ring. A shard takes rows up to its bound; what overflows an arc goes
clockwise to the next shard that has room. Only counts for each arc and cell (bounded: arcs x
cells) reach the driver; rows are numbered in cells that no hot text can fill alone.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, salted_rank

VNODES, CELLS, SALTS = 64, 4, 16


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(end of the arc, its shard), ascending: virtual node v of shard s stands at a mixed 31-bit hash."""
    from hashlib import blake2b

    points = {}
    for s in range(shards):
        for v in range(vnodes):
            points.setdefault(int.from_bytes(blake2b(f"{s}/{v}".encode(), digest_size=4).digest(), "big") >> 1, s)
    return sorted(points.items())


def fill(arcs: list[tuple[int, int]], cells: dict[tuple[int, int], int], bounds: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """Ranges (arc, cell, from, to, shard, first slot): every row of a cell in rank order, no shard over its bound.

    First each shard takes what its own arcs hold, in ring order; then the overflow of each arc
    goes on clockwise, arc by arc.
    """
    room, slot, out, over = list(bounds), [0] * len(bounds), [], []

    def take(arc: int, cell: int, at: int, n: int, shard: int) -> int:
        got = min(n, room[shard])
        if got:
            out.append((arc, cell, at, at + got, shard, slot[shard]))
            room[shard] -= got
            slot[shard] += got
        return got

    for (arc, cell), n in sorted(cells.items()):
        got = take(arc, cell, 0, n, arcs[arc][1])
        if got < n:
            over.append((arc, cell, got, n))
    for arc, cell, at, n in over:
        step = arc
        while at < n:
            step = (step + 1) % len(arcs)
            at += take(arc, cell, at, n - at, arcs[step][1])
    return out


def assign_shards(df: DataFrame, shards: int = 16, slack: float = 0.0, key: str = "text", order: tuple[str, ...] = ("doc_id",), vnodes: int = VNODES) -> DataFrame:
    """Adds ``shard`` and ``slot`` (gapless from 0 in each shard) to the columns of ``df``.

    slack 0: bounds add up to the row count, so counts are at most one apart; slack e: a shard
    holds at most (1 + e) times its share. A null key counts as empty. An empty table gives an
    empty result; repeated rows get a slot each, and rows of one key and order get their slots in
    any order. Columns named shard or slot give way.
    """
    df = df.drop("shard", "slot")
    spark, arcs = df.sparkSession, ring(shards, vnodes)
    ends = F.array(*[F.lit(e) for e, _ in arcs])
    h = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")))
    point = F.shiftrightunsigned(h, 33)
    # the arcs stand in 4,096 buckets of the ring, each with the count of ends below it: a short search
    below = F.array(*[F.lit(bisect_left(arcs, (b << 19, -1))) for b in range(4096)])
    first = F.element_at(below, (F.shiftright(point, 19) + 1).cast("int"))
    inside = max(1, *[bisect_left(arcs, ((b + 1) << 19, -1)) - bisect_left(arcs, (b << 19, -1)) for b in range(4096)])
    past = sum((F.coalesce((F.get(ends, first + i) < point).cast("int"), F.lit(0)) for i in range(inside)), F.lit(0))
    rows = df.withColumn("_point", point).withColumn("_arc", ((first + past) % len(arcs)).cast("int"))
    salt = F.pmod(F.shiftright(h, 5), F.lit(CELLS)) * SALTS + F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(SALTS))
    ranked = salted_rank(rows, ["_arc"], salt, [F.col("_point"), *[F.col(c) for c in order]])
    scratch = Scratch(spark)
    ranked = scratch.keep(ranked, "ranked")
    cells = {(r[0], r[1]): r[2] for r in ranked.groupBy("_arc", "salt").count().collect()}  # at most arcs x cells rows
    n = sum(cells.values())
    bounds = [n // shards + (s < n % shards) for s in range(shards)]
    if slack:
        bounds = [int((1 + slack) * n / shards) + 1] * shards
    plan = spark.createDataFrame(fill(arcs, cells, bounds), "arc int, cell int, lo int, hi int, shard int, slot0 long")
    held = (ranked._arc == plan.arc) & (ranked.salt == plan.cell) & (ranked.rank_in >= plan.lo) & (ranked.rank_in < plan.hi)
    out = ranked.join(F.broadcast(plan), held).withColumn("slot", F.col("slot0") + F.col("rank_in") - F.col("lo"))
    return out.select(*df.columns, "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 16, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document (null text: empty).

    Ties of doc_id are ordered by the text's checksum; rows equal in both may swap slots.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"))
    out = assign_shards(narrow, shards, slack, key="_key", order=("doc_id", "text_crc32"))
    law = "bytes" if slack else "rows"
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
