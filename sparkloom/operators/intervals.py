"""Interval algebra on closed integer intervals: columns s and e within key columns.

Long keys (chromosomes) are cut in tiles: work that needs an order runs within a tile first, and
only its summaries, far fewer rows, meet in one order over the whole key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a tile and in a bin of range joins.
TILE, BIN = 1 << 20, 1 << 12


def _islands_once(df: DataFrame, keys: list[str], gap: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", (before.isNull() | (F.col("s") > before + gap)).cast("int"))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def islands(df: DataFrame, keys: list[str], gap: int = 1, tile: int = TILE) -> DataFrame:
    """Union of intervals; runs at most ``gap`` apart join (1: touching runs, n + 1: holes up to n are filled)."""
    usable = df.select(*keys, "s", "e").filter("s <= e")
    tiled = usable.withColumn("_tile", F.floor(F.col("s") / tile))
    return _islands_once(_islands_once(tiled, [*keys, "_tile"], gap).select(*keys, "s", "e"), keys, gap)


def events(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, step): depth changes, summed by position before any order is made."""
    both = df.filter("s <= e").select(*keys, F.explode(F.array(F.struct(F.col("s").alias("pos"), F.lit(1).alias("step")), F.struct((F.col("e") + 1).alias("pos"), F.lit(-1).alias("step")))).alias("x"))
    return both.groupBy(*keys, "x.pos").agg(F.sum("x.step").cast("long").alias("step"))


def running(ev: DataFrame, keys: list[str], sums: dict[str, str], tile: int = TILE) -> DataFrame:
    """Running sums of columns in the order of pos, and the next pos (nxt): tile by tile, then over tiles."""
    tiled = ev.withColumn("_tile", F.floor(F.col("pos") / tile))
    inner = Window.partitionBy(*keys, "_tile").orderBy("pos")
    rows = tiled.withColumns({f"_r_{c}": F.sum(c).over(inner) for c in sums} | {"_n": F.lead("pos").over(inner)})
    outer = Window.partitionBy(*keys).orderBy("_tile")
    totals = tiled.groupBy(*keys, "_tile").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums], F.min("pos").alias("_first"))
    past = outer.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_tile", *[F.coalesce(F.sum(f"_t_{c}").over(past), F.lit(0)).alias(f"_b_{c}") for c in sums], F.lead("_first").over(outer).alias("_after"))
    out = rows.join(totals, [*keys, "_tile"])
    return out.select(*keys, "pos", F.coalesce("_n", "_after").alias("nxt"), *[(F.col(f"_r_{c}") + F.col(f"_b_{c}")).alias(name) for c, name in sums.items()])


def depth_segments(df: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """(keys, s, e, depth): maximal runs between depth changes, depth above 0; multiplicity counts."""
    run = running(events(df, keys).filter("step <> 0"), keys, {"step": "depth"}, tile)
    return run.filter("depth > 0").select(*keys, F.col("pos").alias("s"), (F.col("nxt") - 1).alias("e"), "depth")


def coverage(df: DataFrame, keys: list[str], minimum: int = 1, detailed: bool = False) -> DataFrame:
    """Regions of at least ``minimum`` depth as islands; ``detailed``: islands for each exact depth."""
    seg = depth_segments(df, keys)
    if detailed:
        return islands(seg, [*keys, "depth"])
    return islands(seg.filter(F.col("depth") >= max(1, minimum)), keys)


def with_bins(df: DataFrame, s: str, e: str, size: int = BIN) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / size), F.floor(F.col(e) / size))))


def range_join(left: DataFrame, right: DataFrame, key: str, size: int = BIN) -> DataFrame:
    """Pairs of overlapping closed intervals: an equi join on key and bin; each pair in its first common bin.

    ``left`` has s, e; ``right`` has the key, s2, e2; other column names are distinct.
    """
    a = with_bins(left, "s", "e", size)
    b = with_bins(right.withColumnRenamed(key, "_key"), "s2", "e2", size).withColumnRenamed("_bin", "_bin2")
    first = F.floor(F.greatest("s", "s2") / size)
    on = (a[key] == b["_key"]) & (a["_bin"] == b["_bin2"]) & (F.col("s") <= F.col("e2")) & (F.col("s2") <= F.col("e")) & (F.col("_bin") == first)
    return a.join(b, on).drop("_key", "_bin", "_bin2")


def _right(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.col("s").alias("s2"), F.col("e").alias("e2"))


def overlap_count(targets: DataFrame, ranges: DataFrame, key: str, row: list[str]) -> DataFrame:
    """targets with n: how many ranges overlap each (touching by one position counts, repeats count).

    No pairs are made: with t ranges of the key in all, n = (ranges that start by e) - (ranges
    that end before s), and both come from running sums over positions.
    """
    starts = ranges.groupBy(key, F.col("s").alias("pos")).agg(F.count("*").alias("a")).select(key, "pos", "a", F.lit(0).cast("long").alias("b"), F.lit(0).alias("kind"))
    ends = ranges.groupBy(key, (F.col("e") + 1).alias("pos")).agg(F.count("*").alias("b")).select(key, "pos", F.lit(0).cast("long").alias("a"), "b", F.lit(0).alias("kind"))
    asks = targets.select(key, F.col("e").alias("pos")).union(targets.select(key, F.col("s").alias("pos"))).distinct().select(key, "pos", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(1).alias("kind"))
    ev = starts.union(ends).union(asks).groupBy(key, "pos").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("kind").alias("kind"))
    at = running(ev, [key], {"a": "begun", "b": "ended"})
    out = targets.join(at.select(F.col(key), F.col("pos").alias("e"), F.col("begun")), [key, "e"], "left").join(at.select(F.col(key), F.col("pos").alias("s"), F.col("ended")), [key, "s"], "left")
    return out.select(*row, key, "s", "e", F.coalesce(F.col("begun") - F.col("ended"), F.lit(0)).cast("long").alias("n"))


def covered(targets: DataFrame, spans: DataFrame, key: str, row: list[str]) -> DataFrame:
    """targets with size: positions of each in ``spans`` (disjoint), by range join and partial sums."""
    both = range_join(targets, _right(spans, key), key)
    part = F.least("e", "e2") - F.greatest("s", "s2") + 1
    sums = both.groupBy(*row).agg(F.sum(part).alias("_size"))
    return targets.join(sums, row, "left").withColumn("size", F.coalesce("_size", F.lit(0)).cast("long")).drop("_size")


def proportion(targets: DataFrame, spans: DataFrame, key: str, row: list[str]) -> DataFrame:
    """covered() with length and prop to four places."""
    out = covered(targets, spans, key, row).withColumn("length", (F.col("e") - F.col("s") + 1).cast("long"))
    return out.withColumn("prop", F.round(F.col("size") / F.col("length"), 4))


def select_by_spans(targets: DataFrame, spans: DataFrame, key: str, row: list[str], op: str = "overlap") -> DataFrame:
    """Keep targets by ``overlap``, ``non-overlap`` or ``superset`` (the spans contain the target)."""
    if op == "superset":
        return covered(targets, spans, key, row).filter("size = e - s + 1").drop("size")
    hit = range_join(targets, _right(spans, key), key).select(*row).distinct()
    return targets.join(hit, row, "leftsemi" if op == "overlap" else "leftanti")


def algebra(sets: DataFrame, keys: list[str], which: str, op: str, count: int | None = None) -> DataFrame:
    """Fold of sets of disjoint spans: union, intersect, xor, or diff (of set 0, all others).

    ``which`` numbers the sets from 0. One sweep over summed events serves every op.
    """
    tagged = sets.select(*keys, "s", "e", (F.col(which) == 0).cast("long").alias("_first"))
    ev = tagged.select(*keys, "_first", F.explode(F.array(F.struct(F.col("s").alias("pos"), F.lit(1).cast("long").alias("d")), F.struct((F.col("e") + 1).alias("pos"), F.lit(-1).cast("long").alias("d")))).alias("x"))
    ev = ev.groupBy(*keys, "x.pos").agg(F.sum("x.d").alias("d"), F.sum(F.col("x.d") * F.col("_first")).alias("d0"))
    run = running(ev, keys, {"d": "depth", "d0": "first"})
    keep = {"union": "depth > 0", "intersect": f"depth = {count}", "xor": "depth % 2 = 1", "diff": "first > 0 AND depth = first"}[op]
    return islands(run.filter(keep).select(*keys, F.col("pos").alias("s"), (F.col("nxt") - 1).alias("e")), keys)


def holes(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps between the spans of a key."""
    w = Window.partitionBy(*keys).orderBy("s")
    return islands(spans, keys).withColumn("_n", F.lead("s").over(w)).filter("_n IS NOT NULL").select(*keys, (F.col("e") + 1).alias("s"), (F.col("_n") - 1).alias("e"))


def complement(spans: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """What is left of 1..len of each key in ``sizes`` (key, len)."""
    whole = sizes.select(key, F.lit(1).cast("long").alias("s"), F.col("len").alias("e"), F.lit(0).alias("_set"))
    return algebra(whole.union(islands(spans, [key]).select(key, "s", "e", F.lit(1))), [key], "_set", "diff")


def span(spans: DataFrame, keys: list[str], op: str = "cover", n: int = 0) -> DataFrame:
    """cover, holes, trim, pad, excise (spans shorter than n go) or fill (holes up to n are filled)."""
    base = islands(spans, keys)
    if op == "cover":
        return base.groupBy(*keys).agg(F.min("s").alias("s"), F.max("e").alias("e"))
    if op == "holes":
        return holes(base, keys)
    if op == "excise":
        return base.filter(F.col("e") - F.col("s") + 1 >= n)
    if op == "fill":
        return islands(base, keys, gap=n + 1)
    n = -n if op == "pad" else n
    moved = base.select(*keys, (F.col("s") + n).alias("s"), (F.col("e") - n).alias("e")).filter("s <= e")
    return islands(moved, keys) if n < 0 else moved


def stat(spans: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """(key, length, size, coverage) and a row ``all``."""
    by = sizes.select(key, F.col("len").alias("length")).join(spans.groupBy(key).agg(F.sum(F.col("e") - F.col("s") + 1).alias("size")), key)
    rolled = by.rollup(key).agg(F.sum("length").cast("long").alias("length"), F.sum("size").cast("long").alias("size"))
    return rolled.select(F.coalesce(key, F.lit("all")).alias(key), "length", "size", F.round(F.col("size") / F.col("length"), 4).alias("coverage"))


def statop(one: DataFrame, two: DataFrame, sizes: DataFrame, key: str, op: str = "intersect") -> DataFrame:
    """Sizes of set one, set two and one op two for each key of one, with c1, c2, ratio, and a row ``all``."""
    size = lambda df, name: df.groupBy(key).agg(F.sum(F.col("e") - F.col("s") + 1).alias(name))
    both = one.select(key, "s", "e", F.lit(0).alias("_set")).union(two.select(key, "s", "e", F.lit(1)))
    rows = sizes.join(size(one, "size1"), key).join(size(two, "size2"), key, "left").join(size(algebra(both, [key], "_set", op, 2), "op_size"), key, "left").na.fill(0, ["size2", "op_size"])
    rolled = rows.rollup(key).agg(*[F.sum(c).cast("long").alias(c) for c in ("len", "size1", "size2", "op_size")])
    c1 = F.col("size1") / F.col("len")
    c2 = F.when(F.col("size2") == 0, F.lit(0.0)).otherwise(F.col("op_size") / F.col("size2"))
    out = rolled.select(F.coalesce(key, F.lit("all")).alias(key), F.col("len").alias("length"), "size1", "size2", "op_size", c1.alias("c1"), c2.alias("c2"))
    ratio = F.when(F.col("c1") < 1e-5, F.lit(0.0)).otherwise(F.col("c2") / F.col("c1"))
    return out.select(key, "length", "size1", "size2", "op_size", F.round("c1", 4).alias("c1"), F.round("c2", 4).alias("c2"), F.round(ratio, 4).alias("ratio"))


def longest(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The first longest span of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.col("e") - F.col("s")), "s")
    return spans.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def reciprocal_pairs(df: DataFrame, key: str, row: str, share: float = 0.95) -> DataFrame:
    """(a, b) of intervals that overlap by at least ``share`` of each; ratios compare as 32-bit floats."""
    a = df.select(F.col(key), F.col("s"), F.col("e"), F.col(row).alias("a"))
    b = df.select(F.col(key), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col(row).alias("b"))
    both = range_join(a, b, key).filter("a < b")
    size = F.least("e", "e2") - F.greatest("s", "s2") + 1
    least = F.lit(share).cast("float")
    ratio = lambda s, e: size.cast("float") / (F.col(e) - F.col(s) + 1).cast("float")
    return both.filter((ratio("s", "e").cast("float") >= least) & (ratio("s2", "e2").cast("float") >= least)).select("a", "b")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def bounded(lo: Column, hi: Column, x: Column) -> Column:
    return F.least(F.greatest(x, lo), hi)
