"""Pairwise alignments in PSL and PAF form: flat columns, 0-based half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import depth_segments, range_join

# The PSL columns.
PSL = "match mismatch rep n q_num_insert q_base_insert t_num_insert t_base_insert strand q_name q_size q_start q_end t_name t_size t_start t_end block_count block_sizes q_starts t_starts".split()


def psl_score(protein: bool = False) -> Column:
    m = 3 if protein else 1
    return m * (F.col("match") + F.floor(F.col("rep") / 2)) - m * F.col("mismatch") - F.col("q_num_insert") - F.col("t_num_insert")


def _ident(with_n: bool) -> Column:
    """Share of equal bases among aligned ones; N counts as aligned where ``with_n``."""
    n = F.col("n") if with_n else F.lit(0)
    aligned = F.col("match") + F.col("mismatch") + F.col("rep") + n
    return F.when(aligned == 0, F.lit(0.0)).otherwise((F.col("match") + F.col("rep")) / aligned)


def _cover(with_n: bool, size: str) -> Column:
    n = F.col("n") if with_n else F.lit(0)
    return F.when(F.col(size) == 0, F.lit(0.0)).otherwise((F.col("match") + F.col("mismatch") + F.col("rep") + n) / F.col(size))


def psl_rates(df: DataFrame) -> DataFrame:
    """Adds ident, q_cover, t_cover and rep_match of each alignment (N counted)."""
    matched = F.col("match") + F.col("rep")
    return df.withColumns({"ident": _ident(True), "q_cover": _cover(True, "q_size"), "t_cover": _cover(True, "t_size"), "rep_match": F.when(matched == 0, F.lit(0.0)).otherwise(F.col("rep") / matched)})


_RATES = ("ident", "q_cover", "t_cover", "rep_match")


def psl_query_stats(df: DataFrame) -> DataFrame:
    """Per query: alignments, minimum, maximum and mean of the rates."""
    rates = psl_rates(df)
    aggs = [f(c).alias(f"{c}_{n}") for c in _RATES for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    out = rates.groupBy("q_name").agg(F.count("*").alias("aligns"), F.sum("q_size").cast("long").alias("total_q_size"), *aggs)
    return out.select("q_name", "aligns", "total_q_size", *[F.round(f"{c}_{n}", 4).alias(f"{c}_{n}") for c in _RATES for n in ("min", "max", "mean")])


def psl_overall_stats(df: DataFrame) -> DataFrame:
    """One row over all queries, from sums for each query: queries, alignments, queries aligned once and more often."""
    rates = psl_rates(df)
    by = rates.groupBy("q_name").agg(F.count("*").alias("k"), *[f(c).alias(f"{c}_{n}") for c in _RATES for n, f in (("min", F.min), ("max", F.max), ("sum", F.sum))])
    out = by.agg(F.count("*").alias("queries"), F.sum("k").cast("long").alias("aligns"), F.sum((F.col("k") == 1).cast("long")).alias("aligned1"), F.sum((F.col("k") > 1).cast("long")).alias("aligned_n"), *[g(f"{c}_{n}").alias(f"{c}_{n}") for c in _RATES for n, g in (("min", F.min), ("max", F.max), ("sum", F.sum))])
    return out.select("queries", "aligns", "aligned1", "aligned_n", *[F.round(x, 4).alias(n) for c in _RATES for x, n in ((F.col(f"{c}_min"), f"{c}_min"), (F.col(f"{c}_max"), f"{c}_max"), (F.col(f"{c}_sum") / F.col("aligns"), f"{c}_mean"))])


def psl_spread(df: DataFrame, multi_only: bool = False, non_zero: bool = False) -> DataFrame:
    """Per query: aligns, cover_spread and ident_spread (largest minus smallest, N not counted)."""
    both = df.withColumns({"_c": _cover(False, "q_size"), "_i": _ident(False)})
    out = both.groupBy("q_name").agg(F.count("*").alias("aligns"), F.round(F.max("_c") - F.min("_c"), 4).alias("cover_spread"), F.round(F.max("_i") - F.min("_i"), 4).alias("ident_spread"))
    if multi_only:
        out = out.filter("aligns > 1")
    return out.filter("cover_spread <> 0 OR ident_spread <> 0") if non_zero else out


def _back(sizes: str, starts: str, total: str) -> Column:
    """Block starts on the other strand, in its order."""
    return F.reverse(F.transform(F.arrays_zip(F.col(starts).alias("a"), F.col(sizes).alias("b")), lambda x: F.col(total) - (x["a"] + x["b"])))


def psl_rc(df: DataFrame) -> DataFrame:
    """Reverse complement of each record, with both strands written."""
    flip = lambda c: F.when(c == "-", "+").otherwise("-")
    q, t = F.substring("strand", 1, 1), F.when(F.length("strand") > 1, F.substring("strand", 2, 1)).otherwise("+")
    return df.withColumns({"strand": F.concat(flip(q), flip(t)), "q_starts": _back("block_sizes", "q_starts", "q_size"), "t_starts": _back("block_sizes", "t_starts", "t_size"), "block_sizes": F.reverse("block_sizes")})


def psl_swap(df: DataFrame, no_rc: bool = False) -> DataFrame:
    """Query and target exchanged; a one-character strand - turns the blocks unless ``no_rc``."""
    pairs = [("q_num_insert", "t_num_insert"), ("q_base_insert", "t_base_insert"), ("q_name", "t_name"), ("q_size", "t_size"), ("q_start", "t_start"), ("q_end", "t_end"), ("q_starts", "t_starts")]
    swapped = {a: F.col(b) for x in pairs for a, b in (x, x[::-1])}
    two = F.length("strand") > 1
    turn = (~two) & (F.col("strand") == "-") & F.lit(not no_rc)
    strand = F.when(two, F.concat(F.substring("strand", 2, 1), F.substring("strand", 1, 1))).otherwise(F.concat(F.lit("+"), F.col("strand")) if no_rc else F.col("strand"))
    out = df.withColumns(swapped | {"strand": strand, "_turn": turn})
    cols = {"q_starts": F.when(F.col("_turn"), _back("block_sizes", "q_starts", "q_size")).otherwise(F.col("q_starts")), "t_starts": F.when(F.col("_turn"), _back("block_sizes", "t_starts", "t_size")).otherwise(F.col("t_starts")), "block_sizes": F.when(F.col("_turn"), F.reverse("block_sizes")).otherwise(F.col("block_sizes"))}
    return out.withColumns(cols).drop("_turn")


def psl_blocks(df: DataFrame, target: bool = False) -> DataFrame:
    """chr, s, e (1-based) of each block on the + strand of the query or target."""
    side = "t" if target else "q"
    strand = F.when(F.length("strand") > 1, F.substring("strand", 2, 1)).otherwise("+") if target else F.substring("strand", 1, 1)
    rows = df.select(F.col(f"{side}_name").alias("chr"), F.col(f"{side}_size").alias("_n"), strand.alias("strand"), F.explode(F.arrays_zip(F.col(f"{side}_starts").alias("a"), F.col("block_sizes").alias("b"))).alias("x"))
    minus = F.col("strand") == "-"
    s = F.when(minus, F.col("_n") - (F.col("x.a") + F.col("x.b"))).otherwise(F.col("x.a"))
    return rows.select("chr", "strand", (s + 1).cast("long").alias("s"), (s + F.col("x.b")).cast("long").alias("e"))


def psl_to_paf(df: DataFrame) -> DataFrame:
    block = F.aggregate("block_sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select("q_name", F.col("q_size").alias("q_len"), "q_start", "q_end", F.substring("strand", 1, 1).alias("strand"), "t_name", F.col("t_size").alias("t_len"), "t_start", "t_end", (F.col("match") + F.col("rep")).alias("matches"), block.alias("block_len"), F.lit(255).alias("mapq"))


def psl_to_chain(df: DataFrame) -> DataFrame:
    """One chain for each record: header and blocks (size, dt, dq)."""
    n = F.size("block_sizes")
    step = lambda c, i: F.when(i < n - 1, F.element_at(c, (i + 2).cast("int")) - F.element_at(c, (i + 1).cast("int")) - F.element_at("block_sizes", (i + 1).cast("int"))).otherwise(0)
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.element_at("block_sizes", (i + 1).cast("int")).alias("size"), step("t_starts", i).alias("dt"), step("q_starts", i).alias("dq")))
    return df.select(psl_score().alias("score"), "t_name", "t_size", "t_start", "t_end", "q_name", "q_size", F.substring("strand", 1, 1).alias("q_strand"), "q_start", "q_end", blocks.alias("blocks"))


def psl_lift(df: DataFrame, sizes: DataFrame, side: str = "q") -> DataFrame:
    """Names `chr:s-e` of fragments become places on chr (sizes: name, len); rows without a size, or beyond it, stay."""
    name = F.col(f"{side}_name")
    pattern = r"^(.+?)(?:\([+-]\))?:(\d+)-(\d+)$"
    chrom, off = F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2).try_cast("int") - 1
    out = df.withColumns({"_c": chrom, "_o": off}).join(sizes.select(F.col("name").alias("_c"), F.col("len").alias("_len")), "_c", "left")
    ok = F.col("_len").isNotNull() & F.col("_o").isNotNull() & (F.col(f"{side}_end") + F.col("_o") <= F.col("_len"))
    strand = F.substring("strand", 1, 1) if side == "q" else F.when(F.length("strand") > 1, F.substring("strand", 2, 1)).otherwise("+")
    shift = F.when(strand == "-", F.col("_len") - F.col("_o") - F.col(f"{side}_size")).otherwise(F.col("_o"))
    out = out.withColumn("_shift", shift)
    moved = {f"{side}_starts": F.transform(f"{side}_starts", lambda x: x + F.col("_shift")), f"{side}_start": F.col(f"{side}_start") + F.col("_o"), f"{side}_end": F.col(f"{side}_end") + F.col("_o"), f"{side}_size": F.col("_len"), f"{side}_name": F.col("_c")}
    return out.withColumns({c: F.when(ok, v).otherwise(F.col(c)) for c, v in moved.items()}).drop("_c", "_o", "_len", "_shift")


def cigar_sum(cigar: Column, ops: str) -> Column:
    """Sum of the lengths of the given operations."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(f"(\\d+)[{ops}]"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def cigar_count(cigar: Column, ops: str) -> Column:
    return F.size(F.regexp_extract_all(cigar, F.lit(f"(\\d+)[{ops}]"), F.lit(1)))


def paf_identity(df: DataFrame) -> DataFrame:
    """Adds gi and bi (six places): matches over matches, mismatches and gap events or gap bases; M counts as match."""
    c = F.col("cg")
    m, x, bases, gaps = cigar_sum(c, "M="), cigar_sum(c, "X"), cigar_sum(c, "ID"), cigar_count(c, "ID")
    return df.withColumns({"gi": F.round(m / (m + x + gaps), 6), "bi": F.round(m / (m + x + bases), 6)})


def paf_validate(df: DataFrame) -> DataFrame:
    """total, query_invalid, target_invalid, missing, malformed: declared ends against the CIGAR."""
    cg = F.col("cg")
    missing = cg.isNull() | (cg == "")
    bad = ~missing & ~cg.rlike(r"^(\d+[MIDX=])+$")
    fine = ~missing & ~bad
    q, t = F.col("q_start") + cigar_sum(cg, "MX=I"), F.col("t_start") + cigar_sum(cg, "MX=D")
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return df.agg(F.count("*").alias("total"), one(fine & (q != F.col("q_end"))).alias("query_invalid"), one(fine & (t != F.col("t_end"))).alias("target_invalid"), one(missing).alias("missing"), one(bad).alias("malformed"))


def paf_spans(df: DataFrame) -> DataFrame:
    """t_name, s, e (0-based, closed): the target stretches under M, =, X and D; the whole where there is no CIGAR."""
    ops = F.transform(F.regexp_extract_all("cg", F.lit(r"(\d+[MIDX=])"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, r"\d+", 0).cast("long").alias("n"), F.right(x, F.lit(1)).alias("op")))
    reach = F.aggregate(ops, F.lit(0).cast("long"), lambda a, x: a + F.when(x["op"] == "I", 0).otherwise(x["n"]))
    end = F.when(F.col("cg").isNull() | (F.col("cg") == ""), F.col("t_end")).otherwise(F.col("t_start") + reach)
    return df.select("t_name", F.col("t_start").cast("long").alias("s"), (end - 1).cast("long").alias("e"))


def paf_coverage(df: DataFrame, minimum: int = 1) -> DataFrame:
    """t_name, s, e, depth: segments of each depth from ``minimum`` on, 0-based half-open."""
    seg = depth_segments(paf_spans(df), ["t_name"]).filter(F.col("depth") >= minimum)
    return seg.select("t_name", "s", (F.col("e") + 1).alias("e"), "depth")


def cigar_ops(cigar: Column) -> Column:
    """Array of (n, op) of a CIGAR; empty where it is missing or malformed."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDX=])"), F.lit(1))
    ops = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"\d+", 0).cast("long").alias("n"), F.right(x, F.lit(1)).alias("op")))
    return F.when(cigar.rlike(r"^(\d+[MIDX=])+$"), ops).otherwise(F.array().cast("array<struct<n:bigint,op:string>>"))


def projected(ops: Column, t_start: Column, s: Column, e: Column) -> Column:
    """What a target stretch [s, e) covers of an alignment: lo and hi from the start of its query part, t_from and t_to.

    One fold over the operations: matched columns within the stretch and insertions at a place in it
    count for the query, matched and deleted columns for the target. lo is above hi if nothing does.
    """
    none = F.lit(1 << 60).cast("long")

    def step(a: Column, x: Column) -> Column:
        td, qd = F.when(x["op"] == "I", 0).otherwise(x["n"]), F.when(x["op"] == "D", 0).otherwise(x["n"])
        lo, hi = F.greatest(s, a["ct"]), F.least(e, a["ct"] + td)
        over, inserted = lo < hi, (x["op"] == "I") & (a["ct"] >= s) & (a["ct"] < e)
        both = over & x["op"].isin("M", "=", "X")
        q_lo = F.when(inserted, a["cq"]).when(both, a["cq"] + lo - a["ct"])
        q_hi = F.when(inserted, a["cq"] + qd).when(both, a["cq"] + hi - a["ct"])
        return F.struct(
            (a["ct"] + td).alias("ct"), (a["cq"] + qd).alias("cq"), F.least(a["lo"], q_lo).alias("lo"), F.greatest(a["hi"], q_hi).alias("hi"),
            F.least(a["t_from"], F.when(over, lo)).alias("t_from"), F.greatest(a["t_to"], F.when(over, hi)).alias("t_to"),
        )

    first = F.struct(t_start.cast("long").alias("ct"), F.lit(0).cast("long").alias("cq"), none.alias("lo"), (-none).alias("hi"), none.alias("t_from"), (-none).alias("t_to"))
    return F.aggregate(ops, first, step)


def paf_query(df: DataFrame, regions: DataFrame, min_identity: float = 0.0, min_len: int = 0) -> DataFrame:
    """Records over regions (t_name, s, e; 0-based half-open), projected to the query through the CIGAR.

    The strand - reads the query from its end. A record without a CIGAR, or with a malformed one, has
    identity 0 and is projected along the diagonal. Identity is gap-compressed.
    """
    a = regions.select("t_name", F.col("s"), (F.col("e") - 1).alias("e"))
    b = df.select("t_name", F.col("t_start").alias("s2"), (F.col("t_end") - 1).alias("e2"), "q_name", "q_start", "q_end", "strand", "cg")
    if min_identity > 0:
        m, x, gaps = cigar_sum(F.col("cg"), "M="), cigar_sum(F.col("cg"), "X"), cigar_count(F.col("cg"), "ID")
        b = b.filter(F.col("cg").rlike(r"^(\d+[MIDX=])+$") & (m / (m + x + gaps) >= min_identity))
    both = range_join(a, b.withColumn("ops", cigar_ops(F.col("cg"))).drop("cg"), "t_name")
    e = F.col("e") + 1
    lo, hi = F.greatest("s", "s2"), F.least(e, F.col("e2") + 1)
    line = F.struct(F.col("e2").alias("ct"), F.col("e2").alias("cq"), (lo - F.col("s2")).alias("lo"), (hi - F.col("s2")).alias("hi"), lo.alias("t_from"), hi.alias("t_to"))
    out = both.withColumn("_p", F.when(F.size("ops") == 0, line).otherwise(projected(F.col("ops"), F.col("s2"), F.col("s"), e)))
    back = F.col("strand") == "-"
    q_from = F.when(back, F.col("q_end") - F.col("_p.hi")).otherwise(F.col("q_start") + F.col("_p.lo"))
    q_to = F.when(back, F.col("q_end") - F.col("_p.lo")).otherwise(F.col("q_start") + F.col("_p.hi"))
    out = out.filter("_p.lo < _p.hi AND _p.t_from < _p.t_to")
    out = out.select("t_name", F.col("_p.t_from").alias("t_from"), F.col("_p.t_to").alias("t_to"), "q_name", "strand", q_from.alias("q_from"), q_to.alias("q_to"))
    return out.filter(F.col("q_to") - F.col("q_from") >= max(1, min_len))
