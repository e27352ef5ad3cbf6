"""Range text `name.chr(strand):start-end` and arithmetic on ranges (1-based, closed)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grammar of ranges and the largest position.
PATTERN = r"(?:(\w+)\.)?([\w/-]+)(?:\(([+-])\))?:(\d+)(?:[_-](\d+))?"
POS_INF = 2147483646


def parse(text: Column) -> Column:
    """struct(name, chr, strand, s, e, valid); an end that is missing or 0 is the start."""
    part = lambda i: F.regexp_extract(text, PATTERN, i)
    s, e = part(4).try_cast("int"), part(5).try_cast("int")
    e = F.when(F.coalesce(e, F.lit(0)) == 0, s).otherwise(e)
    plain = F.regexp_extract(text, r"^([^\s:(]+)", 1)
    ok = s.isNotNull() & e.isNotNull() & (s >= 1) & (s <= e) & (e <= POS_INF)
    chrom = F.when(part(2) == "", plain).otherwise(part(2))
    return F.struct(part(1).alias("name"), chrom.alias("chr"), part(3).alias("strand"), s.alias("s"), e.alias("e"), F.coalesce(ok, F.lit(False)).alias("valid"))


def render(chrom: Column, strand: Column, s: Column, e: Column, name: Column | None = None) -> Column:
    head = chrom if name is None else F.concat(F.when(name != "", F.concat(name, F.lit("."))).otherwise(F.lit("")), chrom)
    strand = F.when(F.coalesce(strand, F.lit("")) != "", F.concat(F.lit("("), strand, F.lit(")"))).otherwise(F.lit(""))
    place = F.when(s == e, s.cast("string")).otherwise(F.concat_ws("-", s.cast("string"), e.cast("string")))
    return F.when(s.isNull() | (s < 1), head).otherwise(F.concat(head, strand, F.lit(":"), place))


def span(s: Column, e: Column, strand: Column, op: str, mode: str = "both", n: int = 0) -> tuple[Column, Column]:
    """trim, pad, shift, flank or excise; modes 5p, 3p, both are read along the strand; (null, null) is empty.

    shift and flank need a mode of 5p or 3p; excise empties ranges shorter than n. Results stay
    between 1 and POS_INF - 1.
    """
    minus = strand == "-"
    if op == "excise":
        keep = e - s + 1 >= n
        return F.when(keep, s), F.when(keep, e)
    if op in ("shift", "flank") and mode == "both":
        raise ValueError(f"{op} needs a mode of 5p or 3p")
    five = mode == "5p"
    if op in ("trim", "pad"):
        k = -n if op == "pad" else n
        move_s = F.lit(True) if mode == "both" else (~minus if five else minus)
        move_e = F.lit(True) if mode == "both" else (minus if five else ~minus)
        a, b = F.when(move_s, s + k).otherwise(s), F.when(move_e, e - k).otherwise(e)
    elif op == "shift":  # towards the 5' or the 3' end
        down = minus if not five else ~minus
        k = F.when(down, F.lit(-n)).otherwise(F.lit(n))
        a, b = s + k, e + k
    elif n == 0:
        return F.lit(None).cast("int"), F.lit(None).cast("int")
    else:  # flank: outside for n > 0, inside for n < 0
        low = ~minus if five else minus
        a = F.when(low, s - n if n > 0 else s).otherwise(e + 1 if n > 0 else e + n + 1)
        b = F.when(low, s - 1 if n > 0 else s - n - 1).otherwise(e + n if n > 0 else e)
    ok = a <= b
    limit = lambda x: F.least(F.greatest(x, F.lit(1)), F.lit(POS_INF - 1))
    return F.when(ok, limit(a)), F.when(ok, limit(b))
