"""Sequence records: name, seq and what order they came in (pos)."""

from __future__ import annotations

from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seqs
from .intervals import islands


def base_counts(df: DataFrame) -> DataFrame:
    """name, len, A, C, G, T, N of each record and a row total; ambiguous codes count as N, other letters not at all."""
    both = lambda letters: seqs.count_of(F.col("seq"), letters + letters.lower())
    by = df.select("name", *[both(b).alias(b) for b in "ACGT"], both(seqs.AMBIGUOUS).alias("N"))
    by = by.withColumn("len", F.expr("A + C + G + T + N"))
    cols = ["len", "A", "C", "G", "T", "N"]
    total = by.agg(*[F.sum(c).cast("long").alias(c) for c in cols]).select(F.lit("total").alias("name"), *cols)
    return by.select("name", *cols).union(total)


def nx_stats(df: DataFrame, length: str, nx: int = 50) -> DataFrame:
    """N50 (Nx), S, A, E and C of lengths: one row.

    Lengths are summed by value first; the running sum is over distinct lengths, and Nx is the
    largest length whose sum from the longest on reaches floor(nx% of the total).
    """
    by = df.groupBy(F.col(length).cast("long").alias("n")).agg(F.count("*").alias("many"))
    totals = by.agg(F.sum(F.expr("n * many")).alias("sum"), F.sum("many").alias("count"), F.sum(F.expr("n * n * many")).alias("squares"))
    run = by.withColumn("cum", F.sum(F.expr("n * many")).over(Window.orderBy(F.desc("n"))))
    nth = run.crossJoin(F.broadcast(totals)).filter(F.col("cum") >= F.floor(F.col("sum") * nx / 100)).agg(F.max("n").alias("nx"))
    return nth.crossJoin(totals).select("nx", F.col("sum").cast("long").alias("sum"), F.round(F.col("sum") / F.col("count"), 2).alias("average"), F.round(F.col("squares") / F.col("sum"), 2).alias("esize"), F.col("count").cast("long").alias("count"))


def first_by(df: DataFrame, key: list[str], order: str = "pos") -> DataFrame:
    """The first record of each key; min_by keeps partial sums, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*[c if c in key else f"_r.{c}" for c in df.columns])


def dedup(df: DataFrame, by: str = "name", both_strands: bool = False, ignore_case: bool = False) -> DataFrame:
    """First record for each name, description or sequence (of both strands)."""
    key = F.col(by)
    if both_strands:
        up = seqs.upper(F.col("seq"))
        key = F.least(up, seqs.revcomp(up))
    elif ignore_case:
        key = seqs.upper(key)
    return first_by(df.withColumn("_k", key), ["_k"]).drop("_k")


def filter_records(df: DataFrame, min_len: int = 0, max_len: int | None = None, max_n: int | None = None, uniq: bool = False) -> DataFrame:
    n = seqs.count_of(seqs.upper(F.col("seq")), seqs.AMBIGUOUS)
    out = df.filter(F.length("seq") >= min_len)
    if max_len is not None:
        out = out.filter(F.length("seq") <= max_len)
    if max_n is not None:
        out = out.filter(n <= max_n)
    return first_by(out, ["name"]) if uniq else out


def cleaned(df: DataFrame, dash: bool = True, iupac: bool = True, upper: bool = True) -> DataFrame:
    """Dashes out, ambiguous codes to N, upper case, in this order."""
    x = F.col("seq")
    if dash:
        x = F.translate(x, "-", "")
    if iupac:
        codes = seqs.AMBIGUOUS.replace("N", "")
        x = F.translate(x, codes + codes.lower(), "N" * len(codes) + "n" * len(codes))
    return df.withColumn("seq", seqs.upper(x) if upper else x)


def windows(df: DataFrame, size: int, step: int) -> DataFrame:
    """name, s, e, seq of windows from 0 on; the last are cut at the end, windows of only N go.

    A sequence is cut once in pieces of the greatest common divisor; windows are joined from pieces.
    """
    piece = gcd(size, step)
    cut = df.filter(F.length("seq") > 0).select("name", F.length("seq").alias("n"), F.regexp_extract_all("seq", F.lit(f"((?s).{{1,{piece}}})"), F.lit(1)).alias("pieces"))
    joined = lambda at: F.struct(at.alias("at"), F.array_join(F.slice("pieces", F.floor(at / piece).cast("int") + 1, F.lit(size // piece)), "").alias("seq"))
    rows = cut.select("name", "n", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step)), joined)).alias("w"))
    out = rows.select("name", (F.col("w.at") + 1).cast("long").alias("s"), F.least(F.col("w.at") + size, F.col("n")).cast("long").alias("e"), F.col("w.seq").alias("seq"))
    return out.filter(F.length(F.replace(F.replace("seq", F.lit("N"), F.lit("")), F.lit("n"), F.lit(""))) > 0)


def masked(df: DataFrame, gaps_only: bool = False) -> DataFrame:
    """name, s, e of maximal runs of lower case or N (only N with ``gaps_only``), 1-based."""
    pattern = "[Nn]+" if gaps_only else "[a-zN]+"
    runs = F.regexp_extract_all("seq", F.lit(f"({pattern})"), F.lit(1))
    rest = F.split("seq", pattern)  # what stands between the runs gives their places
    both = df.select("name", F.posexplode(F.arrays_zip(runs.alias("run"), F.slice(rest, 1, F.size(runs)).alias("before"))).alias("i", "x"))
    w = Window.partitionBy("name").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    e = F.sum(F.length("x.run") + F.length("x.before")).over(w)
    return both.filter("x.run IS NOT NULL").select("name", (e - F.length("x.run") + 1).cast("long").alias("s"), e.cast("long").alias("e"))


def mask(df: DataFrame, spans: DataFrame, hard: bool = False) -> DataFrame:
    """Lower case (or N) in the spans (name, s, e) of each sequence; spans beyond a sequence are an error."""
    by = islands(spans, ["name"]).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_spans"))
    hidden = lambda x: F.repeat(F.lit("N"), F.length(x)) if hard else F.translate(x, seqs.UPPER, seqs.LOWER)
    one = lambda x, p: F.overlay(x, hidden(F.substring(x, p["s"].cast("int"), (p["e"] - p["s"] + 1).cast("int"))), p["s"].cast("int"), (p["e"] - p["s"] + 1).cast("int"))
    bad = F.exists("_spans", lambda p: (p["s"] < 1) | (p["e"] > F.length("seq")))
    out = df.join(by, "name", "left")
    text = F.when(F.col("_spans").isNull(), F.col("seq")).when(bad, F.raise_error(F.lit("span beyond its sequence")).cast("string")).otherwise(F.aggregate("_spans", F.col("seq"), one))
    return out.withColumn("seq", text).drop("_spans")


def extract(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """seq of each range (name, s, e, strand), reverse complement on -."""
    part = F.substring("seq", F.col("s").cast("int"), (F.col("e") - F.col("s") + 1).cast("int"))
    return ranges.join(df.select("name", "seq"), "name").withColumn("seq", F.when(F.col("strand") == "-", seqs.revcomp(part)).otherwise(part))


def ordered(df: DataFrame, names: DataFrame) -> DataFrame:
    """Records in the order of a list (name, place); names without a record are left out."""
    return df.join(names.select("name", F.col("place")), "name")


def replaced(df: DataFrame, mapping: DataFrame, some: bool = False) -> DataFrame:
    """Names by a mapping (old, new); several new names repeat a record; ``some`` drops names without one."""
    out = df.join(mapping, df.name == mapping.old, "inner" if some else "left")
    return out.withColumn("name", F.coalesce("new", "name")).drop("old", "new")


def orfs(df: DataFrame, min_len: int = 1, start_met: bool = False, end_stop: bool = False) -> DataFrame:
    """Open reading frames of six frames: name, strand, frame, s, e (1-based, + coordinates), aa."""
    plus, minus, acid = np.full(256, 4, np.uint8), np.full(256, 4, np.uint8), np.full(125, 88, np.uint8)
    for i, x in enumerate("ACGT"):
        plus[[ord(x), ord(x.lower())]] = i
        minus[[ord(x), ord(x.lower())]] = 3 - i
    minus[[85, 117]] = 0  # the complement of U is A
    for codon, x in seqs.CODONS.items():
        acid[sum("ACGT".index(c) * 5**i for i, c in enumerate(reversed(codon)))] = ord(x)

    def found(text: bytes):
        raw = np.frombuffer(text, np.uint8)
        n = len(raw)
        for strand, code in (("+", plus[raw]), ("-", minus[raw[::-1]])):
            for frame in range(min(3, max(0, n - 2))):
                m = (n - frame) // 3
                three = code[frame : frame + 3 * m].reshape(m, 3)
                aas = acid[three[:, 0] * 25 + three[:, 1] * 5 + three[:, 2]]
                ends = np.flatnonzero(aas == 42) + 1
                if not len(ends) or ends[-1] < m:
                    ends = np.append(ends, m)
                starts = np.concatenate([[0], ends[:-1]])
                whole = aas.tobytes()
                for i in np.flatnonzero(ends - starts >= min_len).tolist():
                    aa, end = whole[starts[i] : ends[i]].lstrip(b"X"), int(ends[i])
                    start = end - len(aa)
                    if len(aa) < min_len or (start_met and aa[:1] != b"M") or (end_stop and aa[-1:] != b"*"):
                        continue
                    s, e = (frame + 3 * start + 1, frame + 3 * end) if strand == "+" else (n - frame - 3 * end + 1, n - frame - 3 * start)
                    yield strand, frame, s, e, aa.decode()

    schema = pa.schema([("name", pa.string()), ("strand", pa.string()), ("frame", pa.int32()), ("s", pa.int64()), ("e", pa.int64()), ("aa", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for name, text in zip(b.column("name"), b.column("seq")):
                rows.extend((name.as_py(), *x) for x in found((text.as_py() or "").encode()))
                if len(rows) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ascii_ = df.select("name", F.regexp_replace("seq", r"[^\x00-\x7F]", "N").alias("seq"))  # a character is a byte
    return ascii_.mapInArrow(run, "name string, strand string, frame int, s long, e long, aa string")
