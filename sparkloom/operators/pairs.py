"""Pairwise texts of aligned columns, CIGARs, segments and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def column_ops(t: Column, q: Column) -> Column:
    """One character for each column: = equal, X other base, I gap in the target, D gap in the query; double gaps go."""
    up = lambda c: F.split(F.translate(c, "acgtn", "ACGTN"), "")
    one = lambda p: F.when((p["a"] == "-") & (p["b"] == "-"), "").when(p["a"] == "-", "I").when(p["b"] == "-", "D").when(p["a"] == p["b"], "=").otherwise("X")
    return F.array_join(F.transform(F.arrays_zip(up(t).alias("a"), up(q).alias("b")), one), "")


def cigar(ops: Column) -> Column:
    """Runs of operations with their lengths."""
    runs = F.regexp_extract_all(ops, F.lit("(=+|X+|I+|D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1))), "")


def _n(ops: Column, c: str) -> Column:
    return (F.length(ops) - F.length(F.translate(ops, c, ""))).cast("long")


def _runs(ops: Column, c: str) -> Column:
    return F.size(F.regexp_extract_all(ops, F.lit(f"({c}+)"), F.lit(1))).cast("long")


def pair_counts(df: DataFrame) -> DataFrame:
    """Adds cg, match, mismatch, q_num_insert, q_base_insert, t_num_insert and t_base_insert from t_text and q_text."""
    out = df.withColumn("_o", column_ops(F.col("t_text"), F.col("q_text")))
    o = F.col("_o")
    return out.withColumns({"cg": cigar(o), "match": _n(o, "="), "mismatch": _n(o, "X"), "q_num_insert": _runs(o, "I"), "q_base_insert": _n(o, "I"), "t_num_insert": _runs(o, "D"), "t_base_insert": _n(o, "D")}).drop("_o")


def segments(paf: DataFrame, min_len: int) -> DataFrame:
    """Alignments (row, t_start, q_start, cg) cut at gaps of at least ``min_len``: row, part, t_from, t_to, q_from, q_to."""
    ops = F.transform(F.regexp_extract_all("cg", F.lit(r"(\d+[MIDX=])"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, r"\d+", 0).cast("long").alias("n"), F.right(x, F.lit(1)).alias("op")))
    rows = paf.select("row", "t_start", "q_start", F.posexplode(ops).alias("i", "x")).select("row", "t_start", "q_start", "i", "x.n", "x.op")
    w = Window.partitionBy("row").orderBy("i")
    t = F.when(F.col("op") == "I", 0).otherwise(F.col("n"))
    q = F.when(F.col("op") == "D", 0).otherwise(F.col("n"))
    cut = (F.col("op").isin("I", "D") & (F.col("n") >= min_len)).cast("int")
    rows = rows.withColumns({"te": F.col("t_start") + F.sum(t).over(w), "qe": F.col("q_start") + F.sum(q).over(w), "t": t, "q": q, "cut": cut})
    rows = rows.withColumn("part", F.sum("cut").over(w)).filter("cut = 0")
    out = rows.groupBy("row", "part").agg(F.min(F.col("te") - F.col("t")).alias("t_from"), F.max("te").alias("t_to"), F.min(F.col("qe") - F.col("q")).alias("q_from"), F.max("qe").alias("q_to"))
    number = F.row_number().over(Window.partitionBy("row").orderBy("part")) - 1
    return out.withColumn("part", number)


def slice_blocks(df: DataFrame, s: int, e: int) -> DataFrame:
    """The columns of blocks (block_id, idx, seq) from target position s to e; blocks that do not reach s go."""
    w = Window.partitionBy("block_id")
    target = F.max(F.when(F.col("idx") == 0, F.col("seq"))).over(w)
    bases = F.filter(F.transform(F.split("_t", ""), lambda x, i: F.when(x != "-", i + 1)), lambda x: x.isNotNull())
    out = df.withColumn("_t", target).withColumn("_b", bases).filter(F.size("_b") >= s)
    lo, hi = F.get("_b", F.lit(s - 1)), F.get("_b", F.least(F.lit(e), F.size("_b")) - 1)
    return out.withColumn("seq", F.substring("seq", lo.cast("int"), (hi - lo + 1).cast("int"))).drop("_t", "_b")


def archive(df: DataFrame, reference: DataFrame, size: int) -> DataFrame:
    """sample, seg, encoding and payload of sequences (sample, ref, seq) in segments: identity to the reference's, or raw."""
    cut = lambda x, *keys: x.filter("length(seq) > 0").select(*keys, "seq", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / size).cast("int"))).alias("seg")).select(*keys, "seg", F.substring("seq", F.col("seg") * size + 1, F.lit(size)).alias("part"))
    own = cut(df, "sample", "ref")
    ref = cut(reference, "ref").withColumnRenamed("part", "_r")
    out = own.join(ref, ["ref", "seg"], "left")
    same = F.coalesce(F.col("part") == F.col("_r"), F.lit(False))
    return out.select("sample", "ref", F.col("seg").cast("long").alias("seg"), F.when(same, "identity").otherwise("raw").alias("encoding"), F.when(~same, F.col("part")).alias("payload"))


def restore(arch: DataFrame, reference: DataFrame, size: int) -> DataFrame:
    """sample, seq of archived segments."""
    ref = archive(reference.select(F.col("ref").alias("sample"), F.lit(None).cast("string").alias("ref"), "seq"), reference.limit(0), size).select(F.col("sample").alias("ref"), "seg", F.col("payload").alias("_r"))
    rows = arch.join(ref, ["ref", "seg"], "left").withColumn("_p", F.coalesce("payload", "_r"))
    return rows.groupBy("sample").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "_p"))), lambda x: x["_p"]), "").alias("seq"))
