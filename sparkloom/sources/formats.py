"""Readers and writers of text formats: all are plain splittable or paragraph-wise text scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranges
from ..operators.alignments import PSL

_PSL_TYPES = ["int"] * 8 + ["string", "string", "int", "int", "int", "string", "int", "int", "int", "int", "array<int>", "array<int>", "array<int>"]


def _lines(spark: SparkSession, path, sep: str | None = None) -> DataFrame:
    reader = spark.read if sep is None else spark.read.option("lineSep", sep)
    return reader.text(path)


def _ints(c):
    return F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int"))


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """name, descr, seq of each record; wrapped lines are joined."""
    rec = F.regexp_replace("value", r"^\s*>", "")
    head = F.trim(F.regexp_extract(rec, r"^([^\r\n]*)", 1))
    body = F.regexp_replace(F.regexp_replace(rec, r"^[^\r\n]*", ""), r"\s", "")
    rows = _lines(spark, path, "\n>").filter("trim(value) <> ''").select(head.alias("head"), body.alias("seq"))
    return rows.select(F.regexp_extract("head", r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace("head", r"^\S*", "")).alias("descr"), "seq")


def read_fastq(spark: SparkSession, path) -> DataFrame:
    """name, descr, seq, qual of four-line records; a record of another shape is an error."""
    rows = _lines(spark, path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
    from pyspark.sql import Window

    w = Window.partitionBy("f").orderBy("i")
    n = rows.withColumn("n", F.row_number().over(w) - 1)
    rec = n.groupBy("f", F.floor(F.col("n") / 4).alias("r")).agg(F.max(F.when(F.col("n") % 4 == 0, F.col("value"))).alias("h"), F.max(F.when(F.col("n") % 4 == 1, F.col("value"))).alias("seq"), F.max(F.when(F.col("n") % 4 == 2, F.col("value"))).alias("p"), F.max(F.when(F.col("n") % 4 == 3, F.col("value"))).alias("qual"))
    ok = F.col("h").startswith("@") & F.col("p").startswith("+") & (F.length("seq") == F.length("qual"))
    name = F.regexp_extract("h", r"^@(\S*)", 1)
    return rec.select(F.when(F.coalesce(ok, F.lit(False)), name).otherwise(F.raise_error(F.concat(F.lit("bad FASTQ record: "), F.coalesce("h", F.lit(""))))).alias("name"), F.trim(F.regexp_replace("h", r"^\S*", "")).alias("descr"), "seq", "qual")


def read_sizes(spark: SparkSession, path) -> DataFrame:
    p = F.split("value", "\t")
    return _lines(spark, path).filter("trim(value) <> ''").select(F.element_at(p, 1).alias("chr"), F.trim(F.element_at(p, 2)).cast("long").alias("len"))


def read_names(spark: SparkSession, path) -> DataFrame:
    """name and place (file order)."""
    return _lines(spark, path).select(F.trim("value").alias("name"), F.monotonically_increasing_id().alias("place")).filter("name <> '' AND NOT name LIKE '#%'")


def read_replace(spark: SparkSession, path) -> DataFrame:
    """old and each new name."""
    p = F.split(F.rtrim("value"), "\t")
    return _lines(spark, path).filter("trim(value) <> ''").select(F.element_at(p, 1).alias("old"), F.explode(F.slice(p, 2, F.size(p))).alias("new"))


def read_ranges(spark: SparkSession, path) -> DataFrame:
    """line, name, chr, strand, s, e of the usable lines; others are left out."""
    rows = _lines(spark, path).filter("NOT value LIKE '#%'").select(F.col("value").alias("line"), ranges.parse(F.element_at(F.split("value", "\t"), 1)).alias("r"))
    return rows.filter("r.valid").select("line", "r.name", "r.chr", "r.strand", "r.s", "r.e")


def spans_from_text(runs):
    """array of struct(s, e) of `1-3,5,7-9`; - and empty text are the empty set."""
    part = F.filter(F.split(runs, ","), lambda x: ~x.isin("", "-"))
    return F.transform(part, lambda x: F.struct(F.regexp_extract(x, r"^(-?\d+)", 1).cast("long").alias("s"), F.coalesce(F.nullif(F.regexp_extract(x, r"^-?\d+-(-?\d+)$", 1), F.lit("")), x).cast("long").alias("e")))


def read_runlist(spark: SparkSession, path) -> DataFrame:
    """set, chr, s, e of a JSON runlist: {chr: runs}, or {set: {chr: runs}}; a single set is named __single__."""
    whole = spark.read.option("wholetext", True).text(path)
    single = F.from_json("value", "map<string,string>")
    outer = whole.select(F.explode(single).alias("k", "v"))
    inner = F.when(F.ltrim("v").startswith("{"), F.from_json("v", "map<string,string>")).otherwise(F.create_map("k", "v"))
    named = F.when(F.ltrim("v").startswith("{"), F.col("k")).otherwise(F.lit("__single__"))
    rows = outer.select(named.alias("set"), F.explode(inner).alias("chr", "runs"))
    return rows.select("set", "chr", F.explode(spans_from_text(F.col("runs"))).alias("x")).select("set", "chr", "x.s", "x.e")


def runlist_json(spans: DataFrame) -> DataFrame:
    """One JSON row of spans (chr, s, e) with sorted keys."""
    text = F.when(F.col("s") == F.col("e"), F.col("s").cast("string")).otherwise(F.concat_ws("-", "s", "e"))
    by = spans.withColumn("t", text).groupBy("chr").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "t"))), lambda x: x["t"]), ",").alias("runs"))
    return by.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chr", "runs"))))).alias("json"))


def read_psl(spark: SparkSession, path) -> DataFrame:
    """PSL with or without its header; rows start with a number."""
    p = F.split("value", "\t")
    rows = _lines(spark, path).filter(F.col("value").rlike(r"^\d+\t"))
    cols = [(_ints(F.element_at(p, i + 1)) if kind.startswith("array") else F.element_at(p, i + 1).cast(kind)).alias(c) for i, (c, kind) in enumerate(zip(PSL, _PSL_TYPES))]
    return rows.select(*cols)


def write_psl(df: DataFrame, path: str) -> None:
    cols = [F.concat(F.array_join(F.col(c).cast("array<string>"), ","), F.lit(",")) if kind.startswith("array") else F.col(c).cast("string") for c, kind in zip(PSL, _PSL_TYPES)]
    df.select(F.concat_ws("\t", *cols)).write.text(path)


def read_paf(spark: SparkSession, path) -> DataFrame:
    names = "q_name q_len q_start q_end strand t_name t_len t_start t_end matches block_len mapq".split()
    p = F.split("value", "\t")
    cols = [F.element_at(p, i + 1).cast("string" if c in ("q_name", "strand", "t_name") else "long").alias(c) for i, c in enumerate(names)]
    tags = F.slice(p, 13, F.greatest(F.size(p) - 12, F.lit(0)))
    cg = F.element_at(F.filter(tags, lambda x: x.startswith("cg:Z:")), 1)
    return _lines(spark, path).filter(F.size(p) >= 12).select(*cols, tags.alias("tags"), F.coalesce(F.substring(cg, 6, 1 << 30), F.lit("")).alias("cg"))


def read_chain(spark: SparkSession, path) -> DataFrame:
    """Header columns and blocks (size, dt, dq) of each chain; comment lines are skipped."""
    text = F.regexp_replace(F.regexp_replace("value", r"(?m)^#.*$", ""), r"^\s+|\s+$", "")
    rows = _lines(spark, path, "\n\n").select(text.alias("t")).filter(F.col("t").startswith("chain"))
    lines = F.split("t", r"\s*\n")
    h = F.split(F.element_at(lines, 1), r"\s+")
    body = F.filter(F.slice(lines, 2, F.size(lines)), lambda x: F.trim(x) != "")
    block = lambda x, i: F.coalesce(F.get(F.split(F.trim(x), r"\s+"), i).cast("long"), F.lit(0))
    names = [("score", "double"), ("t_name", "string"), ("t_size", "long"), ("t_strand", "string"), ("t_start", "long"), ("t_end", "long"), ("q_name", "string"), ("q_size", "long"), ("q_strand", "string"), ("q_start", "long"), ("q_end", "long"), ("id", "long")]
    cols = [F.get(h, i + 1).cast(k).alias(n) for i, (n, k) in enumerate(names)]
    return rows.select(*cols, F.transform(body, lambda x: F.struct(block(x, F.lit(0)).alias("size"), block(x, F.lit(1)).alias("dt"), block(x, F.lit(2)).alias("dq"))).alias("blocks"))


def read_axt(spark: SparkSession, path) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace("value", r"(?m)^#.*$", ""), r"^\s+|\s+$", "")
    lines = F.split("t", r"\s*\n")
    h = F.split(F.element_at(lines, 1), r"\s+")
    names = [("id", "int"), ("t_name", "string"), ("t_start", "long"), ("t_end", "long"), ("q_name", "string"), ("q_start", "long"), ("q_end", "long"), ("q_strand", "string"), ("score", "long")]
    rows = _lines(spark, path, "\n\n").select(text.alias("t")).filter("t <> ''")
    return rows.select(*[F.get(h, i).cast(k).alias(n) for i, (n, k) in enumerate(names)], F.element_at(lines, 2).alias("t_text"), F.element_at(lines, 3).alias("q_text"))


def read_maf(spark: SparkSession, path) -> DataFrame:
    """score and comps (src, start, size, strand, src_size, text) of each block."""
    rows = _lines(spark, path, "\n\n").filter(F.col("value").rlike(r"(?m)^a\b"))
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.rlike(r"^s\s"))
    f = lambda x, i: F.get(F.split(F.trim(x), r"\s+"), F.lit(i))
    comp = F.transform(lines, lambda x: F.struct(f(x, 1).alias("src"), f(x, 2).cast("long").alias("start"), f(x, 3).cast("long").alias("size"), f(x, 4).alias("strand"), f(x, 5).cast("long").alias("src_size"), f(x, 6).alias("text")))
    return rows.select(F.regexp_extract("value", r"score=(\S+)", 1).try_cast("double").alias("score"), comp.alias("comps"))


def read_gff(spark: SparkSession, path) -> DataFrame:
    """The nine columns, attributes as a map (key=value of GFF3, key value of GTF)."""
    p = F.split("value", "\t")
    rows = _lines(spark, path).filter("NOT value LIKE '#%'").filter(F.size(p) >= 8)
    text = F.coalesce(F.get(p, F.lit(8)), F.lit(""))
    pairs = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
    entry = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^([^=\s]+)", 1).alias("key"), F.regexp_replace(F.regexp_replace(x, r"^[^=\s]+[=\s]*", ""), '^"|"$', "").alias("value")))
    first = F.transform(F.array_distinct(F.transform(entry, lambda x: x["key"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entry, lambda x: x["key"] == k), 1)["value"].alias("value")))
    names = ["seqid", "source", "type", "s", "e", "score", "strand", "phase"]
    return rows.select(*[F.element_at(p, i + 1).cast("int" if c in "se" else "string").alias(c) for i, c in enumerate(names)], F.map_from_entries(first).alias("attrs"))


def read_net(spark: SparkSession, path) -> DataFrame:
    """Fills and gaps with their chromosome, depth and parent: node_id is the line's place, found by nesting."""
    from pyspark.sql import Window

    rows = _lines(spark, path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")).filter("trim(value) <> '' AND NOT value LIKE '#%'")
    w = Window.partitionBy("f").orderBy("i")
    p = F.split(F.trim("value"), r"\s+")
    rows = rows.withColumns({"chrom": F.last(F.when(F.col("value").startswith("net "), F.element_at(p, 2)), ignorenulls=True).over(w), "depth": (F.length("value") - F.length(F.ltrim("value"))).cast("int"), "p": p})
    rows = rows.filter("NOT value LIKE 'net %'")
    above = Window.partitionBy("f", "chrom").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.collect_list(F.struct("i", "depth")).over(above)
    parent = F.element_at(F.filter(seen, lambda x: x["depth"] == F.col("depth") - 1), -1)["i"]
    num = lambda i: F.get("p", F.lit(i)).cast("long")
    keys = F.filter(F.transform(F.sequence(F.lit(7), F.size("p") - 2, F.lit(2)), lambda i: F.struct(F.get("p", i).alias("k"), F.get("p", i + 1).alias("v"))), lambda x: x["k"].isNotNull())
    attrs = F.when(F.size("p") >= 9, F.map_from_entries(keys))
    return rows.select("chrom", F.col("i").alias("node_id"), F.when(F.col("depth") > 1, parent).alias("parent_id"), "depth", F.get("p", F.lit(0)).alias("kind"), num(1).alias("start"), num(2).alias("size"), F.get("p", F.lit(3)).alias("o_chrom"), F.get("p", F.lit(4)).alias("o_strand"), num(5).alias("o_start"), num(6).alias("o_size"), attrs.alias("attrs"))


def read_blocks(spark: SparkSession, path) -> DataFrame:
    """block_id, idx, name, chr, strand, s, e, seq of block FASTA: blocks are parted by empty lines."""
    rows = _lines(spark, path, "\n\n").filter("trim(value) <> ''").select(F.monotonically_increasing_id().alias("block_id"), F.filter(F.split("value", r"(?:^|\n)>"), lambda x: F.trim(x) != "").alias("entries"))
    one = rows.select("block_id", F.posexplode("entries").alias("idx", "x"))
    head = F.trim(F.regexp_replace(F.regexp_extract("x", r"^([^\r\n]*)", 1), "^>", ""))
    return one.select("block_id", "idx", ranges.parse(head).alias("r"), F.regexp_replace(F.regexp_replace("x", r"^[^\r\n]*", ""), r"\s", "").alias("seq")).select("block_id", "idx", "r.name", "r.chr", "r.strand", "r.s", "r.e", "seq")


def write_fasta(df: DataFrame, path: str, line: int = 80) -> None:
    wrapped = F.regexp_replace("seq", f"(.{{{line}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), "name", F.lit("\n"), wrapped)).write.text(path)
