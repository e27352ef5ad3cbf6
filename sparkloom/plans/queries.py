"""Queries of the reference's operators over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranges, seqs
from ..operators import alignments, blocks, graphs, intervals, kmers, sequences, vectors
from ..sources import twobit
from . import fixtures as fx
from .fixtures import BLOCKS, IV, PAF, PSL, RC, SEQ, SEQ_CASE, SIZES, SOLID, sql_depth, sql_islands

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _set(iv, flag):
    return intervals.islands(iv.filter(F.col("f") == flag), ["chr"])


SETS = IV + ", " + sql_islands("isl", "iv", "f, chr")
SPANS_A = IV + ", a0 AS (SELECT chr, s, e FROM iv WHERE f = 'A'), " + sql_islands("sp", "a0", "chr")


# --- ranges -----------------------------------------------------------------------------------
@query(f"WITH {IV}, {sql_islands('r', 'iv', 'chr')} SELECT chr, s, e FROM r")
def rg_cover(spark, d):
    return intervals.islands(fx.intervals(spark, d), ["chr"])


@query(f"WITH {IV}, {sql_depth('r', 'iv', 'chr')}, x AS (SELECT * FROM r WHERE depth >= 2), {sql_islands('z', 'x', 'chr')} SELECT chr, s, e FROM z")
def rg_coverage(spark, d):
    return intervals.coverage(fx.intervals(spark, d), ["chr"], 2)


@query(f"WITH {IV}, {sql_depth('r', 'iv', 'chr')}, {sql_islands('z', 'r', 'chr, depth')} SELECT chr, depth, s, e FROM z")
def rg_coverage_detailed(spark, d):
    return intervals.coverage(fx.intervals(spark, d), ["chr"], detailed=True)


@query(f"WITH {IV} SELECT t.id, t.chr, t.s, t.e, count(o.id) AS n FROM (SELECT * FROM iv WHERE f = 'A') t LEFT JOIN (SELECT * FROM iv WHERE f <> 'A') o ON t.chr = o.chr AND o.s <= t.e AND t.s <= o.e GROUP BY ALL")
def rg_count(spark, d):
    iv = fx.intervals(spark, d)
    return intervals.overlap_count(iv.filter("f = 'A'").select("id", "chr", "s", "e"), iv.filter("f <> 'A'"), "chr", ["id"])


_COVERED = f"WITH {SPANS_A}, t AS (SELECT id, chr, s, e FROM iv WHERE f <> 'A'), c AS (SELECT t.id, t.chr, t.s, t.e, CAST(sum(CASE WHEN sp.s IS NULL THEN 0 ELSE least(t.e, sp.e) - greatest(t.s, sp.s) + 1 END) AS BIGINT) AS size FROM t LEFT JOIN sp ON t.chr = sp.chr AND sp.s <= t.e AND t.s <= sp.e GROUP BY ALL)"


@query(f"{_COVERED} SELECT id, chr, s, e, size, e - s + 1 AS length, round(size / (e - s + 1), 4) AS prop FROM c")
def rg_prop(spark, d):
    iv = fx.intervals(spark, d)
    return intervals.proportion(iv.filter("f <> 'A'").select("id", "chr", "s", "e"), _set(iv, "A"), "chr", ["id"])


def _selected(spark, d, op):
    iv = fx.intervals(spark, d)
    return intervals.select_by_spans(iv.filter("f <> 'A'").select("id", "chr", "s", "e"), _set(iv, "A"), "chr", ["id"], op).select("id", "chr", "s", "e")


@query(f"{_COVERED} SELECT id, chr, s, e FROM c WHERE size > 0")
def rg_runlist_overlap(spark, d):
    return _selected(spark, d, "overlap")


@query(f"{_COVERED} SELECT id, chr, s, e FROM c WHERE size = 0")
def rg_runlist_non_overlap(spark, d):
    return _selected(spark, d, "non-overlap")


@query(f"{_COVERED} SELECT id, chr, s, e FROM c WHERE size = e - s + 1")
def rg_runlist_superset(spark, d):
    return _selected(spark, d, "superset")


@query(f"""WITH RECURSIVE {IV}, u AS (SELECT DISTINCT chr, s, e FROM iv), v AS (SELECT chr || ':' || s || '-' || e AS node, chr, s, e FROM u),
p AS (SELECT a.node AS a, b.node AS b FROM v a JOIN v b ON a.chr = b.chr AND a.node < b.node AND a.s <= b.e AND b.s <= a.e
  WHERE CAST(least(a.e, b.e) - greatest(a.s, b.s) + 1 AS FLOAT) / CAST(a.e - a.s + 1 AS FLOAT) >= CAST(0.95 AS FLOAT) AND CAST(least(a.e, b.e) - greatest(a.s, b.s) + 1 AS FLOAT) / CAST(b.e - b.s + 1 AS FLOAT) >= CAST(0.95 AS FLOAT)),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(node, root) AS (SELECT a, a FROM l UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a),
g AS (SELECT node, min(root) AS root FROM r GROUP BY node), m AS (SELECT root, any_value(chr) AS chr, min(s) AS s, max(e) AS e FROM g JOIN v USING (node) GROUP BY root)
SELECT v.node AS part, m.chr || '(+):' || CASE WHEN m.s = m.e THEN CAST(m.s AS VARCHAR) ELSE m.s || '-' || m.e END AS merged FROM g JOIN v USING (node) JOIN m USING (root) WHERE NOT (v.s = m.s AND v.e = m.e)""")
def rg_merge(spark, d):
    u = fx.intervals(spark, d).select("chr", "s", "e").distinct().withColumn("node", F.concat(F.col("chr"), F.lit(":"), F.col("s"), F.lit("-"), F.col("e")))
    groups = graphs.components(intervals.reciprocal_pairs(u, "chr", "node"))
    whole = groups.join(u, "node").groupBy("component").agg(F.min("chr").alias("chr"), F.min("s").alias("ms"), F.max("e").alias("me"))
    merged = ranges.render(F.col("chr"), F.lit("+"), F.col("ms"), F.col("me"))
    out = groups.join(u.drop("chr"), "node").join(whole, "component").filter("NOT (s = ms AND e = me)")
    return out.select(F.col("node").alias("part"), merged.alias("merged"))


@query(f"WITH {IV} SELECT id, row_number() OVER (PARTITION BY chr ORDER BY s, f, id) AS place FROM iv")
def rg_sort(spark, d):
    """The order within each chromosome as a column; a written table is sorted by (chr, place)."""
    from pyspark.sql import Window

    w = Window.partitionBy("chr").orderBy("s", "f", "id")
    return fx.intervals(spark, d).select("id", F.row_number().over(w).cast("long").alias("place"))


_STRANDED = f"WITH {IV}, x AS (SELECT id, s + 2000 AS s, e + 2000 AS e, CASE WHEN f = 'R' THEN '-' ELSE '+' END AS strand FROM iv)"


def _span(spark, d, op, mode, n):
    iv = fx.intervals(spark, d).select("id", (F.col("s") + 2000).alias("s"), (F.col("e") + 2000).alias("e"), F.when(F.col("f") == "R", "-").otherwise("+").alias("strand"))
    s, e = ranges.span(F.col("s"), F.col("e"), F.col("strand"), op, mode, n)
    return iv.select("id", s.cast("long").alias("s"), e.cast("long").alias("e"))


@query(f"{_STRANDED} SELECT id, CASE WHEN s + 5 <= e - 5 THEN s + 5 END AS s, CASE WHEN s + 5 <= e - 5 THEN e - 5 END AS e FROM x")
def rg_span_trim(spark, d):
    return _span(spark, d, "trim", "both", 5)


@query(f"{_STRANDED} SELECT id, CASE WHEN strand = '+' THEN s - 10 ELSE s END AS s, CASE WHEN strand = '+' THEN e ELSE e + 10 END AS e FROM x")
def rg_span_pad_5p(spark, d):
    return _span(spark, d, "pad", "5p", 10)


@query(f"{_STRANDED} SELECT id, CASE WHEN strand = '+' THEN s - 30 ELSE e + 1 END AS s, CASE WHEN strand = '+' THEN s - 1 ELSE e + 30 END AS e FROM x")
def rg_span_flank_5p(spark, d):
    return _span(spark, d, "flank", "5p", 30)


@query(f"{_STRANDED} SELECT id, CASE WHEN strand = '+' THEN s + 7 ELSE s - 7 END AS s, CASE WHEN strand = '+' THEN e + 7 ELSE e - 7 END AS e FROM x")
def rg_span_shift_3p(spark, d):
    return _span(spark, d, "shift", "3p", 7)


@query(f"{_STRANDED} SELECT id, CASE WHEN e - s + 1 >= 20 THEN s END AS s, CASE WHEN e - s + 1 >= 20 THEN e END AS e FROM x")
def rg_span_excise(spark, d):
    return _span(spark, d, "excise", "both", 20)


# --- runlists ---------------------------------------------------------------------------------
_ALG = IV + ", " + sql_islands("isl", "iv", "f, chr") + """,
ev AS (SELECT chr, pos, sum(d) AS d, sum(d0) AS d0 FROM (SELECT chr, s AS pos, 1 AS d, CASE WHEN f = 'A' THEN 1 ELSE 0 END AS d0 FROM isl UNION ALL SELECT chr, e + 1, -1, CASE WHEN f = 'A' THEN -1 ELSE 0 END FROM isl) GROUP BY chr, pos),
rn AS (SELECT chr, pos AS s, lead(pos) OVER (PARTITION BY chr ORDER BY pos) - 1 AS e, sum(d) OVER (PARTITION BY chr ORDER BY pos) AS depth, sum(d0) OVER (PARTITION BY chr ORDER BY pos) AS first FROM ev)"""


def _alg_sql(cond):
    return f"WITH {_ALG}, k AS (SELECT chr, s, e FROM rn WHERE {cond}), {sql_islands('z', 'k', 'chr')} SELECT chr, s, e FROM z"


def _algebra(spark, d, op):
    iv = fx.intervals(spark, d)
    sets = intervals.islands(iv, ["f", "chr"]).withColumn("which", F.when(F.col("f") == "A", 0).when(F.col("f") == "N", 1).otherwise(2))
    return intervals.algebra(sets, ["chr"], "which", op, 3)


@query(_alg_sql("depth > 0"))
def runlist_combine_union(spark, d):
    return _algebra(spark, d, "union")


@query(_alg_sql("depth = 3"))
def runlist_compare_intersect(spark, d):
    return _algebra(spark, d, "intersect")


@query(_alg_sql("first > 0 AND depth = first"))
def runlist_compare_diff(spark, d):
    return _algebra(spark, d, "diff")


@query(_alg_sql("depth % 2 = 1"))
def runlist_compare_xor(spark, d):
    return _algebra(spark, d, "xor")


@query(f"WITH {IV}, {sql_islands('r', 'iv', 'chr')}, q AS (SELECT chr, s, e, row_number() OVER (PARTITION BY chr ORDER BY e - s DESC, s) AS n FROM r) SELECT chr || ':' || CASE WHEN s = e THEN CAST(s AS VARCHAR) ELSE s || '-' || e END AS line FROM q WHERE n = 1")
def runlist_convert_longest(spark, d):
    best = intervals.longest(intervals.islands(fx.intervals(spark, d), ["chr"]), ["chr"])
    return best.select(ranges.render(F.col("chr"), F.lit(""), F.col("s"), F.col("e")).alias("line"))


@query(f"WITH {IV}, {SIZES} SELECT chr, CAST(1 AS BIGINT) AS s, len AS e FROM sizes")
def runlist_genome(spark, d):
    return fx.sizes(fx.intervals(spark, d)).select("chr", F.lit(1).cast("long").alias("s"), F.when(F.col("len").between(1, ranges.POS_INF), F.col("len")).otherwise(F.raise_error(F.lit("size out of range"))).alias("e"))


@query(f"WITH {SETS} SELECT f AS set_name, chr, s, e FROM isl")
def runlist_merge(spark, d):
    """Sets under one table, keyed by name."""
    return intervals.islands(fx.intervals(spark, d), ["f", "chr"]).withColumnRenamed("f", "set_name")


@query(f"WITH {SETS} SELECT f AS set_name, chr, s, e FROM isl WHERE f IN ('A', 'R')")
def runlist_some(spark, d):
    names = spark.createDataFrame([("A",), ("R",), ("none",)], "f string")
    return intervals.islands(fx.intervals(spark, d), ["f", "chr"]).join(names, "f", "leftsemi").withColumnRenamed("f", "set_name")


@query(f"WITH {IV}, {sql_islands('r', 'iv', 'chr')} SELECT chr, min(s) AS s, max(e) AS e FROM r GROUP BY chr")
def runlist_span_cover(spark, d):
    return intervals.span(fx.intervals(spark, d), ["chr"], "cover")


@query(f"WITH {IV}, {sql_islands('r', 'iv', 'chr')}, q AS (SELECT chr, e + 1 AS s, lead(s) OVER (PARTITION BY chr ORDER BY s) - 1 AS e FROM r) SELECT * FROM q WHERE e IS NOT NULL")
def runlist_span_holes(spark, d):
    return intervals.span(fx.intervals(spark, d), ["chr"], "holes")


@query(f"WITH {IV}, {sql_islands('r', 'iv', 'chr')} SELECT chr, s + 4 AS s, e - 4 AS e FROM r WHERE s + 4 <= e - 4")
def runlist_span_trim(spark, d):
    return intervals.span(fx.intervals(spark, d), ["chr"], "trim", 4)


@query(f"WITH {IV}, {sql_islands('r', 'iv', 'chr')}, q AS (SELECT chr, s - 4 AS s, e + 4 AS e FROM r), {sql_islands('z', 'q', 'chr')} SELECT chr, s, e FROM z")
def runlist_span_pad(spark, d):
    return intervals.span(fx.intervals(spark, d), ["chr"], "pad", 4)


@query(f"WITH {IV}, {sql_islands('r', 'iv', 'chr')} SELECT chr, s, e FROM r WHERE e - s + 1 >= 25")
def runlist_span_excise(spark, d):
    return intervals.span(fx.intervals(spark, d), ["chr"], "excise", 25)


@query(f"WITH {IV}, {sql_islands('r', 'iv', 'chr', 31)} SELECT chr, s, e FROM r")
def runlist_span_fill(spark, d):
    return intervals.span(fx.intervals(spark, d), ["chr"], "fill", 30)


@query(f"WITH {IV}, {sql_islands('r', 'iv', 'chr')} SELECT chr, string_agg(CASE WHEN s = e THEN CAST(s AS VARCHAR) ELSE s || '-' || e END, ',' ORDER BY s) AS runs FROM r GROUP BY chr")
def runlist_split(spark, d):
    """One row for each key, with its runs as text; a writer partitions by key."""
    part = F.when(F.col("s") == F.col("e"), F.col("s").cast("string")).otherwise(F.concat_ws("-", "s", "e"))
    r = intervals.islands(fx.intervals(spark, d), ["chr"]).withColumn("t", part)
    return r.groupBy("chr").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "t"))), lambda x: x["t"]), ",").alias("runs"))


@query(f"WITH {IV}, {SIZES}, {sql_islands('r', 'iv', 'chr')}, b AS (SELECT chr, any_value(len) AS length, CAST(sum(e - s + 1) AS BIGINT) AS size FROM r JOIN sizes USING (chr) GROUP BY chr) SELECT chr, length, size, round(size / length, 4) AS coverage FROM b UNION ALL SELECT 'all', CAST(sum(length) AS BIGINT), CAST(sum(size) AS BIGINT), round(sum(size) / sum(length), 4) FROM b")
def runlist_stat(spark, d):
    iv = fx.intervals(spark, d)
    return intervals.stat(intervals.islands(iv, ["chr"]), fx.sizes(iv), "chr")


@query(f"""WITH {IV}, {SIZES}, {sql_islands('isl', 'iv', 'f, chr')}, x1 AS (SELECT chr, CAST(sum(e - s + 1) AS BIGINT) AS size1 FROM isl WHERE f = 'A' GROUP BY chr), x2 AS (SELECT chr, CAST(sum(e - s + 1) AS BIGINT) AS size2 FROM isl WHERE f = 'N' GROUP BY chr),
o AS (SELECT a.chr, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s) + 1) AS BIGINT) AS op_size FROM isl a JOIN isl b ON a.f = 'A' AND b.f = 'N' AND a.chr = b.chr AND a.s <= b.e AND b.s <= a.e GROUP BY a.chr),
r AS (SELECT chr, len AS length, size1, coalesce(size2, 0) AS size2, coalesce(op_size, 0) AS op_size FROM sizes JOIN x1 USING (chr) LEFT JOIN x2 USING (chr) LEFT JOIN o USING (chr)),
t AS (SELECT * FROM r UNION ALL SELECT 'all', CAST(sum(length) AS BIGINT), CAST(sum(size1) AS BIGINT), CAST(sum(size2) AS BIGINT), CAST(sum(op_size) AS BIGINT) FROM r),
c AS (SELECT *, size1 / length AS c1, CASE WHEN size2 = 0 THEN 0.0 ELSE op_size / size2 END AS c2 FROM t)
SELECT chr, length, size1, size2, op_size, round(c1, 4) AS c1, round(CAST(c2 AS DOUBLE), 4) AS c2, round(CAST(CASE WHEN c1 < 1e-5 THEN 0.0 ELSE c2 / c1 END AS DOUBLE), 4) AS ratio FROM c""")
def runlist_statop(spark, d):
    iv = fx.intervals(spark, d)
    return intervals.statop(_set(iv, "A"), _set(iv, "N"), fx.sizes(iv), "chr")


@query(f"""WITH {IV}, {SIZES}, {sql_islands('r', 'iv', 'chr')}, q AS (SELECT chr, s, e, lag(e) OVER (PARTITION BY chr ORDER BY s) AS p FROM r WHERE e >= 1), h AS (SELECT chr, coalesce(p, 0) + 1 AS s, s - 1 AS e FROM q UNION ALL SELECT chr, max(e) + 1, any_value(len) FROM q JOIN sizes USING (chr) GROUP BY chr)
SELECT chr, s, e FROM h WHERE s <= e""")
def runlist_complement(spark, d):
    iv = fx.intervals(spark, d)
    return intervals.complement(iv, fx.sizes(iv), "chr")


@query(f"WITH {IV}, {sql_islands('r', 'iv', 'f, chr')} SELECT f AS feature, chr, s, e FROM r")
def gff_runlist(spark, d):
    return intervals.islands(fx.intervals(spark, d), ["f", "chr"]).withColumnRenamed("f", "feature")


@query(f"WITH {IV} SELECT id || chr(9) || 'asm.' || chr || CASE WHEN f = 'R' THEN '(-):' ELSE '(+):' END || CASE WHEN s = e THEN CAST(s AS VARCHAR) ELSE s || '-' || e END AS line FROM (SELECT id, chr, s + 2000 AS s, e + 2000 AS e, f FROM iv)")
def gff_rg(spark, d):
    iv = fx.intervals(spark, d).withColumns({"s": F.col("s") + 2000, "e": F.col("e") + 2000})
    text = ranges.render(F.col("chr"), F.when(F.col("f") == "R", "-").otherwise("+"), F.col("s"), F.col("e"), F.lit("asm"))
    return iv.select(F.concat_ws("\t", "id", text).alias("line"))


# --- sequences --------------------------------------------------------------------------------
_COUNTS = ", ".join(f"CAST(length(seq) - length(replace(seq, '{b}', '')) AS BIGINT) AS {b}" for b in "ACGT")


@query(f"WITH {SEQ}, b AS (SELECT name, {_COUNTS}, CAST(0 AS BIGINT) AS N FROM seq), c AS (SELECT name, A + C + G + T + N AS len, A, C, G, T, N FROM b) SELECT * FROM c UNION ALL SELECT 'total', " + ", ".join(f"CAST(sum({c}) AS BIGINT)" for c in ("len", "A", "C", "G", "T", "N")) + " FROM c")
def fa_count(spark, d):
    return sequences.base_counts(fx.sequences(spark, d))


@query(f"WITH {SEQ} SELECT name, CAST(length(seq) AS BIGINT) AS len FROM seq")
def fa_size(spark, d):
    return fx.sequences(spark, d).select("name", F.length("seq").cast("long").alias("len"))


@query(f"WITH {SEQ} SELECT arg_min(name, pos) AS name, seq FROM seq GROUP BY seq")
def fa_dedup_seq(spark, d):
    return sequences.dedup(fx.sequences(spark, d), "seq").select("name", "seq")


@query(f"WITH {SEQ}, k AS (SELECT *, least(seq, {RC.format(x='seq')}) AS key FROM seq) SELECT min(pos) AS pos FROM k GROUP BY key")
def fa_dedup_both(spark, d):
    return sequences.dedup(fx.sequences(spark, d), "seq", both_strands=True).select("pos")


@query(f"WITH {SEQ} SELECT name FROM seq WHERE length(seq) >= 200 AND length(seq) <= 5000")
def fa_filter(spark, d):
    return sequences.filter_records(fx.sequences(spark, d), 200, 5000, 10).select("name")


@query(f"""WITH {SEQ}, l AS (SELECT length(seq) AS n FROM seq), r AS (SELECT n, sum(n) OVER (ORDER BY n DESC) AS cum FROM l)
SELECT CAST((SELECT max(n) FROM r WHERE cum >= floor((SELECT sum(n) FROM l) * 50 / 100)) AS BIGINT) AS nx, CAST(sum(n) AS BIGINT) AS sum, round(sum(n) / count(*), 2) AS average, round(sum(n * n) / sum(n), 2) AS esize, count(*) AS count FROM l""")
def fa_n50(spark, d):
    return sequences.nx_stats(fx.sequences(spark, d).withColumn("n", F.length("seq")), "n")


@query(f"WITH {SEQ} SELECT name, seq FROM seq WHERE name = 'd42'")
def fa_one(spark, d):
    return fx.sequences(spark, d).filter("name = 'd42'").select("name", "seq")


_LIST = "lst AS (SELECT 'd' || o_orderkey AS name, o_custkey AS place FROM orders WHERE o_orderkey % 3 = 0)"


def _listed(spark, d):
    return fx.read(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_custkey").alias("place"))


@query(f"WITH {SEQ}, {_LIST} SELECT place, name, seq FROM seq JOIN lst USING (name)")
def fa_order(spark, d):
    return sequences.ordered(fx.sequences(spark, d).select("name", "seq"), _listed(spark, d)).select("place", "name", "seq")


@query(f"WITH {SEQ}, {_LIST} SELECT name FROM seq WHERE name IN (SELECT name FROM lst)")
def fa_some(spark, d):
    return fx.sequences(spark, d).join(_listed(spark, d), "name", "leftsemi").select("name")


@query(f"WITH {SEQ}, {_LIST} SELECT name FROM seq WHERE name NOT IN (SELECT name FROM lst)")
def fa_some_invert(spark, d):
    return fx.sequences(spark, d).join(_listed(spark, d), "name", "leftanti").select("name")


_RANGES = "rg AS (SELECT 'd' || (l_partkey % (SELECT count(*) FROM documents)) AS name, l_linenumber * 10 AS s, l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS e, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand FROM lineitem)"


def _ranges(spark, d):
    n = fx.read(spark, d, "documents").agg(F.count("*").alias("n"))
    rows = fx.read(spark, d, "lineitem").crossJoin(F.broadcast(n))  # one row
    return rows.select(F.concat(F.lit("d"), (F.col("l_partkey") % F.col("n")).cast("string")).alias("name"), (F.col("l_linenumber") * 10).cast("long").alias("s"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("long")).alias("e"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"))


@query(f"WITH {SEQ}, {_RANGES} SELECT name, CAST(s AS BIGINT) AS s, e, strand, CASE WHEN strand = '-' THEN {RC.format(x='substr(seq, s, e - s + 1)')} ELSE substr(seq, s, e - s + 1) END AS seq FROM rg JOIN seq USING (name)")
def fa_range(spark, d):
    return sequences.extract(fx.sequences(spark, d), _ranges(spark, d)).select("name", "s", "e", "strand", "seq")


@query(f"WITH {SEQ} SELECT 'RC_' || name AS name, {RC.format(x='seq')} AS seq FROM seq")
def fa_rc(spark, d):
    return fx.sequences(spark, d).select(F.concat(F.lit("RC_"), "name").alias("name"), F.reverse(F.translate("seq", "ACGT", "TGCA")).alias("seq"))


@query(f"WITH {SEQ}, {_LIST} SELECT coalesce('c' || place, name) AS name, pos FROM seq LEFT JOIN lst USING (name)")
def fa_replace(spark, d):
    mapping = _listed(spark, d).select(F.col("name").alias("old"), F.concat(F.lit("c"), F.col("place").cast("string")).alias("new"))
    return sequences.replaced(fx.sequences(spark, d), mapping).select("name", "pos")


_CODE = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in seqs.CODONS.items()) + "}"


@query(f"""WITH {SEQ}, st AS (SELECT name, length(seq) AS n, '+' AS strand, seq FROM seq UNION ALL SELECT name, length(seq), '-', {RC.format(x='seq')} FROM seq),
fr AS (SELECT name, n, strand, seq, unnest([0, 1, 2]) AS frame FROM st),
ac AS (SELECT name, n, strand, frame, array_to_string(list_transform(range(0, (n - frame) // 3), lambda i: coalesce({_CODE}[substr(seq, i * 3 + frame + 1, 3)], 'X')), '') AS aa FROM fr WHERE n - frame >= 3),
ru AS (SELECT name, n, strand, frame, regexp_extract_all(aa, '(X*[^X*][^*]*\\*?|X+\\*?|\\*)') AS runs FROM ac),
ex AS (SELECT name, n, strand, frame, unnest(runs) AS run, unnest(range(1, len(runs) + 1)) AS i FROM ru),
pl AS (SELECT *, sum(length(run)) OVER (PARTITION BY name, strand, frame ORDER BY i) AS stop, regexp_replace(run, '^X+', '') AS aa FROM ex),
z AS (SELECT *, stop - length(aa) AS start FROM pl WHERE length(aa) >= 30)
SELECT name, strand, frame, CAST(CASE WHEN strand = '+' THEN frame + 3 * start + 1 ELSE n - frame - 3 * stop + 1 END AS BIGINT) AS s, CAST(CASE WHEN strand = '+' THEN frame + 3 * stop ELSE n - frame - 3 * start END AS BIGINT) AS e, aa FROM z""")
def fa_six_frame(spark, d):
    return sequences.orfs(fx.sequences(spark, d), 30)


@query(f"WITH {SEQ}, w AS (SELECT name, seq, unnest(range(0, length(seq), 100)) AS off FROM seq WHERE length(seq) > 0) SELECT name, off + 1 AS s, CAST(least(off + 200, length(seq)) AS BIGINT) AS e, substr(seq, off + 1, 200) AS seq FROM w WHERE length(translate(substr(seq, off + 1, 200), 'Nn', '')) > 0")
def fa_window(spark, d):
    return sequences.windows(fx.sequences(spark, d), 200, 100)


@query(f"WITH {SEQ}, g AS (SELECT name, pos, sum(length(seq)) OVER (ORDER BY pos) - length(seq) AS before FROM seq) SELECT name, CAST(before // 100000 AS BIGINT) AS part FROM g")
def fa_split(spark, d):
    """Parts of about 100,000 bases in order: sums of ranges of pos first, then within each range."""
    from pyspark.sql import Window

    s = fx.sequences(spark, d).select("name", "pos", F.length("seq").cast("long").alias("n"), F.floor(F.col("pos") / 4096).alias("tile"))
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tiles = s.groupBy("tile").agg(F.sum("n").alias("t")).select("tile", F.coalesce(F.sum("t").over(past(Window.orderBy("tile"))), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("n").over(past(Window.partitionBy("tile").orderBy("pos"))), F.lit(0))
    return s.withColumn("inner", inner).join(tiles, "tile").select("name", F.floor((F.col("base") + F.col("inner")) / 100000).cast("long").alias("part"))


@query(f"""WITH {SEQ_CASE}, x AS (SELECT name, regexp_extract_all(seq, '([a-zN]+)', 1) AS runs, regexp_split_to_array(seq, '[a-zN]+') AS rest FROM seq),
y AS (SELECT name, unnest(runs) AS run, unnest(rest[1:len(runs)]) AS before, unnest(range(1, len(runs) + 1)) AS i FROM x), z AS (SELECT name, run, sum(length(run) + length(before)) OVER (PARTITION BY name ORDER BY i) AS e FROM y)
SELECT name, CAST(e - length(run) + 1 AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM z""")
def fa_masked(spark, d):
    return sequences.masked(fx.sequences(spark, d, keep_case=True))


@query(f"WITH {SEQ} SELECT name, CASE WHEN length(seq) >= 40 THEN substr(seq, 1, 9) || lower(substr(seq, 10, 11)) || substr(seq, 21, 9) || lower(substr(seq, 30, 11)) || substr(seq, 41) ELSE seq END AS seq FROM (SELECT name, translate(seq, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖÙÚÛÜÝÞŸŒ', 'àáâãäåæçèéêëìíîïðñòóôõöùúûüýþÿœ') AS seq FROM seq)")
def fa_mask(spark, d):
    """Soft masks of 10-20 and 30-40 of every sequence that is long enough."""
    s = fx.sequences(spark, d).withColumn("seq", F.translate("seq", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖÙÚÛÜÝÞŸŒ", "àáâãäåæçèéêëìíîïðñòóôõöùúûüýþÿœ"))
    spans = s.filter(F.length("seq") >= 40).select("name", F.explode(F.array(F.struct(F.lit(10).alias("s"), F.lit(20).alias("e")), F.struct(F.lit(30).alias("s"), F.lit(40).alias("e")))).alias("x")).select("name", "x.s", "x.e")
    return sequences.mask(s, spans).select("name", "seq")


# --- 2bit -------------------------------------------------------------------------------------
_TWO = SEQ_CASE.replace("seq AS (", "seq1 AS (") + ", seq AS (SELECT pos, name, regexp_replace(regexp_replace(seq, '[^\\x00-\\x7F]', 'N', 'g'), '[^ACGTacgt]', 'N', 'g') AS seq FROM seq1)"


def _two(spark, d):
    s = fx.sequences(spark, d, keep_case=True)
    return s.withColumn("seq", F.regexp_replace("seq", r"[^\x00-\x7F]", "N"))


@query(f"WITH {_TWO} SELECT name, CAST(length(seq) AS BIGINT) AS len, CAST(4 * 4 + 8 * len(regexp_extract_all(seq, 'N+')) + 8 * len(regexp_extract_all(seq, '[acgt]+')) + (length(seq) + 3) // 4 AS BIGINT) AS bytes FROM seq")
def fa_to_2bit(spark, d):
    """Records of whole sequences: their lengths and sizes."""
    recs = twobit.records(_two(spark, d))
    return recs.select("name", F.conv(F.hex(F.concat(*[F.substring("record", i, 1) for i in (4, 3, 2, 1)])), 16, 10).cast("long").alias("len"), F.length("record").cast("long").alias("bytes"))


@query(f"WITH {_TWO} SELECT name, md5(seq) AS digest FROM seq")
def twobit_to_fa(spark, d):
    return twobit.sequences(twobit.records(_two(spark, d))).select("name", F.md5(F.col("seq").cast("binary")).alias("digest"))


@query(f"WITH {_TWO} SELECT name, CAST(length(seq) AS BIGINT) AS len, CAST(length(replace(seq, 'N', '')) AS BIGINT) AS solid FROM seq")
def twobit_size(spark, d):
    return twobit.sizes(twobit.records(_two(spark, d)))


@query(f"WITH {_TWO} SELECT name, md5(seq) AS digest FROM seq WHERE pos % 7 <> 0")
def twobit_some(spark, d):
    names = fx.sequences(spark, d).filter("pos % 7 = 0").select("name")
    recs = twobit.records(_two(spark, d)).join(names, "name", "leftanti")
    return twobit.sequences(recs).select("name", F.md5(F.col("seq").cast("binary")).alias("digest"))


@query(ORACLES["fa_masked"].replace(SEQ_CASE, _TWO))
def twobit_masked(spark, d):
    return twobit.masked(twobit.records(_two(spark, d)))


@query(f"WITH {_TWO}, r AS (SELECT name, CASE WHEN pos % 2 = 0 THEN '+' ELSE '-' END AS strand, substr(seq, 5, 46) AS part FROM seq WHERE length(seq) >= 50) SELECT name, strand, CASE WHEN strand = '-' THEN reverse(translate(part, 'ACGTacgt', 'TGCAtgca')) ELSE part END AS seq FROM r")
def twobit_range(spark, d):
    """Bases 5 to 50 of every sequence that is long enough, odd ones from the other strand; nothing else is unpacked."""
    s = fx.sequences(spark, d, keep_case=True).filter("length(seq) >= 50")
    ranges = s.select("name", F.lit(5).cast("long").alias("s"), F.lit(50).cast("long").alias("e"), F.when(F.col("pos") % 2 == 0, "+").otherwise("-").alias("strand"))
    return twobit.extract(twobit.records(_two(spark, d)), ranges).select("name", "strand", "seq")


# --- k-mers and distances ---------------------------------------------------------------------
def _kmer_sql(k, canonical=True):
    kmer = f"substr(seq, i, {k})"
    pick = f"least({kmer}, {RC.format(x=kmer)})" if canonical else kmer
    return f"km AS (SELECT name, i - 1 AS off, {pick} AS kmer FROM (SELECT name, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM seq) WHERE length(translate({kmer}, 'ACGT', '')) = 0)"


@query(f"WITH {SEQ}, {_kmer_sql(8)} SELECT kmer, count(*) AS n FROM km GROUP BY kmer")
def kmer_table(spark, d):
    return kmers.table(fx.sequences(spark, d), 8)


@query(f"WITH {SEQ}, {_kmer_sql(8)}, t AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer) SELECT CAST(least(n, 32767) AS BIGINT) AS depth, count(*) AS kmers FROM t GROUP BY 1")
def kmer_hist(spark, d):
    return kmers.histogram(kmers.packed(fx.sequences(spark, d), 8))


@query(f"WITH {SEQ}, {_kmer_sql(8)}, t AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer) SELECT CAST(length(kmer) - length(translate(kmer, 'GC', '')) AS BIGINT) AS gc, CAST(least(n, 100) AS BIGINT) AS depth, count(*) AS kmers FROM t GROUP BY ALL")
def kmer_gc(spark, d):
    return kmers.gc_matrix(kmers.table(fx.sequences(spark, d), 8), 100)


@query(f"WITH {SEQ}, {_kmer_sql(8)}, t AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer), a AS (SELECT name, unnest(range(0, length(seq) - 7)) AS off FROM seq) SELECT name, CAST(off AS BIGINT) AS off, CAST(least(coalesce(n, 0), 32767) AS BIGINT) AS n FROM a LEFT JOIN km USING (name, off) LEFT JOIN t USING (kmer)")
def kmer_profile(spark, d):
    s = fx.sequences(spark, d)
    return kmers.profile(s, kmers.table(s, 8), 8)


@query(f"WITH {SEQ}, {_kmer_sql(8)}, t AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer), h AS (SELECT n, count(*) AS k FROM t GROUP BY n), p AS (SELECT n FROM h WHERE n > 1 ORDER BY k * n DESC, n LIMIT 1) SELECT CAST((SELECT n FROM p) AS BIGINT) AS peak, CAST(sum(n * k) AS BIGINT) AS kmers, CAST(sum(n * k) // (SELECT n FROM p) AS BIGINT) AS size FROM h")
def kmer_gsize(spark, d):
    """Total k-mers over the count that holds most of them."""
    h = kmers.packed(fx.sequences(spark, d), 8).groupBy("n").agg(F.count("*").alias("k"))
    peak = h.filter("n > 1").orderBy(F.expr("k * n").desc(), "n").limit(1).select(F.col("n").alias("peak"))
    return h.agg(F.sum(F.expr("n * k")).alias("kmers")).crossJoin(peak).select("peak", F.col("kmers").cast("long").alias("kmers"), F.floor(F.col("kmers") / F.col("peak")).cast("long").alias("size"))


_HASH = "CAST(('0x' || substr(md5({x}), 1, 15)) AS BIGINT)"
_MASH = """tot AS (SELECT name, count(*) AS t FROM h GROUP BY name), sh AS (SELECT a.name AS n1, b.name AS n2, count(*) AS shared FROM h a JOIN h b ON a.h = b.h AND a.name < b.name GROUP BY ALL),
j AS (SELECT n1, n2, shared, x.t AS t1, shared / (x.t + y.t - shared) AS j FROM sh JOIN tot x ON x.name = n1 JOIN tot y ON y.name = n2)
SELECT n1, n2, shared, round(j, 4) AS jaccard, round(shared / t1, 4) AS containment, round(greatest(least(1.0, -ln(2 * j / (1 + j)) / {k}), 0.0) + 0.0, 4) AS mash FROM j"""


@query(f"WITH {SEQ}, h AS (SELECT DISTINCT name, {_HASH.format(x='substr(seq, i, 21)')} AS h FROM (SELECT name, seq, unnest(range(1, length(seq) - 19)) AS i FROM seq)), " + _MASH.format(k=21))
def dist_mini(spark, d):
    return kmers.similarity(kmers.minimizers(fx.sequences(spark, d), 21), 21)


@query(f"WITH {SOLID}, {_kmer_sql(21)}, h0 AS (SELECT DISTINCT name, {_HASH.format(x='kmer')} AS h FROM km), h AS (SELECT * FROM h0 WHERE h < {(1 << 60) // 10}), " + _MASH.format(k=21))
def dist_frac(spark, d):
    return kmers.similarity(kmers.hashed(fx.sequences(spark, d, solid=True), 21, (1 << 60) // 10), 21)


@query(f"WITH {SOLID}, {_kmer_sql(21)}, h0 AS (SELECT DISTINCT name, {_HASH.format(x='kmer')} AS h FROM km) SELECT name, h, CAST(rank AS INTEGER) AS rank FROM (SELECT name, h, row_number() OVER (PARTITION BY name ORDER BY h) AS rank FROM h0) WHERE rank <= 100")
def dist_mash_sketch(spark, d):
    s = kmers.sketches(fx.sequences(spark, d, solid=True), 21, 100)
    return s.select("name", F.posexplode("hs").alias("_i", "h")).select("name", "h", (F.col("_i") + 1).alias("rank"))


@query(f"""WITH {SEQ}, s AS (SELECT name, i - 1 AS off, {_HASH.format(x='substr(seq, i, 8)')} AS h FROM (SELECT name, seq, unnest(range(1, length(seq) - 6)) AS i FROM seq)),
w AS (SELECT name, off, h, min(h) OVER (PARTITION BY name ORDER BY off ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS m, lead(h, 4) OVER (PARTITION BY name ORDER BY off) AS l FROM s)
SELECT DISTINCT name, CAST(CASE WHEN h = m THEN off ELSE off + 4 END AS BIGINT) AS off, m AS h FROM w WHERE l IS NOT NULL AND (h = m OR l = m)""")
def pgi_build(spark, d):
    return kmers.syncmers(fx.sequences(spark, d), 8, 5)


@query(ORACLES["pgi_build"].replace("SELECT DISTINCT name, CAST(CASE", "SELECT CAST(count(DISTINCT name) AS BIGINT) AS contigs, count(DISTINCT m) AS keys, count(*) AS positions FROM (SELECT DISTINCT name, m, CAST(CASE").replace(" AS off, m AS h FROM w", " AS off FROM w") + ")")
def pgi_stat(spark, d):
    return kmers.syncmers(fx.sequences(spark, d), 8, 5).agg(F.countDistinct("name").alias("contigs"), F.countDistinct("h").alias("keys"), F.count("*").alias("positions"))


@query(f"WITH {SOLID}, {_kmer_sql(17)}, c AS (SELECT kmer FROM km GROUP BY kmer HAVING count(*) >= 3), m AS (SELECT name, off + 1 AS s, off + 17 AS e FROM km JOIN c USING (kmer)), {sql_islands('a', 'm', 'name', 11)}, b AS (SELECT * FROM a WHERE e - s + 1 >= 50), {sql_islands('z', 'b', 'name', 11)} SELECT name, s, e FROM z")
def rept_s_kmer(spark, d):
    """Repeated k-mers as runs: union with fill, excise, fill."""
    r = kmers.repeats(fx.sequences(spark, d, solid=True), 17, 3, gap=10)
    return intervals.span(intervals.span(intervals.span(r, ["name"], "fill", 10), ["name"], "excise", 50), ["name"], "fill", 10)


@query(f"WITH {SOLID}, {_kmer_sql(10, False)}, c AS (SELECT kmer FROM km GROUP BY kmer HAVING count(DISTINCT name) >= 2), m AS (SELECT name, off + 1 AS s, off + 10 AS e FROM km JOIN c USING (kmer)), {sql_islands('a', 'm', 'name', 51)} SELECT name, s, e FROM a WHERE e - s + 1 >= 100")
def sd_decompose_runs(spark, d):
    runs = kmers.shared_runs(fx.sequences(spark, d, solid=True), 10)
    return intervals.span(intervals.islands(runs, ["name"], 51), ["name"], "excise", 100)


# --- alignments -------------------------------------------------------------------------------
_RATE = "(match + rep) / (match + mismatch + rep + n) AS ident, (match + mismatch + rep + n) / q_size AS q_cover, (match + mismatch + rep + n) / t_size AS t_cover, rep / (match + rep) AS rep_match"
_SUMS = ", ".join(f"round({f}({c}), 4) AS {c}_{n}" for c in ("ident", "q_cover", "t_cover", "rep_match") for n, f in (("min", "min"), ("max", "max"), ("mean", "avg")))


@query(f"WITH {PSL}, r AS (SELECT *, {_RATE} FROM psl) SELECT q_name, count(*) AS aligns, CAST(sum(q_size) AS BIGINT) AS total_q_size, {_SUMS} FROM r GROUP BY q_name")
def psl_stats_query(spark, d):
    return alignments.psl_query_stats(fx.psl(spark, d))


@query(f"WITH {PSL}, r AS (SELECT *, {_RATE}, count(*) OVER (PARTITION BY q_name) AS k FROM psl) SELECT count(DISTINCT q_name) AS queries, count(*) AS aligns, count(DISTINCT CASE WHEN k = 1 THEN q_name END) AS aligned1, count(DISTINCT CASE WHEN k > 1 THEN q_name END) AS aligned_n, {_SUMS} FROM r")
def psl_stats_overall(spark, d):
    return alignments.psl_overall_stats(fx.psl(spark, d))


@query(f"WITH {PSL}, r AS (SELECT q_name, (match + mismatch + rep) / q_size AS c, (match + rep) / (match + mismatch + rep) AS i FROM psl) SELECT q_name, count(*) AS aligns, round(max(c) - min(c), 4) AS cover_spread, round(max(i) - min(i), 4) AS ident_spread FROM r GROUP BY q_name HAVING count(*) > 1")
def psl_histo(spark, d):
    return alignments.psl_spread(fx.psl(spark, d), multi_only=True)


_QS = "CASE WHEN strand = '-' THEN q_size - q_end ELSE q_start END"


@query(f"WITH {PSL}, b AS (SELECT q_name, strand, q_size, unnest([{_QS}, {_QS} + b1 + ln * 3]) AS a, unnest([b1, al - b1]) AS n FROM psl) SELECT q_name AS chr, strand, CASE WHEN strand = '-' THEN q_size - a - n ELSE a END + 1 AS s, CASE WHEN strand = '-' THEN q_size - a ELSE a + n END AS e FROM b")
def psl_to_rg(spark, d):
    return alignments.psl_blocks(fx.psl(spark, d))


@query(f"WITH {PSL}, b AS (SELECT t_name, unnest([t_start, t_start + b1 + 5]) AS a, unnest([b1, al - b1]) AS n FROM psl) SELECT t_name AS chr, '+' AS strand, a + 1 AS s, a + n AS e FROM b")
def psl_to_rg_target(spark, d):
    return alignments.psl_blocks(fx.psl(spark, d), target=True)


@query(f"WITH {PSL} SELECT q_name, CAST(q_size AS BIGINT) AS q_len, q_start, q_end, strand, t_name, CAST(t_size AS BIGINT) AS t_len, t_start, t_end, match + rep AS matches, al AS block_len, 255 AS mapq FROM psl")
def psl_to_paf(spark, d):
    return alignments.psl_to_paf(fx.psl(spark, d))


_SWAP = "t_name AS q_name, t_start AS q_start, t_end AS q_end, q_name AS t_name, q_start AS t_start, q_end AS t_end, strand"


@query(f"WITH {PSL} SELECT {_SWAP}, CASE WHEN strand = '-' THEN (al - b1) || ',' || b1 ELSE b1 || ',' || (al - b1) END AS sizes, CASE WHEN strand = '-' THEN (t_size - t_end) || ',' || (t_size - t_start - b1) ELSE t_start || ',' || (t_start + b1 + 5) END AS q_starts, CASE WHEN strand = '-' THEN q_start || ',' || (q_end - b1) ELSE q_start || ',' || (q_start + b1 + ln * 3) END AS t_starts FROM psl")
def psl_swap(spark, d):
    out = alignments.psl_swap(fx.psl(spark, d))
    return out.select("q_name", "q_start", "q_end", "t_name", "t_start", "t_end", "strand", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(n) for c, n in (("block_sizes", "sizes"), ("q_starts", "q_starts"), ("t_starts", "t_starts"))])


@query(f"WITH {PSL} SELECT q_name, t_name, q_start, t_start, CASE WHEN strand = '-' THEN '+-' ELSE '--' END AS strand, (al - b1) || ',' || b1 AS sizes, (t_size - t_end) || ',' || (t_size - t_start - b1) AS t_starts FROM psl")
def psl_rc(spark, d):
    out = alignments.psl_rc(fx.psl(spark, d))
    return out.select("q_name", "t_name", "q_start", "t_start", "strand", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(n) for c, n in (("block_sizes", "sizes"), ("t_starts", "t_starts"))])


@query(f"WITH {PSL} SELECT match + rep // 2 - mismatch - 2 AS score, t_name, t_start, t_end, q_name, strand AS q_strand, q_start, q_end, b1 || ':5:' || (ln * 3) || ',' || (al - b1) || ':0:0' AS blocks FROM psl")
def psl_to_chain(spark, d):
    text = F.array_join(F.transform("blocks", lambda b: F.concat_ws(":", b["size"].cast("string"), b["dt"].cast("string"), b["dq"].cast("string"))), ",")
    return alignments.psl_to_chain(fx.psl(spark, d)).select(F.col("score").cast("long").alias("score"), "t_name", "t_start", "t_end", "q_name", "q_strand", "q_start", "q_end", text.alias("blocks"))


@query(f"WITH {PSL} SELECT t_name, q_name, q_start + CASE WHEN l_orderkey % 2 = 0 THEN 499 ELSE 0 END AS q_start, q_end + CASE WHEN l_orderkey % 2 = 0 THEN 499 ELSE 0 END AS q_end, CAST(CASE WHEN l_orderkey % 2 = 0 THEN 50000 ELSE q_size END AS BIGINT) AS q_size, {_QS} + CASE WHEN l_orderkey % 2 = 1 THEN 0 WHEN strand = '-' THEN 50000 - 499 - q_size ELSE 499 END AS first_start FROM psl")
def psl_lift(spark, d):
    p = fx.psl(spark, d)
    known = p.select(F.col("q_name").alias("name"), F.lit(50000).cast("long").alias("len")).distinct()
    named = p.withColumn("q_name", F.when(F.col("l_orderkey") % 2 == 0, F.concat("q_name", F.lit(":500-20499"))).otherwise(F.col("q_name")))
    return alignments.psl_lift(named, known).select("t_name", "q_name", "q_start", "q_end", "q_size", F.element_at("q_starts", 1).alias("first_start"))


_PSPAN = f"WITH {PAF}, sp AS (SELECT t_name, t_start AS s, CASE WHEN cg = '' THEN t_end ELSE t_start + CASE WHEN cg LIKE '%Q' THEN 0 ELSE b1 + 5 + eq_len + mismatch END END - 1 AS e FROM paf)"


@query(f"{_PSPAN}, sq AS (SELECT * FROM sp WHERE s <= e), {sql_depth('z', 'sq', 't_name')} SELECT t_name, s, e + 1 AS e, depth FROM z WHERE depth >= 2")
def paf_coverage(spark, d):
    return alignments.paf_coverage(fx.paf(spark, d), 2)


@query(f"WITH {PAF}, f AS (SELECT *, cg <> '' AND cg NOT LIKE '%Q' AS fine FROM paf) SELECT count(*) AS total, count(*) FILTER (fine AND q_start + b1 + gi_len + eq_len + mismatch <> q_end) AS query_invalid, count(*) FILTER (fine AND t_start + b1 + 5 + eq_len + mismatch <> t_end) AS target_invalid, count(*) FILTER (cg = '') AS missing, count(*) FILTER (cg LIKE '%Q') AS malformed FROM f")
def paf_validate(spark, d):
    return alignments.paf_validate(fx.paf(spark, d))


@query(f"WITH {PAF} SELECT q_name, t_name, q_start, round((b1 + eq_len) / (b1 + eq_len + mismatch + 2), 6) AS gi, round((b1 + eq_len) / (b1 + eq_len + mismatch + gi_len + 5), 6) AS bi FROM paf WHERE cg <> '' AND cg NOT LIKE '%Q'")
def paf_identity(spark, d):
    return alignments.paf_identity(fx.paf(spark, d).filter("cg <> '' AND NOT cg LIKE '%Q'")).select("q_name", "t_name", "q_start", "gi", "bi")


_PQ = f"""WITH {PAF}, rg AS (SELECT 't' || p_partkey AS t_name, CAST(p_size * 20 AS BIGINT) AS s, CAST(p_size * 20 + 300 AS BIGINT) AS e FROM part WHERE p_partkey % 3 = 0),
j AS (SELECT paf.*, s, e, t_start + b1 AS ti, t_start + b1 + 5 AS td, t_start + b1 + 5 + eq_len + mismatch AS tx FROM paf JOIN rg ON paf.t_name = rg.t_name AND t_start < e AND s < t_end WHERE cg <> '' AND cg NOT LIKE '%Q' AND (b1 + eq_len) / (b1 + eq_len + mismatch + 2) >= 0.8),
k AS (SELECT *, greatest(s, t_start) < least(e, ti) AS m, ti >= s AND ti < e AS i, greatest(s, ti) < least(e, td) AS dl, greatest(s, td) < least(e, tx) AS x FROM j),
l AS (SELECT *, list_min([CASE WHEN m THEN greatest(s, t_start) - t_start END, CASE WHEN i THEN b1 END, CASE WHEN x THEN b1 + gi_len + greatest(s, td) - td END]) AS lo, list_max([CASE WHEN m THEN least(e, ti) - t_start END, CASE WHEN i THEN b1 + gi_len END, CASE WHEN x THEN b1 + gi_len + least(e, tx) - td END]) AS hi,
  list_min([CASE WHEN m THEN greatest(s, t_start) END, CASE WHEN dl THEN greatest(s, ti) END, CASE WHEN x THEN greatest(s, td) END]) AS t_from, list_max([CASE WHEN m THEN least(e, ti) END, CASE WHEN dl THEN least(e, td) END, CASE WHEN x THEN least(e, tx) END]) AS t_to FROM k),
z AS (SELECT t_name, t_from, t_to, q_name, strand, CASE WHEN strand = '-' THEN q_end - hi ELSE q_start + lo END AS q_from, CASE WHEN strand = '-' THEN q_end - lo ELSE q_start + hi END AS q_to FROM l WHERE lo < hi AND t_from < t_to)"""


def _paf_query(spark, d):
    regions = fx.read(spark, d, "part").filter("p_partkey % 3 = 0").select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("t_name"), (F.col("p_size") * 20).cast("long").alias("s"), (F.col("p_size") * 20 + 300).cast("long").alias("e"))
    return alignments.paf_query(fx.paf(spark, d), regions, 0.8, 20)


@query(f"{_PQ} SELECT * FROM z WHERE q_to - q_from >= 20")
def paf_query(spark, d):
    return _paf_query(spark, d)


@query(f"{_PQ} SELECT q_name AS chrom, q_from AS s, q_to AS e FROM z WHERE q_to - q_from >= 20")
def paf_to_bed(spark, d):
    return _paf_query(spark, d).select(F.col("q_name").alias("chrom"), F.col("q_from").alias("s"), F.col("q_to").alias("e"))


@query(f"WITH {PAF}, e AS (SELECT q_name AS node, t_name AS other FROM paf UNION ALL SELECT t_name, q_name FROM paf), g AS (SELECT node, count(DISTINCT other) AS degree, count(*) AS links FROM e GROUP BY node) SELECT count(*) AS nodes, CAST(sum(links) / 2 AS BIGINT) AS links, max(degree) AS max_degree, count(*) FILTER (degree = 1) AS tips, round(avg(degree), 4) AS mean_degree, median(degree) AS median_degree FROM g")
def paf_stat(spark, d):
    p = fx.paf(spark, d)
    e = p.select(F.col("q_name").alias("node"), F.col("t_name").alias("other")).union(p.select("t_name", "q_name"))
    g = e.groupBy("node").agg(F.countDistinct("other").alias("degree"), F.count("*").alias("links"))
    return g.agg(F.count("*").alias("nodes"), (F.sum("links") / 2).cast("long").alias("links"), F.max("degree").alias("max_degree"), F.sum((F.col("degree") == 1).cast("long")).alias("tips"), F.round(F.avg("degree"), 4).alias("mean_degree"), F.median("degree").alias("median_degree"))


@query(f"WITH {PSL} SELECT q_name, t_name, q_start, t_start, match + rep // 2 - mismatch - 2 AS score FROM psl")
def psl_score(spark, d):
    return fx.psl(spark, d).select("q_name", "t_name", "q_start", "t_start", alignments.psl_score().cast("long").alias("score"))


@query(f"WITH {PSL} SELECT q_name, t_name, q_start, t_start FROM psl WHERE al >= 300 AND (match + rep) / al >= 0.96")
def sd_search_filter(spark, d):
    aligned = F.col("match") + F.col("mismatch") + F.col("rep") + F.col("n")
    return fx.psl(spark, d).filter((aligned >= 300) & ((F.col("match") + F.col("rep")) / aligned >= 0.96)).select("q_name", "t_name", "q_start", "t_start")


@query(f"WITH {PSL}, c AS (SELECT t_name, q_name, t_start, match + rep // 2 - mismatch - 2 AS score FROM psl) SELECT t_name, q_name, t_start, score, row_number() OVER (PARTITION BY t_name ORDER BY score DESC, q_name, t_start) AS place FROM c")
def chain_sort(spark, d):
    from pyspark.sql import Window

    c = alignments.psl_to_chain(fx.psl(spark, d)).withColumn("score", F.col("score").cast("long"))
    w = Window.partitionBy("t_name").orderBy(F.desc("score"), "q_name", "t_start")
    return c.select("t_name", "q_name", "t_start", "score", F.row_number().over(w).cast("long").alias("place"))


@query(f"WITH {PSL} SELECT t_name, q_name, strand, count(*) AS fragments, CAST(sum(match + rep // 2 - mismatch - 2) AS BIGINT) AS score, min(t_start) AS t_start, max(t_end) AS t_end, CAST(sum(al) AS BIGINT) AS bases FROM psl GROUP BY ALL")
def chain_stitch(spark, d):
    c = alignments.psl_to_chain(fx.psl(spark, d))
    size = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b["size"])
    return c.groupBy("t_name", "q_name", F.col("q_strand").alias("strand")).agg(F.count("*").alias("fragments"), F.sum("score").cast("long").alias("score"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.sum(size).alias("bases"))


@query(f"WITH {PSL}, w AS (SELECT t_name, q_name, strand, t_start, t_end, lead(t_start) OVER (PARTITION BY t_name, q_name, strand ORDER BY t_start, q_start, t_end, q_end) AS t_next, lead(q_start) OVER (PARTITION BY t_name, q_name, strand ORDER BY t_start, q_start, t_end, q_end) AS q_next, q_end FROM psl) SELECT t_name, q_name, strand, t_end AS t_from, t_next AS t_to, q_end AS q_from, q_next AS q_to FROM w WHERE t_next - t_end BETWEEN 10 AND 5000 AND q_next - q_end BETWEEN 10 AND 5000")
def align_fill_gaps(spark, d):
    """Gaps between neighbouring anchors of a pair and strand that are open on both sides."""
    from pyspark.sql import Window

    w = Window.partitionBy("t_name", "q_name", "strand").orderBy("t_start", "q_start", "t_end", "q_end")
    x = fx.psl(spark, d).withColumns({"t_next": F.lead("t_start").over(w), "q_next": F.lead("q_start").over(w)})
    x = x.filter((F.col("t_next") - F.col("t_end")).between(10, 5000) & (F.col("q_next") - F.col("q_end")).between(10, 5000))
    return x.select("t_name", "q_name", "strand", F.col("t_end").alias("t_from"), F.col("t_next").alias("t_to"), F.col("q_end").alias("q_from"), F.col("q_next").alias("q_to"))


# --- blocks -----------------------------------------------------------------------------------
_FINE = "len(list_filter(bases, lambda x: x NOT IN ('A', 'C', 'G', 'T'))) = 0"


@query(f"""WITH {BLOCKS}, c AS (SELECT *, list_contains(bases, '-') AS gap, {_FINE} AS fine, len(bases) AS n, list_sum(list_transform(['A', 'C', 'G', 'T'], lambda b: len(list_filter(bases, lambda x: x = b)) * (len(list_filter(bases, lambda x: x = b)) - 1) / 2)) AS same FROM cols)
SELECT block_id, count(*) AS length, count(*) FILTER (fine) AS comparable, count(*) FILTER (fine AND len(list_distinct(bases)) > 1) AS difference, count(*) FILTER (gap) AS gap, count(*) FILTER (NOT gap AND NOT fine) AS ambiguous,
CASE WHEN count(*) FILTER (fine) > 0 THEN floor(sum(CASE WHEN fine THEN n * (n - 1) / 2 - same ELSE 0 END) / max(n * (n - 1) / 2) / count(*) FILTER (fine) * 1000 + 1e-9) / 1000 END AS d FROM c GROUP BY block_id""")
def fas_stat(spark, d):
    b = fx.blocks(spark, d)
    many = b.groupBy("block_id").count().filter("count > 1").select("block_id")
    return blocks.stats(b.join(many, "block_id", "leftsemi"))


ORACLES["fas_stat"] = ORACLES["fas_stat"].replace(" FROM c GROUP BY block_id", " FROM c WHERE n > 1 GROUP BY block_id")


@query(f"""WITH {BLOCKS}, c AS (SELECT block_id, pos, bases, list_distinct(bases) AS kinds FROM cols WHERE {_FINE}), v AS (SELECT *, bases[1] AS t, len(list_filter(bases, lambda x: x <> bases[1])) AS other FROM c WHERE len(kinds) > 1)
SELECT block_id, pos, t AS tbase, CASE WHEN len(kinds) = 2 THEN list_filter(kinds, lambda x: x <> t)[1] ELSE 'C' END AS qbase, array_to_string(bases, '') AS bases, CAST(CASE WHEN len(kinds) = 2 THEN least(other, len(bases) - other) ELSE -1 END AS BIGINT) AS freq, CASE WHEN len(kinds) = 2 THEN array_to_string(list_transform(bases, lambda x: CASE WHEN x = t THEN '1' ELSE '0' END), '') ELSE 'unknown' END AS pattern FROM v""")
def fas_variation(spark, d):
    return blocks.substitutions(fx.blocks(spark, d))


@query(f"""WITH {BLOCKS}, v AS (SELECT block_id, pos, bases, list_concat([bases[1]], list_filter(CASE WHEN len(bases) < 2 THEN [] WHEN bases[2] = bases[1] THEN bases[3:3] WHEN len(bases) > 2 AND bases[3] <> bases[2] THEN bases[2:3] ELSE bases[2:2] END, lambda x: x <> bases[1])) AS kinds FROM cols WHERE {_FINE})
SELECT block_id, pos, kinds[1] AS ref, array_to_string(kinds[2:], ',') AS alt, array_to_string(list_transform(bases[2:], lambda x: CAST(list_position(kinds, x) - 1 AS VARCHAR)), ',') AS gt FROM v WHERE len(kinds) > 1""")
def fas_to_vcf(spark, d):
    return blocks.vcf(fx.blocks(spark, d))


_PAIRS = f"{BLOCKS}, pd AS (SELECT a.block_id, a.idx AS i, b.idx AS j, list_filter(list_transform(range(1, 61), lambda p: substr(a.seq, p, 1) || substr(b.seq, p, 1)), lambda x: length(translate(x, 'ACGT', '')) = 0) AS p FROM blocks a JOIN blocks b ON a.block_id = b.block_id AND a.idx < b.idx), dd AS (SELECT block_id, i, j, CAST(len(p) AS BIGINT) AS comparable, CASE WHEN len(p) > 0 THEN round(len(list_filter(p, lambda x: substr(x, 1, 1) <> substr(x, 2, 1))) / len(p), 4) END AS d FROM pd)"


@query(f"WITH {_PAIRS} SELECT * FROM dd")
def fas_link_pair(spark, d):
    return blocks.pair_distances(fx.blocks(spark, d))


@query(f"WITH {_PAIRS}, e AS (SELECT block_id, i, j, d FROM dd WHERE d IS NOT NULL UNION ALL SELECT block_id, j, i, d FROM dd WHERE d IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY block_id, i ORDER BY d, j) AS r FROM e) SELECT DISTINCT block_id, least(i, j) AS a, greatest(i, j) AS b FROM n WHERE r = 1")
def fas_link_best(spark, d):
    return blocks.best_links(fx.blocks(spark, d))


@query(f"WITH {BLOCKS} SELECT name, count(*) AS n FROM blocks GROUP BY name")
def fas_name(spark, d):
    return blocks.names(fx.blocks(spark, d))


@query(f"WITH {BLOCKS}, w AS (SELECT * FROM blocks WHERE name IN ('sp0', 'sp2')) SELECT block_id, name, seq FROM w WHERE block_id IN (SELECT block_id FROM w GROUP BY block_id HAVING count(DISTINCT name) = 2)")
def fas_subset(spark, d):
    return blocks.subset(fx.blocks(spark, d), ["sp0", "sp2"], strict=True).select("block_id", "name", "seq")


@query(f"WITH {BLOCKS}, g AS (SELECT DISTINCT block_id, unnest(['sp0', 'sp1', 'sp2']) AS name FROM blocks) SELECT name, md5(string_agg(coalesce(seq, repeat('-', 60)), '' ORDER BY block_id)) AS digest FROM g LEFT JOIN blocks USING (block_id, name) GROUP BY name")
def fas_concat(spark, d):
    return blocks.concat(fx.blocks(spark, d), ["sp0", "sp1", "sp2"]).select("name", F.md5(F.col("seq").cast("binary")).alias("digest"))


@query(f"WITH {BLOCKS} SELECT block_id, idx, seq FROM blocks WHERE block_id IN (SELECT block_id FROM blocks WHERE idx = 0 AND length(replace(seq, '-', '')) BETWEEN 20 AND 60)")
def fas_filter(spark, d):
    return blocks.filtered(fx.blocks(spark, d), 20, 60).select("block_id", "idx", "seq")


@query(f"WITH {BLOCKS} SELECT name, block_id, replace(seq, '-', '') AS seq FROM blocks")
def fas_separate(spark, d):
    return blocks.separated(fx.blocks(spark, d))


@query(f"WITH {BLOCKS}, r AS (SELECT name, CAST(split_part(block_id, '.', 1) AS BIGINT) AS chr, CAST(split_part(block_id, '.', 2) AS BIGINT) * 60 + 1 AS s, CAST(split_part(block_id, '.', 2) AS BIGINT) * 60 + length(replace(seq, '-', '')) AS e FROM blocks), {sql_islands('z', 'r', 'name, chr')} SELECT name, chr, s, e FROM z")
def fas_cover(spark, d):
    part = lambda i: F.split_part("block_id", F.lit("."), F.lit(i)).cast("long")
    b = fx.blocks(spark, d).select("name", part(1).alias("chr"), (part(2) * 60 + 1).alias("s"), (part(2) * 60 + F.length(F.translate("seq", "-", ""))).alias("e"))
    return intervals.islands(b, ["name", "chr"])


@query(f"WITH {BLOCKS}, s AS (SELECT 'd' || pos AS name, pos, seq FROM seq) SELECT block_id, idx, CASE WHEN s.seq IS NOT NULL AND substr(s.seq, CAST(split_part(block_id, '.', 2) AS BIGINT) * 60 + 1, length(replace(b.seq, '-', ''))) = replace(b.seq, '-', '') THEN 'OK' ELSE 'FAILED' END AS status FROM blocks b LEFT JOIN s ON s.pos = CAST(split_part(block_id, '.', 1) AS BIGINT) * 3 + idx")
def fas_check(spark, d):
    part = lambda i: F.split_part("block_id", F.lit("."), F.lit(i)).cast("long")
    own = F.translate("seq", "-", "")
    b = fx.blocks(spark, d).select("block_id", "idx", (part(1) * 3 + F.col("idx")).alias("pos"), (part(2) * 60 + 1).cast("int").alias("at"), own.alias("own"))
    ok = F.substring("seq", F.col("at"), F.length("own")) == F.col("own")
    return b.join(fx.sequences(spark, d).select("pos", "seq"), "pos", "left").select("block_id", "idx", F.when(ok, "OK").otherwise("FAILED").alias("status"))


# --- graphs and vectors -----------------------------------------------------------------------
@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), l AS (SELECT p_partkey AS src, (p_partkey * 7 + 3) % n.n AS dst FROM part, n UNION ALL SELECT p_partkey, (p_partkey * 5 + 1) % n.n FROM part, n),
r(node, hops) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey % 100 = 0 UNION SELECT l.dst, r.hops + 1 FROM r JOIN l ON r.node = l.src WHERE r.hops < 4) SELECT node, min(hops) AS hops FROM r GROUP BY node""")
def paf_query_transitive(spark, d):
    """Bounded closure over forward links."""
    part = fx.read(spark, d, "part")
    keyed = part.crossJoin(F.broadcast(part.agg(F.count("*").alias("n"))))  # one row
    links = keyed.select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + 3) % F.col("n")).alias("dst")).union(keyed.select("p_partkey", (F.col("p_partkey") * 5 + 1) % F.col("n")))
    return graphs.closure(links, part.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("node")), 4)


@query(f"""WITH RECURSIVE {IV}, {sql_islands('r', 'iv', 'chr')}, t AS (SELECT chr, s // 400 AS tile, count(*) AS n FROM r GROUP BY ALL), l AS (SELECT a.chr || ':' || a.tile AS a, b.chr || ':' || b.tile AS b FROM t a JOIN t b ON a.chr = b.chr AND a.tile = b.tile - 1),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), w(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, w.root FROM w JOIN e ON w.node = e.a) SELECT node, min(root) AS component FROM w GROUP BY node""")
def sd_cluster(spark, d):
    t = intervals.islands(fx.intervals(spark, d), ["chr"]).select("chr", F.floor(F.col("s") / 400).alias("tile")).distinct()
    name = lambda c: F.concat_ws(":", "chr", F.col(c).cast("string"))
    links = t.join(t.withColumnRenamed("tile", "after"), "chr").filter("tile = after - 1").select(name("tile").alias("a"), name("after").alias("b"))
    return graphs.components(links)


ORACLES["sd_cluster"] = ORACLES["sd_cluster"].replace("s // 400", "CAST(floor(s / 400) AS BIGINT)")


@query()
def sd_cover(spark, d):
    """Greedy set cover of parts by suppliers."""
    li = fx.read(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("set"), F.col("l_suppkey").alias("seq"), F.col("l_partkey").alias("item"))
    return graphs.greedy_cover(li)


@query("WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM c) SELECT source, round(sum(n) FILTER (k <= 2) / sum(n), 4) AS purity FROM r GROUP BY source")
def top_k_purity(spark, d):
    return graphs.top_share(fx.read(spark, d, "documents"), "source", "lang").select("source", F.round("purity", 4).alias("purity"))


_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * {b}[i]))"


@query(f"WITH p AS (SELECT q.vec_id AS query, v.vec_id AS id, round({_DOT.format(a='q.embedding', b='v.embedding')} / (sqrt({_DOT.format(a='q.embedding', b='q.embedding')}) * sqrt({_DOT.format(a='v.embedding', b='v.embedding')})), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM p) SELECT query, rank, id, score FROM r WHERE rank <= 5")
def vector_cosine_topk(spark, d):
    v = fx.vectors(spark, d).select("id", "vec")
    return vectors.nearest(v, v.filter("id % 100 = 0"), 5)


@query("WITH x AS (SELECT label, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS dim FROM embeddings) SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS value FROM x GROUP BY ALL")
def vector_centroids(spark, d):
    return vectors.centroids(fx.vectors(spark, d), "label", "vec").select("label", "dim", F.round("value", 6).alias("value"))


_PAIRV = "WITH p AS (SELECT a.vec_id AS id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


@query(f"{_PAIRV}, m AS (SELECT id, x, y, list_avg(x) AS mx, list_avg(y) AS my, list_sum(list_transform(range(1, len(x) + 1), lambda i: (CAST(x[i] AS DOUBLE) - y[i]) * (CAST(x[i] AS DOUBLE) - y[i]))) AS sq FROM p) SELECT id, round(sqrt(sq), 6) AS euclid, round({_DOT.format(a='x', b='y')}, 6) AS dot FROM m")
def vector_scores(spark, d):
    v = fx.vectors(spark, d)
    both = v.select("id", "vec").join(v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other")), "id")
    return both.select("id", F.round(vectors.euclid(F.col("vec"), F.col("other")), 6).alias("euclid"), F.round(vectors.dot(F.col("vec"), F.col("other")), 6).alias("dot"))


@query()
def pgi_to_hv(spark, d):
    """Sparse random projection of each sequence's syncmers."""
    return vectors.hypervectors(kmers.syncmers(fx.sequences(spark, d), 8, 5).select("name", "h"), 256, 4)


# --- plots and statistics ---------------------------------------------------------------------
@query("WITH x AS (SELECT lang, length(text) AS v FROM documents), m AS (SELECT min(v) AS lo, max(v) AS hi FROM x), b AS (SELECT lang, CAST(least(floor((v - lo) / ((hi - lo) / 40)), 39) AS BIGINT) AS bin, count(*) AS n FROM x, m GROUP BY ALL) SELECT lang, bin, n, round(n / sum(n) OVER (PARTITION BY lang), 4) AS density FROM b")
def plot_hh(spark, d):
    from pyspark.sql import Window

    x = fx.read(spark, d, "documents").select("lang", F.length("text").alias("v"))
    b = x.crossJoin(F.broadcast(x.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))))  # one row
    b = b.select("lang", F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 40)), F.lit(39)).cast("long").alias("bin")).groupBy("lang", "bin").agg(F.count("*").alias("n"))
    return b.withColumn("density", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lang")), 4))


@query(f"WITH {IV}, m AS (SELECT chr, max(CASE WHEN f = 'A' THEN 1 ELSE 0 END) + max(CASE WHEN f = 'N' THEN 2 ELSE 0 END) + max(CASE WHEN f = 'R' THEN 4 ELSE 0 END) AS mask FROM iv GROUP BY chr) SELECT CAST(mask AS INTEGER) AS mask, count(*) AS n FROM m GROUP BY mask")
def plot_venn(spark, d):
    bit = lambda f, v: F.max(F.when(F.col("f") == f, v).otherwise(0))
    m = fx.intervals(spark, d).groupBy("chr").agg((bit("A", 1) + bit("N", 2) + bit("R", 4)).cast("int").alias("mask"))
    return m.groupBy("mask").agg(F.count("*").alias("n"))


@query(f"WITH {PAF} SELECT q_name, t_name, t_start, q_start, block_len FROM paf WHERE block_len >= 100 AND matches / block_len >= 0.7 ORDER BY block_len DESC, q_name, t_name, q_start, t_start LIMIT 100000")
def plot_dot(spark, d):
    """The longest alignments that pass: the limit is the feature."""
    p = fx.paf(spark, d).filter("block_len >= 100 AND matches / block_len >= 0.7")
    return p.orderBy(F.desc("block_len"), "q_name", "t_name", "q_start", "t_start").limit(100_000).select("q_name", "t_name", "t_start", "q_start", "block_len")


@query(f"WITH {SEQ}, {_kmer_sql(8)}, t AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer) SELECT CAST(length(kmer) - length(translate(kmer, 'GC', '')) AS BIGINT) AS gc, " + ", ".join(f"count(*) FILTER (least(n, 5) = {i}) AS d{i}" for i in range(1, 6)) + " FROM t GROUP BY 1")
def plot_heat(spark, d):
    m = kmers.gc_matrix(kmers.table(fx.sequences(spark, d), 8), 5)
    out = m.groupBy("gc").pivot("depth", [1, 2, 3, 4, 5]).agg(F.sum("kmers"))
    return out.select("gc", *[F.coalesce(F.col(str(i)), F.lit(0)).cast("long").alias(f"d{i}") for i in range(1, 6)])
