"""More of the reference's commands as queries: nets, pairwise formats, archives, seeds and repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, chains, intervals, kmers, pairs
from ..streaming import windows
from . import fixtures as fx
from .fixtures import BLOCKS, PAF, PSL, SEQ, SOLID, sql_depth, sql_islands
from .queries import _HASH, _kmer_sql, query

# --- nets -------------------------------------------------------------------------------------
FILLS = """fills AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey // 7 END AS parent, 'c' || (o_custkey % 3) AS o_chrom, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS o_strand,
  o_totalprice AS score, (o_orderkey % 1000) * 100 AS s, (o_orderkey % 1000) * 100 + o_custkey % 500 + 20 AS e, o_custkey % 500 AS ali, o_custkey % 300 AS q_far FROM orders),
cl AS (SELECT f.*, CASE WHEN p.o_chrom IS NULL THEN 'top' WHEN p.o_chrom <> f.o_chrom THEN 'nonSyn' WHEN p.o_strand = f.o_strand THEN 'syn' ELSE 'inv' END AS class FROM fills f LEFT JOIN fills p ON f.parent = p.node)"""


def _fills(spark, d):
    o, k = fx.read(spark, d, "orders"), F.col("o_custkey")
    at = F.col("o_orderkey") % 1000 * 100
    return o.select(F.col("o_orderkey").alias("node"), F.when(F.col("o_orderkey") % 7 != 0, F.floor(F.col("o_orderkey") / 7)).alias("parent"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("o_chrom"), F.when(k % 2 == 0, "+").otherwise("-").alias("o_strand"), F.col("o_totalprice").alias("score"), at.alias("s"), (at + k % 500 + 20).alias("e"), (k % 500).alias("ali"), (k % 300).alias("q_far"))


@query(f"WITH {FILLS} SELECT class, count(*) AS fills, CAST(sum(e - s) AS BIGINT) AS bases FROM cl GROUP BY class")
def net_class(spark, d):
    return chains.net_class(chains.classify(_fills(spark, d)))


@query(f"WITH {FILLS} SELECT node, class FROM cl WHERE CASE WHEN score >= 200000 AND e - s >= 300 AND ali >= 200 THEN TRUE WHEN class = 'top' THEN score >= 100000 WHEN class = 'nonSyn' THEN FALSE WHEN q_far > 200 THEN FALSE ELSE TRUE END")
def net_filter_syn(spark, d):
    return chains.syntenic(chains.classify(_fills(spark, d)), 200_000, 300, 200, 100_000, 200).select("node", "class")


@query(f"WITH RECURSIVE {FILLS}, k AS (SELECT node, parent FROM fills WHERE score >= 50000), r AS (SELECT node FROM k WHERE parent IS NULL UNION ALL SELECT k.node FROM k JOIN r ON k.parent = r.node) SELECT node FROM r")
def net_filter(spark, d):
    """Fills by score whose ancestors pass too."""
    f = _fills(spark, d)
    return chains.prune(f, f.filter("score >= 50000")).select("node")


@query(f"WITH {FILLS}, q AS (SELECT o_chrom AS chr, s, e - 1 AS e FROM fills), {sql_depth('z', 'q', 'chr')} SELECT chr, CAST(sum(e - s + 1) AS BIGINT) AS dup FROM z WHERE depth >= 2 GROUP BY chr")
def net_syntenic_dup(spark, d):
    q = _fills(spark, d).select(F.col("o_chrom").alias("chr"), "s", (F.col("e") - 1).alias("e"))
    return intervals.depth_segments(q, ["chr"]).filter("depth >= 2").groupBy("chr").agg(F.sum(F.expr("e - s + 1")).alias("dup"))


@query(f"WITH {FILLS} SELECT node, o_chrom || '.net' AS file FROM fills")
def net_split(spark, d):
    """The file of each fill; a writer partitions by it."""
    return _fills(spark, d).select("node", F.concat("o_chrom", F.lit(".net")).alias("file"))


_SUBSET = f"""{PSL}, cb AS (SELECT l_orderkey AS id, q_name, t_start AS s, t_start + b1 AS e, CASE WHEN strand = '-' THEN 20000 - q_end ELSE q_start END AS q FROM psl
  UNION ALL SELECT l_orderkey, q_name, t_start + b1 + 5, t_start + al + 5, CASE WHEN strand = '-' THEN 20000 - q_end ELSE q_start END + b1 + q_base_insert FROM psl),
fl AS (SELECT o_orderkey AS id, (o_orderkey * 7) % 3000 + 20 AS a, (o_orderkey * 7) % 3000 + 40 + o_custkey % 500 AS z FROM orders),
ct AS (SELECT fl.id, q_name, greatest(s, a) AS s, least(e, z) AS e, q + greatest(s, a) - s AS q FROM cb JOIN fl ON cb.id = fl.id AND greatest(s, a) < least(e, z))"""


@query(f"WITH {_SUBSET} SELECT id, q_name, min(s) AS t_start, max(e) AS t_end, min(q) AS q_start, max(q + e - s) AS q_end, count(*) AS blocks, CAST(sum(e - s) AS BIGINT) AS bases FROM ct GROUP BY id, q_name")
def net_subset(spark, d):
    """The chains of fills, cut to what stands within each fill's span."""
    p = fx.psl(spark, d)
    rows = p.select(F.col("l_orderkey").alias("id"), "q_name", F.explode(F.arrays_zip("q_starts", "t_starts", "block_sizes")).alias("x"))
    c = rows.select("id", "q_name", F.col("x.t_starts").alias("t"), F.col("x.q_starts").alias("q"), F.col("x.block_sizes").alias("n"))
    at = F.col("o_orderkey") * 7 % 3000 + 20
    f = fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), at.alias("s"), (at + 20 + F.col("o_custkey") % 500).alias("e"))
    return chains.subset(c, f, ["id", "q_name"])


@query()
def chain_pre_net(spark, d):
    """Chains of line items, by score, that cover something that better ones leave."""
    p = fx.psl(spark, d)
    row = F.xxhash64("l_orderkey", "n", "t_start", "q_start")
    blocks = F.transform(F.arrays_zip("q_starts", "t_starts", "block_sizes"), lambda x: F.struct(x["t_starts"].alias("t"), x["q_starts"].alias("q"), x["block_sizes"].alias("n")))
    c = p.select(row.alias("id"), (F.col("match") - F.col("mismatch")).cast("double").alias("score"), "t_name", "t_size", "q_name", "q_size", blocks.alias("blocks"))
    return chains.pre_net(c).select("id", "t_name", "q_name", "score")


# --- chains -----------------------------------------------------------------------------------
@query()
def psl_chain(spark, d):
    """Blocks of line items chained by dynamic programming."""
    p = fx.psl(spark, d)
    b = p.select("t_name", "q_name", "strand", F.explode(F.arrays_zip("q_starts", "t_starts", "block_sizes")).alias("x")).filter("x.block_sizes > 0")
    return chains.chain_blocks(b.select("t_name", "q_name", "strand", F.col("x.t_starts").alias("t"), F.col("x.q_starts").alias("q"), F.col("x.block_sizes").alias("n"), (F.col("x.block_sizes") * 100).alias("score")).distinct())


@query()
def chain_net(spark, d):
    return chains.net(psl_chain(spark, d).withColumn("score", F.col("score").cast("double")))


@query(f"WITH {PSL}, c AS (SELECT CAST(match * 40 AS DOUBLE) AS score, q_name, t_name, q_start, match AS a, mismatch AS c, rep AS g, n AS t, rep AS lower FROM psl), x AS (SELECT *, greatest(a + c + g + t, 1) AS n, list_reverse_sort([a, c, g, t]) AS top FROM c), y AS (SELECT *, (top[1] + top[2]) / n AS share FROM x) SELECT q_name, t_name, q_start, score FROM y WHERE score >= 3000 AND (score >= 15000 OR (score * CASE WHEN share > 0.8 THEN 1 - (share - 0.8) / 0.2 ELSE 1.0 END >= 3000 AND score * (1 - lower / n) >= 3000))")
def chain_anti_repeat(spark, d):
    c = fx.psl(spark, d).select((F.col("match") * 40).cast("double").alias("score"), "q_name", "t_name", "q_start", F.col("match").alias("a"), F.col("mismatch").alias("c"), F.col("rep").alias("g"), F.col("n").alias("t"), F.col("rep").alias("lower"))
    return chains.anti_repeat(c, 3000, 15000).select("q_name", "t_name", "q_start", "score")


@query(f"WITH {PSL} SELECT t_name, q_name, t_start, CAST(CAST(regexp_extract(t_name, '[0-9]+') AS BIGINT) % 16 AS INTEGER) AS bucket FROM psl")
def chain_split(spark, d):
    """The bucket of each chain by the first number in its target's name; a writer partitions by it."""
    return fx.psl(spark, d).select("t_name", "q_name", "t_start", (F.regexp_extract("t_name", "[0-9]+", 0).cast("long") % 16).cast("int").alias("bucket"))


# --- pairwise texts ---------------------------------------------------------------------------
_PAIR = f"""{BLOCKS}, pr AS (SELECT a.block_id, a.seq AS t_text, b.seq AS q_text FROM blocks a JOIN blocks b ON a.block_id = b.block_id AND a.idx = 0 AND b.idx = 1),
op AS (SELECT block_id, t_text, q_text, array_to_string(list_transform(range(1, 61), lambda i: CASE WHEN substr(t_text, i, 1) = '-' AND substr(q_text, i, 1) = '-' THEN '' WHEN substr(t_text, i, 1) = '-' THEN 'I' WHEN substr(q_text, i, 1) = '-' THEN 'D' WHEN substr(t_text, i, 1) = substr(q_text, i, 1) THEN '=' ELSE 'X' END), '') AS o FROM pr),
ct AS (SELECT block_id, t_text, q_text, o, CAST(length(o) - length(replace(o, '=', '')) AS BIGINT) AS m, CAST(length(o) - length(replace(o, 'X', '')) AS BIGINT) AS x, CAST(length(o) - length(replace(o, 'I', '')) AS BIGINT) AS ib, CAST(length(o) - length(replace(o, 'D', '')) AS BIGINT) AS db, CAST(len(regexp_extract_all(o, 'I+')) AS BIGINT) AS ic, CAST(len(regexp_extract_all(o, 'D+')) AS BIGINT) AS dc,
  array_to_string(list_transform(regexp_extract_all(o, '(=+|X+|I+|D+)'), lambda r: length(r) || substr(r, 1, 1)), '') AS cg FROM op)"""


def _pairs(spark, d):
    b = fx.blocks(spark, d)
    both = b.filter("idx = 0").select("block_id", F.col("seq").alias("t_text")).join(b.filter("idx = 1").select("block_id", F.col("seq").alias("q_text")), "block_id")
    return pairs.pair_counts(both)


@query(f"WITH {_PAIR} SELECT block_id, m AS match, x AS mismatch, ic AS q_num_insert, ib AS q_base_insert, dc AS t_num_insert, db AS t_base_insert FROM ct")
def axt_to_psl(spark, d):
    return _pairs(spark, d).select("block_id", "match", "mismatch", "q_num_insert", "q_base_insert", "t_num_insert", "t_base_insert")


@query(f"WITH {_PAIR} SELECT block_id, cg, round(m / (m + x + ic + dc), 6) AS gi, round(m / (m + x + ib + db), 6) AS bi FROM ct")
def maf_to_paf(spark, d):
    p = _pairs(spark, d)
    gi = F.col("match") / F.expr("match + mismatch + q_num_insert + t_num_insert")
    bi = F.col("match") / F.expr("match + mismatch + q_base_insert + t_base_insert")
    return p.select("block_id", "cg", F.round(gi, 6).alias("gi"), F.round(bi, 6).alias("bi"))


@query(f"WITH {BLOCKS} SELECT block_id, string_agg('>' || name || '.' || block_id || chr(10) || seq, chr(10) ORDER BY idx) AS fas FROM blocks WHERE idx < 2 GROUP BY block_id")
def axt_to_fas(spark, d):
    b = fx.blocks(spark, d).filter("idx < 2").withColumn("t", F.concat(F.lit(">"), "name", F.lit("."), "block_id", F.lit("\n"), "seq"))
    return b.groupBy("block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "t"))), lambda x: x["t"]), "\n").alias("fas"))


@query(f"WITH {BLOCKS} SELECT block_id, string_agg('s ' || name || ' ' || (CAST(split_part(block_id, '.', 2) AS BIGINT) * 60) || ' ' || length(replace(seq, '-', '')) || ' + ' || seq, chr(10) ORDER BY idx) AS maf FROM blocks WHERE idx < 2 GROUP BY block_id")
def axt_to_maf(spark, d):
    start = (F.split_part("block_id", F.lit("."), F.lit(2)).cast("long") * 60).cast("string")
    line = F.concat_ws(" ", F.lit("s"), "name", start, F.length(F.translate("seq", "-", "")).cast("string"), F.lit("+"), "seq")
    b = fx.blocks(spark, d).filter("idx < 2").withColumn("t", line)
    return b.groupBy("block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "t"))), lambda x: x["t"]), "\n").alias("maf"))


@query(f"WITH {_PAIR}, s AS (SELECT block_id, m * 100 - x * 100 AS score FROM ct) SELECT block_id, score, row_number() OVER (PARTITION BY split_part(block_id, '.', 1) ORDER BY score DESC, block_id) - 1 AS id FROM s")
def axt_sort(spark, d):
    """Order by score within a target, numbered from 0."""
    from pyspark.sql import Window

    s = _pairs(spark, d).select("block_id", F.expr("match * 100 - mismatch * 100").alias("score"))
    w = Window.partitionBy(F.split_part("block_id", F.lit("."), F.lit(1))).orderBy(F.desc("score"), "block_id")
    return s.withColumn("id", (F.row_number().over(w) - 1).cast("long"))


@query(f"""WITH {BLOCKS}, b AS (SELECT block_id, idx, name, split_part(block_id, '.', 1) AS chr, CASE WHEN idx = 1 THEN '-' ELSE '+' END AS strand, CAST(split_part(block_id, '.', 2) AS BIGINT) * 60 + 1 AS s, rpad(replace(rtrim(seq, '-'), '-', 'N'), 60, '-') AS seq, length(rtrim(seq, '-')) AS n FROM blocks),
m AS (SELECT block_id, min(n) AS least FROM b GROUP BY block_id), r AS (SELECT * FROM (VALUES (11, 40), (55, 130), (200, 200), (230, 4000)) v(s2, e2)),
c AS (SELECT t.block_id, greatest(t.s, s2) AS lo, greatest(t.s, s2) - t.s + 1 AS a, least(least(t.s + t.n - 1, e2) - t.s + 1, least) AS z FROM b t JOIN m USING (block_id) JOIN r ON s2 <= t.s + t.n - 1 AND t.s <= e2 WHERE idx = 0)
SELECT block_id, CAST(lo AS BIGINT) AS lo, idx, name, strand, CAST(CASE WHEN strand = '-' THEN s + n - z ELSE s + a - 1 END AS BIGINT) AS s, CAST(CASE WHEN strand = '-' THEN s + n - a ELSE s + z - 1 END AS BIGINT) AS e, substr(seq, a, z - a + 1) AS seq FROM b JOIN c USING (block_id) WHERE a <= z""")
def fas_slice(spark, d):
    """Blocks cut by a runlist of the target's places, with the ranges of all entries."""
    b = fx.blocks(spark, d).withColumn("chr", F.split_part("block_id", F.lit("."), F.lit(1))).withColumn("strand", F.when(F.col("idx") == 1, "-").otherwise("+"))
    b = b.withColumn("s", F.split_part("block_id", F.lit("."), F.lit(2)).cast("long") * 60 + 1).withColumn("seq", F.rpad(F.replace(F.rtrim("seq", F.lit("-")), F.lit("-"), F.lit("N")), 60, "-"))
    spans = F.array(*[F.struct(F.lit(x).cast("long").alias("s"), F.lit(y).cast("long").alias("e")) for x, y in ((11, 40), (55, 130), (200, 200), (230, 4000))])
    runlist = b.select("chr").distinct().select("chr", F.explode(spans).alias("x")).select("chr", "x.s", "x.e")
    return blocks.sliced(b, runlist).select("block_id", "lo", "idx", "name", "strand", "s", "e", "seq")


@query(f"""WITH {BLOCKS}, t AS (SELECT block_id, md5(seq) AS target FROM blocks WHERE idx = 0), f AS (SELECT target, min(block_id) AS first FROM t GROUP BY target),
e AS (SELECT target, block_id, idx, name, seq FROM blocks JOIN t USING (block_id) JOIN f USING (target) WHERE idx > 0 OR block_id = first)
SELECT target, CAST(row_number() OVER (PARTITION BY target ORDER BY idx > 0, block_id, idx) AS INTEGER) AS place, block_id, name, seq FROM e""")
def fas_join(spark, d):
    """Blocks that share a target entry become one: the target once, then the others' entries in order."""
    b = fx.blocks(spark, d)
    header = b.filter("idx = 0").select("block_id", F.md5(F.col("seq").cast("binary")).alias("target"))
    return blocks.joined(b, header).select("target", "place", "block_id", "name", "seq")


@query(f"""WITH {BLOCKS}, m(old, news) AS (VALUES ('sp1', ['one', 'uno']), ('sp2', ['two']), ('sp9', [])), k AS (SELECT block_id, count(*) AS hits, count(DISTINCT old) AS kinds, any_value(old) AS old, any_value(news) AS news FROM blocks JOIN m ON name = old GROUP BY block_id),
r AS (SELECT block_id, old, unnest(news) AS new, unnest(range(0, len(news))) AS copy FROM k WHERE kinds = 1 AND hits = 1)
SELECT block_id, CAST(copy AS INTEGER) AS copy, idx, CASE WHEN name = old THEN new ELSE name END AS name FROM blocks JOIN r USING (block_id)
UNION ALL SELECT block_id, 0, idx, name FROM blocks WHERE block_id NOT IN (SELECT block_id FROM k WHERE kinds = 1 AND hits = 1)""")
def fas_replace(spark, d):
    """A block with one listed header comes once for each new name, others stay."""
    m = spark.createDataFrame([("sp1", ["one", "uno"]), ("sp2", ["two"]), ("sp9", [])], "old string, news array<string>")
    return blocks.replaced(fx.blocks(spark, d), m).select("block_id", "copy", "idx", "name")


@query(f"WITH {SEQ}, l AS (SELECT o_orderkey AS block_id, 0 AS idx, 'd' || (o_orderkey % (SELECT count(*) FROM documents)) AS name, 1 AS s, 30 AS e FROM orders UNION ALL SELECT o_orderkey, 1, 'd' || (o_custkey % (SELECT count(*) FROM documents)), 11, 40 FROM orders) SELECT block_id, idx, name, substr(seq, s, e - s + 1) AS seq FROM l JOIN seq USING (name)")
def fas_create(spark, d):
    """Link lines (two ranges each) to blocks."""
    n = fx.read(spark, d, "documents").agg(F.count("*").alias("n"))
    o = fx.read(spark, d, "orders").crossJoin(F.broadcast(n))  # one row
    name = lambda c: F.concat(F.lit("d"), (F.col(c) % F.col("n")).cast("string"))
    links = F.array(F.struct(name("o_orderkey").alias("name"), F.lit(1).alias("s"), F.lit(30).alias("e")), F.struct(name("o_custkey").alias("name"), F.lit(11).alias("s"), F.lit(40).alias("e")))
    l = o.select(F.col("o_orderkey").alias("block_id"), F.posexplode(links).alias("idx", "r")).select("block_id", "idx", "r.*")
    return l.join(fx.sequences(spark, d).select("name", "seq"), "name").select("block_id", "idx", "name", F.substring("seq", F.col("s"), F.col("e") - F.col("s") + 1).alias("seq"))


@query(f"WITH {PAF}, a AS (SELECT *, CASE WHEN gi_len >= 5 THEN 0 ELSE gi_len END AS short FROM paf WHERE cg <> '' AND cg NOT LIKE '%Q') SELECT q_name, t_name, CAST(0 AS INTEGER) AS part, t_start AS t_from, t_start + b1 AS t_to, q_start AS q_from, q_start + b1 + short AS q_to FROM a UNION ALL SELECT q_name, t_name, 1, t_start + b1 + 5, t_start + b1 + 5 + eq_len + mismatch, q_start + b1 + gi_len, q_start + b1 + gi_len + eq_len + mismatch FROM a")
def paf_graph_segments(spark, d):
    """Alignments cut at gaps of five and more bases: the nodes of a segment graph."""
    p = fx.paf(spark, d).filter("cg <> '' AND NOT cg LIKE '%Q'")
    p = p.withColumn("row", F.concat_ws("|", "q_name", "t_name", "q_start", "t_start", "cg", "strand", F.monotonically_increasing_id()))
    s = pairs.segments(p.select("row", "t_start", "q_start", "cg"), 5)
    part = lambda i: F.split_part("row", F.lit("|"), F.lit(i))
    return s.select(part(1).alias("q_name"), part(2).alias("t_name"), "part", "t_from", "t_to", "q_from", "q_to")


# --- archives ---------------------------------------------------------------------------------
_ARCH = f"{SEQ}, sm AS (SELECT 'd' || (pos // 4 * 4) AS ref, name AS sample, seq FROM seq), sg AS (SELECT sample, ref, seq, unnest(range(0, CAST((length(seq) - 1) // 50 AS BIGINT) + 1)) AS seg FROM sm WHERE length(seq) > 0), pt AS (SELECT sample, ref, seg, substr(seq, seg * 50 + 1, 50) AS part FROM sg), ar AS (SELECT p.sample, p.ref, p.seg, CASE WHEN p.part = r.part THEN 'identity' ELSE 'raw' END AS encoding, CASE WHEN p.part = r.part THEN NULL ELSE p.part END AS payload FROM pt p LEFT JOIN pt r ON r.sample = p.ref AND r.seg = p.seg)"


def _archive(spark, d):
    s = fx.sequences(spark, d)
    own = s.select(F.concat(F.lit("d"), (F.floor(F.col("pos") / 4) * 4).cast("string")).alias("ref"), F.col("name").alias("sample"), "seq")
    refs = s.filter("pos % 4 = 0").select(F.col("name").alias("ref"), "seq")
    return own, refs, pairs.archive(own, refs, 50)


@query(f"WITH {_ARCH} SELECT sample, ref, seg, encoding, payload FROM ar")
def pbit_create(spark, d):
    return _archive(spark, d)[2]


@query(f"WITH {_ARCH} SELECT encoding, count(*) AS segments, count(DISTINCT sample) AS samples, CAST(coalesce(sum(length(payload)), 0) AS BIGINT) AS stored FROM ar GROUP BY encoding")
def pbit_stat(spark, d):
    return _archive(spark, d)[2].groupBy("encoding").agg(F.count("*").alias("segments"), F.countDistinct("sample").alias("samples"), F.coalesce(F.sum(F.length("payload")), F.lit(0)).cast("long").alias("stored"))


@query(f"WITH {SEQ} SELECT name AS sample, md5(seq) AS digest FROM seq WHERE length(seq) > 0")
def pbit_to_fa(spark, d):
    """Sequences restored from the archive."""
    _, refs, arch = _archive(spark, d)
    return pairs.restore(arch, refs, 50).select("sample", F.md5(F.col("seq").cast("binary")).alias("digest"))


# --- k-mers against a library -----------------------------------------------------------------
_LIB = SOLID + ", lib AS (SELECT item_id AS pos, 'b' || item_id AS name, regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', '', 'g') AS seq FROM benchmark WHERE text IS NOT NULL)"


def _library(spark, d):
    seq = F.regexp_replace(fx._bases(F.col("text"), False), "[^ACGT]", "")
    return fx.read(spark, d, "benchmark").filter("text IS NOT NULL").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("name"), seq.alias("seq"))


def _lib_kmers(k):
    return _kmer_sql(k).replace("km AS", "lk AS").replace("FROM seq)", "FROM lib)")


@query(f"WITH {_LIB}, {_kmer_sql(17)}, {_lib_kmers(17)}, m AS (SELECT name, off + 1 AS s, off + 17 AS e FROM km WHERE kmer IN (SELECT kmer FROM lk)), {sql_islands('a', 'm', 'name', 6)}, b AS (SELECT * FROM a WHERE e - s + 1 >= 40), {sql_islands('z', 'b', 'name', 11)} SELECT name, s, e FROM z")
def rept_e_kmer(spark, d):
    """Runs of documents under the library's k-mers: union with fill, excise, fill."""
    lib = kmers.occurrences(_library(spark, d), 17).select("kmer").distinct()
    occ = kmers.occurrences(fx.sequences(spark, d, solid=True), 17).join(lib, "kmer", "leftsemi")
    r = occ.select("name", (F.col("off") + 1).cast("long").alias("s"), (F.col("off") + 17).cast("long").alias("e"))
    return intervals.span(intervals.span(intervals.span(r, ["name"], "fill", 5), ["name"], "excise", 40), ["name"], "fill", 10)


@query(f"WITH {_LIB}, {_kmer_sql(21)}, {_lib_kmers(21)}, h AS (SELECT DISTINCT name, kmer FROM km), l AS (SELECT DISTINCT name, kmer FROM lk), t AS (SELECT name, count(*) AS n FROM l GROUP BY name) SELECT h.name AS doc, l.name AS item, count(*) AS shared, round(count(*) / any_value(t.n), 4) AS containment FROM h JOIN l USING (kmer) JOIN t ON t.name = l.name GROUP BY ALL")
def dist_pgi(spark, d):
    """Containment of library items in documents by shared keys."""
    h = kmers.occurrences(fx.sequences(spark, d, solid=True), 21).select(F.col("name").alias("doc"), "kmer").distinct()
    l = kmers.occurrences(_library(spark, d), 21).select(F.col("name").alias("item"), "kmer").distinct()
    n = l.groupBy("item").agg(F.count("*").alias("n"))
    out = h.join(l, "kmer").groupBy("doc", "item").agg(F.count("*").alias("shared")).join(n, "item")
    return out.select("doc", "item", "shared", F.round(F.col("shared") / F.col("n"), 4).alias("containment"))


@query(f"WITH {_LIB}, {_kmer_sql(20)}, {_lib_kmers(20)}, c AS (SELECT kmer FROM km GROUP BY kmer HAVING count(*) < 10) SELECT km.name AS q, lk.name AS t, floor((km.off - lk.off) / 64) AS diagonal, count(*) AS seeds, min(km.off) AS q_from, max(km.off) + 20 AS q_to FROM km JOIN lk USING (kmer) WHERE kmer IN (SELECT kmer FROM c) GROUP BY ALL")
def align_pgi_seeds(spark, d):
    """Seeds of library items by rare k-mers, in diagonal bands of 64."""
    t = kmers.keyed(_library(spark, d), 20).select(F.col("name").alias("t"), F.col("off").alias("t_off"), "key")
    q = kmers.keyed(fx.sequences(spark, d, solid=True), 20, among=kmers.bit_table(t))
    rare = q.groupBy("key").count().filter("count < 10").select("key")
    both = q.join(t.join(rare, "key", "leftsemi"), "key")
    band = F.floor((F.col("off") - F.col("t_off")) / 64)
    return both.groupBy(F.col("name").alias("q"), "t", band.cast("double").alias("diagonal")).agg(F.count("*").alias("seeds"), F.min("off").cast("long").alias("q_from"), (F.max("off") + 20).cast("long").alias("q_to"))


_QUAL = "translate(seq, 'ACGT', 'I5+?')"


@query(f"WITH {SOLID}, x AS (SELECT substr(seq, i, 7) AS k, length(replace(substr({_QUAL}, i, 7), '+', '')) = 7 AS good FROM (SELECT seq, unnest(range(1, length(seq) - 5)) AS i FROM seq)), y AS (SELECT least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer, good FROM x), z AS (SELECT kmer, count(*) FILTER (good) AS hi, count(*) FILTER (NOT good) AS lo FROM y GROUP BY kmer) SELECT CAST(least(CASE WHEN hi > 0 THEN hi ELSE lo END, 127) AS BIGINT) AS depth, count(*) AS kmers FROM z GROUP BY 1")
def kmer_qhist(spark, d):
    s = fx.sequences(spark, d, solid=True).withColumn("qual", F.translate("seq", "ACGT", "I5+?"))
    return kmers.quality_histogram(s, 7, 15)


# --- windows over events (an extension) -------------------------------------------------------
@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    out = windows.tumbling(fx.read(spark, d, "events"), "ts", "1 hour", "1 day", ["event_type"])
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH x AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), y AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM y GROUP BY user_id, g")
def events_sessions(spark, d):
    return windows.sessions(fx.read(spark, d, "events"), "ts", "6 hours", "1 day", ["user_id"]).select("user_id", "start", "end", "n")


# --- archives: parts of samples ---------------------------------------------------------------
@query(f"WITH {SEQ} SELECT name AS sample, md5(seq) AS digest FROM seq WHERE length(seq) > 0 AND pos % 3 = 1")
def pbit_some(spark, d):
    """The samples of a list, restored; segments of others are not touched."""
    own, refs, arch = _archive(spark, d)
    wanted = fx.sequences(spark, d).filter("pos % 3 = 1").select(F.col("name").alias("sample"))
    return pairs.restore(arch.join(wanted, "sample", "leftsemi"), refs, 50).select("sample", F.md5(F.col("seq").cast("binary")).alias("digest"))


@query(f"WITH {SEQ} SELECT name AS sample, substr(seq, 31, 90) AS seq FROM seq WHERE length(seq) >= 31")
def pbit_range(spark, d):
    """Bases 31 to 120 of every sample: only the segments that hold them are restored."""
    own, refs, arch = _archive(spark, d)
    held = pairs.restore(arch.filter("seg BETWEEN 0 AND 2"), refs, 50)
    return held.filter("length(seq) >= 31").select("sample", F.substring("seq", 31, 90).alias("seq"))


# --- sketches ---------------------------------------------------------------------------------
@query(f"""WITH {SOLID}, {_kmer_sql(21)}, h0 AS (SELECT DISTINCT name, {_HASH.format(x='kmer')} AS h FROM km), sk AS (SELECT name, h FROM (SELECT name, h, row_number() OVER (PARTITION BY name ORDER BY h) AS rank FROM h0) WHERE rank <= 100),
l AS (SELECT name, list(h) AS hs FROM sk GROUP BY name), p AS (SELECT DISTINCT a.name AS n1, b.name AS n2 FROM sk a JOIN sk b ON a.h = b.h AND a.name < b.name),
u AS (SELECT n1, n2, list_sort(list_distinct(list_concat(x.hs, y.hs)))[1:100] AS fewest, list_intersect(x.hs, y.hs) AS common FROM p JOIN l x ON x.name = n1 JOIN l y ON y.name = n2),
j AS (SELECT n1, n2, CAST(len(list_intersect(fewest, common)) AS BIGINT) AS shared, CAST(len(fewest) AS BIGINT) AS size FROM u)
SELECT n1, n2, shared, size, CASE WHEN shared = 0 THEN 1.0 ELSE round(greatest(least(1.0, -ln(2 * (shared / size) / (1 + shared / size)) / 21), 0.0) + 0.0, 4) END AS mash FROM j""")
def dist_mash(spark, d):
    """Mash distances of bottom sketches."""
    sketch = kmers.sketches(fx.sequences(spark, d, solid=True), 21, 100).select("name", F.explode("hs").alias("h"))
    return kmers.mash(sketch, 21, 100)


@query()
def dist_mini_windows(spark, d):
    """Similarity by jumping minimizers of windows of ten."""
    return kmers.similarity(kmers.jumping(fx.sequences(spark, d), 21, 10), 21)


# --- blocks as files --------------------------------------------------------------------------
@query(f"WITH {BLOCKS} SELECT block_id, 'sp0.' || split_part(block_id, '.', 1) || '.fas' AS file, string_agg('>' || name || chr(10) || seq || chr(10), '' ORDER BY idx) AS text FROM blocks GROUP BY block_id")
def fas_split(spark, d):
    """The file of each block, by species and chromosome of its first entry, and its text with simple headers; a writer partitions by it."""
    return blocks.as_files(fx.blocks(spark, d).withColumn("chr", F.split_part("block_id", F.lit("."), F.lit(1)))).select("block_id", "file", "text")
