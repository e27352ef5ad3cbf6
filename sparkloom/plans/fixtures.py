"""How the operators are bound to the driver's tables: the same definitions as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters to bases, upper and lower case; other characters stay.
BASES = "ACGTACGTACGTACGTACGTACGTAC"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Length of a block, and sequences in it.
BLOCK, ENTRIES = 60, 3


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark, sf_dir) -> DataFrame:
    """id, chr, s, e, f: line items as intervals of days on a part."""
    s = (F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) + 1).cast("long")
    q = F.col("l_quantity").cast("long")
    key = F.concat_ws(".", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], q.cast("string"), s.cast("string"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"))
    return read(spark, sf_dir, "lineitem").select(key.alias("id"), F.col("l_partkey").cast("string").alias("chr"), s.alias("s"), (s + q - 1).alias("e"), F.col("l_returnflag").alias("f"))


IV = """iv AS (
  SELECT concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), s, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id,
         CAST(l_partkey AS VARCHAR) AS chr, s, s + CAST(l_quantity AS BIGINT) - 1 AS e, l_returnflag AS f
  FROM (SELECT *, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + 1 AS BIGINT) AS s FROM lineitem))"""


def sql_islands(name: str, source: str, keys: str, gap: int = 1) -> str:
    """CTEs that make islands of a source with columns keys, s, e."""
    return f"""{name}_m AS (SELECT {keys}, s, e, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM {source} WHERE s <= e),
{name}_n AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM {name}_m),
{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM {name}_n GROUP BY {keys}, g)"""


def sql_depth(name: str, source: str, keys: str) -> str:
    """CTEs that make segments of depth."""
    return f"""{name}_e AS (SELECT {keys}, pos, sum(d) AS d FROM (SELECT {keys}, s AS pos, 1 AS d FROM {source} UNION ALL SELECT {keys}, e + 1, -1 FROM {source}) GROUP BY {keys}, pos HAVING sum(d) <> 0),
{name}_r AS (SELECT {keys}, pos, lead(pos) OVER (PARTITION BY {keys} ORDER BY pos) AS nxt, sum(d) OVER (PARTITION BY {keys} ORDER BY pos) AS depth FROM {name}_e),
{name} AS (SELECT {keys}, pos AS s, nxt - 1 AS e, CAST(depth AS BIGINT) AS depth FROM {name}_r WHERE depth > 0)"""


def sizes(iv: DataFrame) -> DataFrame:
    return iv.groupBy("chr").agg((F.max("e") + 100).alias("len"))


SIZES = "sizes AS (SELECT chr, max(e) + 100 AS len FROM iv GROUP BY chr)"


def _bases(text, keep_case: bool):
    return F.translate(text, _UP + _LOW, BASES + (BASES.lower() if keep_case else BASES))


def sequences(spark, sf_dir, keep_case: bool = False, solid: bool = False) -> DataFrame:
    """pos, name, seq: whole texts as sequences, capitals and small letters as one or as they are; ``solid``: bases alone."""
    out = read(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("pos"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), _bases(F.col("text"), keep_case).alias("seq"))
    return out.withColumn("seq", F.regexp_replace("seq", "[^ACGT]", "")) if solid else out


def sql_seq(keep_case: bool = False) -> str:
    return f"seq AS (SELECT doc_id AS pos, 'd' || doc_id AS name, translate(text, '{_UP + _LOW}', '{BASES + (BASES.lower() if keep_case else BASES)}') AS seq FROM documents WHERE text IS NOT NULL)"


SEQ, SEQ_CASE = sql_seq(), sql_seq(True)
SOLID = SEQ.replace("seq AS (SELECT", "seq0 AS (SELECT") + ", seq AS (SELECT pos, name, regexp_replace(seq, '[^ACGT]', '', 'g') AS seq FROM seq0)"
RC = "reverse(translate({x}, 'ACGT', 'TGCA'))"


def psl(spark, sf_dir) -> DataFrame:
    """Line items as two-block alignments of a supplier (query) to a part (target)."""
    return read(spark, sf_dir, "lineitem").selectExpr(*PSL_COLUMNS_1).selectExpr("*", *PSL_COLUMNS_2).selectExpr("*", *PSL_COLUMNS_3).drop("q", "ln", "al", "b1")


PSL_COLUMNS_1 = [
    "cast(l_quantity as bigint) as q", "cast(l_linenumber as bigint) as ln", "cast(l_quantity as bigint) * 10 as match", "cast(round(l_discount * 100) as bigint) as mismatch", "cast(round(l_tax * 100) as bigint) as rep", "cast(l_linenumber as bigint) as n",
    "concat('q', cast(l_suppkey as string)) as q_name", "concat('t', cast(l_partkey as string)) as t_name", "case when l_returnflag = 'R' then '-' else '+' end as strand", "l_orderkey % 1000 as q_start", "(l_orderkey * 7 + l_linenumber) % 3000 as t_start",
    "cast(20000 as bigint) as q_size", "cast(20000 as bigint) as t_size", "cast(1 as bigint) as q_num_insert", "cast(1 as bigint) as t_num_insert", "cast(5 as bigint) as t_base_insert", "cast(2 as bigint) as block_count", "l_orderkey",
]
PSL_COLUMNS_2 = ["match + mismatch + rep + n as al", "q * 4 as b1", "ln * 3 as q_base_insert"]
PSL_COLUMNS_3 = [
    "q_start + al + ln * 3 as q_end", "t_start + al + 5 as t_end", "array(b1, al - b1) as block_sizes",
    "array(case when strand = '-' then q_size - (q_start + al + ln * 3) else q_start end, case when strand = '-' then q_size - (q_start + al + ln * 3) else q_start end + b1 + ln * 3) as q_starts", "array(t_start, t_start + b1 + 5) as t_starts",
]
PSL = """psl0 AS (SELECT CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS ln, CAST(round(l_discount * 100) AS BIGINT) AS mismatch, CAST(round(l_tax * 100) AS BIGINT) AS rep, CAST(l_linenumber AS BIGINT) AS n,
  'q' || l_suppkey AS q_name, 't' || l_partkey AS t_name, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, l_orderkey % 1000 AS q_start, (l_orderkey * 7 + l_linenumber) % 3000 AS t_start, l_orderkey FROM lineitem),
psl1 AS (SELECT *, q * 10 AS match, q * 10 + mismatch + rep + n AS al, q * 4 AS b1, ln * 3 AS q_base_insert FROM psl0),
psl AS (SELECT *, q_start + al + ln * 3 AS q_end, t_start + al + 5 AS t_end, 20000 AS q_size, 20000 AS t_size FROM psl1)"""


def paf(spark, sf_dir) -> DataFrame:
    """The alignments in PAF form with a CIGAR; some ends are wrong, some CIGARs missing or malformed."""
    return read(spark, sf_dir, "lineitem").selectExpr(*PSL_COLUMNS_1).selectExpr("*", *PSL_COLUMNS_2).selectExpr(
        "q_name", "q_size as q_len", "q_start", "q_start + al + ln * 3 + case when ln = 3 then 1 else 0 end as q_end", "strand", "t_name", "t_size as t_len", "t_start", "t_start + al + 5 + case when l_orderkey % 11 = 0 then 1 else 0 end as t_end",
        "match as matches", "al + ln * 3 + 5 as block_len", "cast(60 as bigint) as mapq",
        "case when l_orderkey % 13 = 0 then '' when l_orderkey % 17 = 0 then concat(cast(b1 as string), 'Q') else concat(cast(b1 as string), 'M', cast(ln * 3 as string), 'I5D', cast(al - b1 - mismatch as string), '=', case when mismatch > 0 then concat(cast(mismatch as string), 'X') else '' end) end as cg",
    )


PAF = PSL + """,
paf AS (SELECT q_name, q_size AS q_len, q_start, q_end + CASE WHEN ln = 3 THEN 1 ELSE 0 END AS q_end, strand, t_name, t_size AS t_len, t_start, t_end + CASE WHEN l_orderkey % 11 = 0 THEN 1 ELSE 0 END AS t_end, match AS matches, al + ln * 3 + 5 AS block_len,
  b1, ln * 3 AS gi_len, al - b1 - mismatch AS eq_len, mismatch,
  CASE WHEN l_orderkey % 13 = 0 THEN '' WHEN l_orderkey % 17 = 0 THEN b1 || 'Q' ELSE b1 || 'M' || (ln * 3) || 'I5D' || (al - b1 - mismatch) || '=' || CASE WHEN mismatch > 0 THEN mismatch || 'X' ELSE '' END END AS cg FROM psl)"""


def blocks(spark, sf_dir) -> DataFrame:
    """block_id, idx, name, seq: whole texts in pieces, three documents to a block, the rest of a piece as dashes."""
    seq = sequences(spark, sf_dir)
    n = F.floor((F.length("seq") - 1) / BLOCK).cast("int")
    rows = seq.filter("length(seq) > 0").select("pos", "seq", F.explode(F.sequence(F.lit(0), n)).alias("piece"))
    rows = rows.select(F.concat_ws(".", F.floor(F.col("pos") / ENTRIES).cast("string"), F.col("piece").cast("string")).alias("block_id"), (F.col("pos") % ENTRIES).cast("int").alias("idx"), F.rpad(F.substring("seq", F.col("piece") * BLOCK + 1, F.lit(BLOCK)), BLOCK, "-").alias("seq"))
    rows = rows.withColumn("name", F.concat(F.lit("sp"), F.col("idx").cast("string")))
    return rows.join(rows.filter("idx = 0").select("block_id"), "block_id", "leftsemi").select("block_id", "idx", "name", "seq")


BLOCKS = SEQ + f""",
pieces AS (SELECT pos, seq, unnest(range(0, CAST((length(seq) - 1) // {BLOCK} AS BIGINT) + 1)) AS piece FROM seq WHERE length(seq) > 0),
entries AS (SELECT (pos // {ENTRIES}) || '.' || piece AS block_id, CAST(pos % {ENTRIES} AS INTEGER) AS idx, 'sp' || (pos % {ENTRIES}) AS name, rpad(substr(seq, piece * {BLOCK} + 1, {BLOCK}), {BLOCK}, '-') AS seq FROM pieces),
blocks AS (SELECT * FROM entries WHERE block_id IN (SELECT block_id FROM entries WHERE idx = 0)),
chars AS (SELECT block_id, idx, unnest(range(1, {BLOCK} + 1)) AS pos, seq FROM blocks),
cols AS (SELECT block_id, pos, list(substr(seq, pos, 1) ORDER BY idx) AS bases FROM chars GROUP BY block_id, pos)"""


def vectors(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
