"""Exact top-k inner products by a three-phase uniform threshold over vertical slices.

Vectors are stored by slices of their dimensions, a column each; a slice's inner product with a
query is a local score, and the local scores of a row add up to its score.

1. Gather: each slice gives every query its k + 1 best local scores. The rows named are resolved,
   and the (k+1)-th best exact score, t, is a safe cutoff.
2. Broadcast t / m for m slices: a row that reaches t has a local score of at least t / m in some
   slice. Each slice sends what reaches it.
3. Rows whose known scores plus the most that is left for unseen slices stay below t go; the rest
   is resolved exactly.

Equal vectors are searched once: of each, only the k + 1 smallest ids can be in a result. Queries
go in blocks of bounded size, so what is broadcast does not grow with the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, small_batches

#: Distinct query vectors in a block; it is broadcast.
QUERY_BLOCK = 4096


def quantised(df: DataFrame, ids: str, vector: str, scale: float) -> DataFrame:
    """vec_id, vec of the rows that take part: floor(scale * x) of finite components as double."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    vec = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return df.filter(F.col(ids).isNotNull() & F.col(vector).isNotNull() & fine).select(F.col(ids).cast("long").alias("vec_id"), vec.alias("vec"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; short rows are filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lens = np.diff(column.offsets.to_numpy())
    if len(lens) and (lens == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lens), width), np.int64)
    rows = np.repeat(np.arange(len(lens)), lens)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x @ q.T in whole numbers; in doubles where these are exact."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    if most < 2.0**53:
        return (x.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    return x @ q.T


def _local(reps: DataFrame, column: str, queries, cut: slice, fn_rows) -> DataFrame:
    """(q, rep, local) of one slice, read as one column."""

    def run(batches):
        q = queries.value[:, cut]
        for b in batches:
            x = _matrix(b.column(column), q.shape[1])
            rep = b.column("rep").to_numpy()
            for at in range(0, len(rep), 1024):
                s = products(x[at : at + 1024], q)
                rows, cols = fn_rows(s)
                yield pa.RecordBatch.from_pydict({"q": pa.array(cols.astype(np.int32)), "rep": pa.array(rep[at : at + 1024][rows]), "local": pa.array(s[rows, cols])})

    return arrow_map(reps.select("rep", column), run, "q int, rep long, local long")


def _resolved(pairs: DataFrame, reps: DataFrame, slices: list[str], queries) -> DataFrame:
    """(q, rep, score) of (q, rep) pairs."""

    def run(batches):
        q = queries.value
        for b in batches:
            x = np.concatenate([_matrix(b.column(c), w.stop - w.start) for c, w in zip(slices, _cuts(q.shape[1], len(slices)))], axis=1)
            y = q[b.column("q").to_numpy()]
            yield pa.RecordBatch.from_pydict({"q": b.column("q"), "rep": b.column("rep"), "score": pa.array((x * y).sum(axis=1))})

    return arrow_map(pairs.join(reps, "rep").select("q", "rep", *slices), run, "q int, rep long, score long")


def _cuts(width: int, m: int) -> list[slice]:
    ends = [width * i // m for i in range(m + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:])]


def _best(df: DataFrame, by: str, score: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), "rep")
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def top_k(df: DataFrame, ids: str = "vec_id", vector: str = "embedding", k: int = 5, every: int = 50, scale: float = 256, slices: int = 2) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; a query's own row is no candidate.
    Rows with a null id or vector, or with null or non-finite components, take no part. Repeated
    rows count once. Vectors of unequal lengths are compared as if zeros followed the shorter
    one. With fewer than k candidates all are given; an empty table gives an empty result.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    small_batches(spark)
    vectors = scratch.keep(quantised(df, ids, vector, scale).distinct(), "vectors")
    width = vectors.agg(F.max(F.size("vec"))).first()[0] or 1
    by = Window.partitionBy("vec").orderBy("vec_id")
    numbered = vectors.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k + 1)
    first = vectors.groupBy("vec").agg(F.min("vec_id").alias("rep"))
    members = numbered.join(first, "vec").select("rep", "vec_id")
    names = [f"s{i}" for i in range(slices)]
    cuts = _cuts(width, slices)
    reps = scratch.keep(first.select("rep", *[F.slice("vec", c.start + 1, max(1, c.stop - c.start)).alias(n) for c, n in zip(cuts, names)]), "reps")
    asked = vectors.filter(F.col("vec_id") % every == 0)
    asks = scratch.keep(asked.groupBy("vec").agg(F.min("vec_id").alias("ask")), "asks")
    blocks = max(1, -(-asks.count() // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        rows = asks.filter(F.pmod(F.xxhash64("ask"), F.lit(blocks)) == block).orderBy("ask").collect()  # about QUERY_BLOCK rows
        if not rows:
            continue
        q = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            q[i, : len(r.vec)] = r.vec
        part = scratch.keep(_search(reps, names, cuts, spark.sparkContext.broadcast(q), k), "best")
        part = part.join(F.broadcast(spark.createDataFrame([(i, r.ask) for i, r in enumerate(rows)], "q int, ask long")), "q").select("ask", "rep", "score")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = found.join(members, "rep").select("ask", F.col("vec_id").alias("rep"), "score")
    rows = _best(rows, "ask", "score", k + 1)
    out = asked.join(asks, "vec").select(F.col("vec_id").alias("query_id"), "ask").join(rows, "ask").filter("rep <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rep"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("rep").alias("vec_id"), "score")


def _search(reps: DataFrame, names: list[str], cuts: list[slice], queries, k: int) -> DataFrame:
    """(q, rep, score): the k + 1 best distinct vectors of each query of a block."""
    spark, n, m, need = reps.sparkSession, len(queries.value), len(names), k + 1

    def best_local(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = min(need, len(s))
        rows = np.argpartition(-s, most - 1, axis=0)[:most]
        return rows.ravel(), np.tile(np.arange(s.shape[1]), most)

    lists = None
    for c, cut in zip(names, cuts):
        one = _best(_local(reps, c, queries, cut, best_local), "q", "local", need).select("q", "rep")
        lists = one if lists is None else lists.union(one)
    first = _best(_resolved(lists.distinct(), reps, names, queries), "q", "score", need)
    cutoff = np.full(n, -(2**61), np.int64)
    for q, t, count in first.groupBy("q").agg(F.min("score"), F.count("*")).collect():  # a row for each query of the block
        if count == need:
            cutoff[q] = t
    cutoffs = spark.sparkContext.broadcast(cutoff)

    def reaching(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(s >= -(-cutoffs.value // m))

    sent = None
    for c, cut in zip(names, cuts):
        one = _local(reps, c, queries, cut, reaching)
        sent = one if sent is None else sent.union(one)
    known = sent.groupBy("q", "rep").agg(F.sum("local").alias("known"), F.count("*").alias("seen"))

    def possible(batches):
        t = cutoffs.value
        for b in batches:
            at = t[b.column("q").to_numpy()]
            most = b.column("known").to_numpy() + (m - b.column("seen").to_numpy()) * (-(-at // m) - 1)
            yield b.select(["q", "rep"]).filter(pa.array((most >= at) | (at == -(2**61))))

    left = arrow_map(known, possible, "q int, rep long")
    return _best(_resolved(left, reps, names, queries), "q", "score", need)
