"""Sequence packing: patterns of few documents, fitted by non-negative least squares.

Documents become token counts; only those longer than a sequence are cut. Lengths are a bounded
histogram (one entry for each length up to a sequence), so the plan is made from it alone: all
patterns of at most three lengths that fill a sequence exactly are fitted to the histogram by
non-negative least squares, repeat counts are rounded down, and what is left over is packed best
fit, still by length and count. Rows then find their place by their rank within their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, salted_rank, small_batches
from .encode import MEMO, encoder, tokenizer_path

LENGTH, SALTS = 2048, 64


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None, end_id: int = 0, memo: int = MEMO) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's pieces; the first piece is the short one."""
    path = path or tokenizer_path()
    small_batches(docs.sparkSession)

    def run(batches):
        enc, end = encoder(path, memo), int(end_id).to_bytes(4, "little")
        for b in batches:
            rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            texts = [t or "" for t in b.column("text").to_pylist()]
            for d, ids in zip(b.column("doc_id").to_pylist(), enc.encode(texts)):
                ids += end
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    to = (n % length or length) if k == 0 else at + length
                    for name, v in zip(rows, (d, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to]))):
                        rows[name].append(v)
                    at, k = to, k + 1
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long", keeps=("encoder",))


def fit_patterns(hist: np.ndarray, grain: int, rounds: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, repeats) by non-negative least squares over all multisets of at most three bins.

    ``hist`` counts lengths 0 to L. Bins are ``grain`` wide; a length counts as its bin's upper
    end, so a pattern always fits. x[a, b] repeats the pattern (a, b, B - a - b), where a bin of
    0 is no document. Solved by accelerated projected gradient on dense B x B arrays, whose size
    does not depend on the data.
    """
    top = len(hist) - 1
    bins = top // grain
    h = np.zeros(bins + 1)
    np.add.at(h, -(-np.arange(1, top + 1) // grain), hist[1:])
    total = h.sum()
    if not total or bins < 2:
        return []
    a, b = np.meshgrid(np.arange(bins + 1), np.arange(bins + 1), indexing="ij")
    c = bins - a - b
    ok = (c >= 0) & (a >= b) & (b >= c)
    a, b, c = a[ok], b[ok], c[ok]
    used = (h[a] > 0) & ((h[b] > 0) | (b == 0)) & ((h[c] > 0) | (c == 0))
    a, b, c = a[used], b[used], c[used]
    if not len(a):
        return []
    goal, w = h / total, 1 / np.sqrt(1 + np.arange(bins + 1))[::-1]  # long lengths first: they have few places

    def forward(x):
        y = np.bincount(a, x, bins + 1) + np.bincount(b, x, bins + 1) + np.bincount(c, x, bins + 1)
        y[0] = 0
        return y

    w = w / w.max()
    w2 = w * w
    w2[0] = 0
    v = np.ones(len(a))
    for _ in range(20):  # the largest eigenvalue gives the step
        g = w2 * forward(v)
        v = g[a] + g[b] + g[c]
        v /= (norm := np.linalg.norm(v)) or 1
    x, y, t = np.zeros(len(a)), np.zeros(len(a)), 1.0
    for _ in range(rounds):
        g = w2 * (forward(y) - goal)
        new = np.maximum(0, y - (g[a] + g[b] + g[c]) / (1.05 * norm))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    x *= total
    out, left = [], h.copy()
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 0.5:
            break
        lens = [k for k in (int(a[i]), int(b[i]), int(c[i])) if k]
        need = {k: lens.count(k) for k in lens}
        n = int(min([round(x[i]), *(left[k] // m for k, m in need.items())]))
        if n > 0:
            out.append((tuple(lens), n))
            for k, m in need.items():
                left[k] -= n * m
    return out


def plan(hist: np.ndarray, grain: int = 4) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places (length, first rank, end rank, first sequence, offset) for the histogram, and the number of sequences.

    Ranks r of a length stand in sequence first + r - first rank, at the offset. Pattern slots
    take the longest lengths of their bin; then best fit, by decreasing length, over kinds of
    sequences with equal room, those of the patterns included.
    """
    top, left, at, places, seqs = len(hist) - 1, hist.astype(np.int64).copy(), np.zeros(len(hist), np.int64), [], 0
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, count)

    def put(length: int, n: int, first: int, offset: int) -> None:
        places.append((length, int(at[length]), int(at[length]) + n, first, offset))
        at[length] += n
        left[length] -= n

    full = int(left[top])
    if full:
        put(top, full, 0, 0)
        seqs = full
    for lens, n in fit_patterns(left, grain):
        runs = [(seqs, n, 0)]  # first sequence, count, filled so far
        seqs += n
        for k in lens:
            new, real = [], [x for x in range(k * grain, (k - 1) * grain, -1) if x <= top]
            for first, many, offset in runs:
                while many:
                    x = next((x for x in real if left[x]), 0)
                    if not x:
                        new.append((first, many, offset))
                        break
                    take = int(min(many, left[x]))
                    put(x, take, first, offset)
                    new.append((first, take, offset + x))
                    first, many = first + take, many - take
            runs = new
        for first, many, offset in runs:
            rooms.setdefault(top - offset, []).append((first, many))
    open_rooms = np.zeros(top + 1, bool)
    open_rooms[[r for r in rooms if r]] = True
    for x in range(top - 1, 0, -1):
        while left[x]:
            fits = np.flatnonzero(open_rooms[x:])
            if not len(fits):
                n = int(left[x])
                per = top // x  # copies of this length side by side in new sequences
                whole, rest = divmod(n, per)
                for count, many in ((whole, per), (int(rest > 0), rest)):
                    if count:
                        for j in range(many):
                            put(x, count, seqs, j * x)
                        if room := top - many * x:
                            rooms.setdefault(room, []).append((seqs, count))
                            open_rooms[room] = True
                        seqs += count
                break
            room = x + int(fits[0])
            first, many = rooms[room].pop()
            take = int(min(many, left[x]))
            put(x, take, first, top - room)
            if many > take:
                rooms[room].append((first + take, many - take))
            if not rooms[room]:
                open_rooms[room] = False
            if room > x:
                rooms.setdefault(room - x, []).append((first, take))
                open_rooms[room - x] = True
    return places, seqs


def pack(parts: DataFrame, length: int = LENGTH, grain: int = 4) -> DataFrame:
    """Adds sequence_id and offset to rows that have a ``length``; order by doc_id and piece within a length.

    An empty table gives an empty result; a length is from 1 to ``length``.
    """
    spark, scratch = parts.sparkSession, Scratch(parts.sparkSession)
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS))
    ranked = scratch.keep(salted_rank(parts, ["length"], salt, [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]), "ranked")
    cells = sorted(tuple(r) for r in ranked.groupBy("length", "salt").count().collect())  # at most length x SALTS rows
    hist, base = np.zeros(length + 1, np.int64), np.zeros((length + 1, SALTS), np.int64)
    for n, s, count in cells:
        base[n, s] = hist[n]
        hist[n] += count
    places = sorted(plan(hist, grain)[0])
    starts = np.array([(p[0] << 44) + p[1] for p in places], np.int64)
    first, offset, lo = (np.array([p[i] for p in places], np.int64) for i in (3, 4, 1))
    at = spark.sparkContext.broadcast((base, starts, first, offset, lo))

    def run(batches):
        base, starts, first, offset, lo = at.value
        for b in batches:
            n, s, r = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "salt", "rank_in"))
            rank = base[n, s] + r
            k = np.searchsorted(starts, (n << 44) + rank, side="right") - 1
            cols = {c: b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": pa.array(first[k] + rank - lo[k]), "offset": pa.array(offset[k])})

    out = arrow_map(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out


def pack_documents(docs: DataFrame, length: int = LENGTH, path: str | None = None, end_id: int = 0, memo: int = MEMO) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and has the end id alone; a null doc_id stays null; repeated rows are packed
    each; an empty table gives an empty result. Pieces of one length are told apart by nothing but
    their id and number, so which of two repeated rows stands where is open. ``memo`` bounds the words
    that a worker remembers: fewer take less memory and more time, and change no id.
    """
    return pack(pieces(docs, length, path, end_id, memo), length)
