"""Removal of repeated passages by backward extension on a Burrows-Wheeler transform.

Every window of ``length`` bytes has an anchor: the K-byte string in it with the least hash,
leftmost. Equal windows have equal anchors at equal places, so windows are compared only within
the rows of one anchor. Runs of windows with one anchor are one row, and equal rows are one.

The rows of an anchor form one interval. It is expanded breadth first by what follows the anchor's
start: at value l an interval splits by byte l, and rows at a split have l bytes in common, so
common prefixes come by increasing value, up to ``length``, and the transform's rows at the anchor
stand in order. Then all intervals are extended backward at once, byte by byte: an interval splits
by the byte before its rows (the transform's column), and rows keep their order within it (the LF
mapping). An interval of level l has l bytes before the anchor in common; neighbours whose common
prefix reaches ``length`` repeat that window. Intervals of one row end; the expansion ends at the
level where ``length`` is full.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, process_cache, small_batches
from .words import mixed, text_bytes

LENGTH, K = 400, 128
#: Rows of an anchor that go through the transform in one task; more are compared by window hashes.
MOST = 20_000
#: Bytes of texts that are worked on at once.
PIECE = 1 << 18


_R, _INVERSE = np.uint64(0x9E3779B97F4A7C55), np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a number and of its inverse modulo 2^64, for rolling sums; kept for the next piece."""
    cache = process_cache()
    if len(cache.get("powers", [()])[0]) < n:
        ones, backs = np.full(max(n, PIECE + LENGTH), _R), np.full(max(n, PIECE + LENGTH), _INVERSE)
        ones[0] = backs[0] = 1
        cache["powers"] = np.cumprod(ones), np.cumprod(backs)
    return cache["powers"]


def _key() -> list:
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(7), "doc_id", "text").alias("k2")]


def _parts(offsets: np.ndarray, length: int):
    """(from, to, [(row, start in row, place of the piece)]): short texts together, long ones in overlapping pieces."""
    i, n = 0, len(offsets) - 1
    while i < n:
        size = offsets[i + 1] - offsets[i]
        if size > 8 * PIECE:
            for at in range(0, int(size) - length + 1, PIECE):
                yield int(offsets[i]) + at, int(offsets[i]) + min(int(size), at + PIECE + length - 1), np.array([i]), np.array([0, min(int(size), at + PIECE + length - 1) - at]), at
            i += 1
            continue
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= PIECE:
            j += 1
        yield int(offsets[i]), int(offsets[j]), np.arange(i, j), offsets[i : j + 1] - offsets[i], 0
        i = j


def anchored_rows(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K):
    """(row, first window, windows, anchor's distance from the first window, anchor hash, content hash) of each run of windows.

    The upper bits of rolling hashes choose the anchor; the lower bits of a key hold the place, so the
    least key of a window is that of its leftmost anchor. Strings that share a rolling hash share an
    anchor and are told apart by their bytes; content hashes equate rows and are xxHash.
    """
    span, low = length - k + 1, np.uint64((1 << 23) - 1)
    for a, b, rows, ends, base in _parts(offsets, length):
        x = raw[a:b]
        if len(x) < length:
            continue
        up, down = _powers(len(x) + 1)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=sums[1:])
        h = mixed((sums[k:] - sums[:-k]) * down[: len(x) - k + 1])
        n = len(h) - span + 1
        blocks = np.full(-(-len(h) // span) * span, ~np.uint64(0))
        blocks[: len(h)] = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        blocks = blocks.reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(back[:n], ahead[span - 1 : span - 1 + n]) & low).astype(np.int64)
        # runs end where the anchor changes or a window would leave its text
        new = np.ones(n, bool)
        np.not_equal(place[1:], place[:-1], out=new[1:])
        heads = ends[:-1]
        new[heads[heads < n]] = True
        stop = np.maximum(ends[1:] - length + 1, ends[:-1])  # first window of each text that does not fit
        new[stop[stop < n]] = True
        first = np.flatnonzero(new)
        stops = np.append(first[1:], n)
        row = np.searchsorted(ends, first, side="right") - 1
        keep = (first + length <= ends[row + 1]) & (stops > first)
        first, stops, row = first[keep], stops[keep], row[keep]
        if not len(first):
            continue
        end = stops + length - 1
        content = np.fromiter((xxhash.xxh3_64_intdigest(x[s:e]) for s, e in zip(first.tolist(), end.tolist())), np.uint64, len(first))
        at = place[first]
        yield rows[row], first - ends[row] + base, stops - first, at - first, h[at], content


class _Range:
    """Least values of ranges of an array, by a table of powers of two."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while 2 ** len(self.rows) <= len(x):
            y, s = self.rows[-1], 2 ** (len(self.rows) - 1)
            self.rows.append(np.minimum(y[:-s], y[s:]))
        self.log = np.frexp(np.arange(len(x) + 2))[1] - 1
        width = len(x)
        self.table = np.full((len(self.rows), width), np.iinfo(np.int32).max, np.int32)
        for r, y in enumerate(self.rows):
            self.table[r, : len(y)] = y

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """min of x[lo:hi], hi > lo."""
        p = self.log[hi - lo]
        return np.minimum(self.table[p, lo], self.table[p, hi - (1 << p)])


def expanded(groups: np.ndarray, wide: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by group and bytes, and what each has in common with the row above it in its group (0 for the first).

    ``wide`` has a row's bytes, ``size`` their number. Intervals are split breadth first, by
    increasing length of the common prefix; an interval of one row is done.
    """
    order = np.argsort(groups, kind="stable")
    common = np.zeros(len(order), np.int32)
    interval = np.cumsum(np.append(True, np.diff(groups[order]) != 0)) if len(order) else order
    live = np.arange(len(order))
    for value in range(wide.shape[1] + 1):
        same = interval[live[1:]] == interval[live[:-1]]
        live = live[np.append(False, same) | np.append(same, False)] if len(live) else live
        if not len(live):
            break
        rows, own = order[live], interval[live]
        ended = size[rows] <= value
        byte = np.where(ended, 0, wide[rows, min(value, wide.shape[1] - 1)].astype(np.int64) + 1)
        same = own[1:] == own[:-1]
        if not ended.any() and (byte[1:] == byte[:-1])[same].all():
            continue
        key = own * 257 + byte
        by = np.argsort(key, kind="stable")
        order[live], key = rows[by], key[by]
        ended = ended[by]
        cut = np.append(False, same & ((key[1:] != key[:-1]) | ended[1:]))
        common[live[cut]] = value
        # rows that end here are equal: each is an interval of its own from now on
        interval[live] = np.cumsum(np.append(True, (key[1:] != key[:-1]) | ended[1:])) + len(order) * (value + 1)
    return order, common


def repeated_windows(groups: np.ndarray, texts: list[bytes], places: np.ndarray, length: int = LENGTH, k: int = K) -> np.ndarray:
    """marks[i, l]: the window that starts l bytes before row i's anchor is in another row of its group too.

    ``places`` has the anchor's start in each text.
    """
    n, span = len(texts), length - k
    marks = np.zeros((n, span + 1), bool)
    wide = np.zeros((n, length), np.uint8)
    size = np.zeros(n, np.int64)
    before = np.zeros((n, span), np.uint8)  # the bytes before the anchor, the nearest first
    left = np.minimum(places, span)
    for i, (t, p) in enumerate(zip(texts, places.tolist())):
        x = np.frombuffer(t, np.uint8)
        size[i] = min(length, len(x) - p)
        wide[i, : size[i]] = x[p : p + length]
        before[i, : left[i]] = x[p - left[i] : p][::-1]
    order, common = expanded(groups, wide, size)
    before, left, group = before[order], left[order], groups[order]
    ranges = _Range(common)
    rows = np.arange(n)  # rows of the transform that are in intervals of two and more, in order
    interval = np.cumsum(np.append(True, group[1:] != group[:-1])) if n else rows
    for level in range(span + 1):
        same = interval[1:] == interval[:-1]
        keep = np.append(False, same) | np.append(same, False) if len(rows) else np.zeros(0, bool)
        rows, interval = rows[keep], interval[keep]
        if not len(rows):
            break
        at = np.flatnonzero(interval[1:] == interval[:-1])
        shared = ranges.least(rows[at] + 1, rows[at + 1] + 1)
        hit = at[shared + level >= length]
        marks[order[rows[hit]], level] = True
        marks[order[rows[hit + 1]], level] = True
        if level == span:
            break
        # backward extension: rows without a byte before them end
        more = left[rows] > level
        rows, interval = rows[more], interval[more]
        if not len(rows):
            break
        column = interval.astype(np.int64) * 256 + before[rows, level]
        by = np.argsort(column, kind="stable")
        rows, column = rows[by], column[by]
        interval = np.cumsum(np.append(True, column[1:] != column[:-1]))
    return marks


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


_ROWS = "k1 long, k2 long, start int, windows int, place int, anchor long, content long"


def _scan(docs: DataFrame, length: int, k: int) -> DataFrame:
    def run(batches):
        for b in batches:
            raw, offsets = text_bytes(b.column("text"))
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            for row, start, windows, place, anchor, content in anchored_rows(raw, offsets, length, k):
                cols = (k1[row], k2[row], start.astype(np.int32), windows.astype(np.int32), place.astype(np.int32), anchor.view(np.int64), content.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k1", "k2", "start", "windows", "place", "anchor", "content"])

    return arrow_map(docs.filter("text IS NOT NULL").select(*_key(), "text"), run, _ROWS, keeps=("powers",))


def _filter_by(df: DataFrame, column: str, ids: DataFrame, bits: int = 1 << 22) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be in ``ids`` (column id): a bit table of a fixed size is broadcast."""
    own, h = F.pmod(F.xxhash64("id"), F.lit(bits)), F.pmod(F.xxhash64(column), F.lit(bits))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64({c}), {bits}L) % 64 as int))")
    table = ids.select((own / 64).cast("int").alias("_w"), bit("id").alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_bits"))
    return df.withColumn("_w", (h / 64).cast("int")).join(F.broadcast(table), "_w").filter(F.col("_bits").bitwiseAND(bit(column)) != 0).drop("_w", "_bits")


def _texts(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """anchor, content, place, windows and bytes of rows (k1, k2, start, ...)."""
    wanted = rows.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "content", "start", "place", "windows")).alias("rows"))
    few = _filter_by(docs.filter("text IS NOT NULL").select(*_key(), "text"), "k1", rows.select(F.col("k1").alias("id")).distinct())
    held = few.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])

    def run(batches):
        for b in batches:
            raw, offsets = text_bytes(b.column("text"))
            own = b.column("rows")
            which = np.repeat(np.arange(b.num_rows), np.diff(own.offsets.to_numpy()))
            flat = own.flatten()
            start = offsets[which] + flat.field("start").to_numpy()
            end = start + flat.field("windows").to_numpy() + length - 1
            data = pa.array([raw[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([flat.field("anchor"), flat.field("content"), flat.field("place"), flat.field("windows"), data], names=["anchor", "content", "place", "windows", "data"])

    return arrow_map(held.select("text", "rows"), run, "anchor long, content long, place int, windows int, data binary")


def _expand(texts: DataFrame, length: int, k: int) -> DataFrame:
    """anchor, content, runs: from and to of the first bytes of repeated windows, counted from the row's first."""

    def work(rows: list) -> pa.RecordBatch:
        anchor = np.array([r[0] for r in rows], np.int64)
        places = np.array([r[2] for r in rows], np.int64)
        marks = repeated_windows(anchor, [r[4] for r in rows], places, length, k)
        out = {"anchor": [], "content": [], "lo": [], "hi": []}
        for r, m, p in zip(rows, marks, places.tolist()):
            mask = m[: p + 1][::-1][: r[3]]  # by window: the first is the one farthest before the anchor
            for lo, hi in _runs(mask):
                for name, v in zip(out, (r[0], r[1], lo, hi)):
                    out[name].append(v)
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches):
        held, size = [], 0
        for b in batches:  # sorted by anchor: whole groups together, a few MB at once
            for r in zip(*[b.column(c).to_pylist() for c in ("anchor", "content", "place", "windows", "data")]):
                if size > 4_000_000 and held[-1][0] != r[0]:
                    yield work(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            yield work(held)

    spread = texts.repartition("anchor").sortWithinPartitions("anchor", "content")
    return arrow_map(spread, run, "anchor long, content long, lo int, hi int")


def _count_windows(texts: DataFrame, length: int) -> DataFrame:
    """The same by counting hashes of windows, for anchors with too many rows for one task."""

    def run(batches):
        for b in batches:
            for a, c, w, t in zip(*[b.column(x).to_pylist() for x in ("anchor", "content", "windows", "data")]):
                d = [hashlib.blake2b(t[i : i + length], digest_size=16).digest() for i in range(w)]
                yield pa.RecordBatch.from_pydict({"anchor": pa.array([a] * w), "content": pa.array([c] * w), "lo": pa.array(range(w), pa.int32()), "d": pa.array(d, pa.binary())})

    windows = arrow_map(texts, run, "anchor long, content long, lo int, d binary")
    again = windows.groupBy("d").count().filter("count > 1").select("d")
    return windows.join(again, "d", "leftsemi").select("anchor", "content", "lo", (F.col("lo") + 1).alias("hi"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans and kept (the remaining bytes) to ``docs``.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the
    same text or another; strings overlap freely and are judged on the input. A null text counts
    as empty. Repeated rows repeat each other's strings. Texts shorter than ``length`` stay. Columns
    with the names of the added ones give way.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    own = docs.select("doc_id", "text")
    rows = scratch.keep(_scan(own, length, k), "rows")
    kinds = rows.groupBy("anchor", "content", "place", "windows").agg(F.count("*").alias("copies"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("start").alias("start"))
    kinds = scratch.keep(kinds, "kinds")
    scratch.release()
    anchors = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"))
    several = kinds.join(anchors.filter("kinds > 1"), "anchor")
    texts = scratch.keep(_texts(own, several.drop("copies"), length).join(anchors.filter("kinds > 1"), "anchor"), "texts")
    few, many = texts.filter(F.col("kinds") <= MOST).drop("kinds"), texts.filter(F.col("kinds") > MOST).drop("kinds")
    found = _expand(few, length, k)
    if not many.isEmpty():
        found = found.union(_count_windows(many, length))
    whole = kinds.filter("copies > 1").select("anchor", "content", F.lit(0).alias("lo"), F.col("windows").alias("hi"))
    found = scratch.keep(found.union(whole), "found")
    hit = _filter_by(rows, "anchor", found.select(F.col("anchor").alias("id")).distinct()).join(found, ["anchor", "content"])
    spans = hit.select("k1", "k2", (F.col("start") + F.col("lo")).alias("a"), (F.col("start") + F.col("hi") - 1 + length).alias("b"))
    spans = scratch.keep(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    scratch.drop("rows", "kinds", "texts", "found")
    scratch.release()
    return _cut(docs, spans)


def _cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    keyed = docs.withColumns({"_k1": F.xxhash64("doc_id", "text"), "_k2": F.xxhash64(F.lit(7), "doc_id", "text")})
    bits = 1 << 22
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64({c}), {bits}L) % 64 as int))")
    word = lambda c: (F.pmod(F.xxhash64(c), F.lit(bits)) / 64).cast("int").alias("_w")
    table = spans.select(word("k1"), bit("k1").alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_bits"))
    flagged = keyed.withColumn("_w", word("_k1")).join(F.broadcast(table), "_w", "left").withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit("_k1")) != 0, F.lit(False)))
    clean = flagged.filter("NOT _maybe")
    dirty = flagged.filter("_maybe").join(spans.toDF("_k1", "_k2", "_spans"), ["_k1", "_k2"], "left")
    names = docs.columns
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    clean = clean.select(*names, F.length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), text.alias("kept"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        for b in batches:
            raw, offsets = text_bytes(b.column("text"))
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for i, spans in enumerate(b.column("_spans").to_pylist()):
                x, gone, end, n = raw[offsets[i] : offsets[i + 1]], [], -1, 0
                for s in sorted((s["a"], s["b"]) for s in spans or ()):
                    if s[0] > end:
                        gone.append(list(s))
                    elif s[1] > end:
                        gone[-1][1] = s[1]
                    end = max(end, s[1])
                keep, at = [], 0
                for a, e in gone:
                    keep.append(x[at:a].tobytes())
                    n, at = n + e - a, e
                keep.append(x[at:].tobytes())
                for name, v in zip(out, (len(x), n, len(gone), b"".join(keep))):
                    out[name].append(v)
            types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in names} | {c: pa.array(v, types[c]) for c, v in out.items()})

    dirty = arrow_map(dirty.select(*names, *(["text"] if "text" not in names else []), "_spans"), run, kinds + ", n_bytes long, n_removed long, n_spans long, kept binary")
    return clean.union(dirty)
