"""k-mer tables, histograms, profiles and set similarity."""

from __future__ import annotations

import math
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seqs

#: Fixed value: the largest count of histograms and profiles.
TOP = 32767
#: Starts of k-mers in a tile.
TILE = 256
#: Bases that fit in a key of 64 bits, two bits each; bases and keys that one count is made of.
PACKED, SMALL, KEYS = 31, 11, 1 << 20
#: Bytes of texts that are packed at once.
PIECE = 1 << 20
#: Bases whose k-mers a task counts at once, and ranges of k-mers (as a power of two) that counts meet in.
CHUNK, RANGES = 1 << 23, 11
#: Bits of a table that tells which keys surely are not in a set, as a power of two.
BITS = 24
_CODE = np.full(256, 4, np.uint8)
_CODE[[65, 67, 71, 84]] = range(4)
_BASE = np.frombuffer(b"ACGT", np.uint8)
#: Four bases as a word of md5, by their key.
_FOUR = sum(_BASE[(np.arange(256) >> 6 - 2 * i) & 3].astype(np.uint32) << np.uint32(8 * i) for i in range(4))
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MD5_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_MD5_TURN = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))


def _places(df: DataFrame, k: int, text: str = "seq") -> DataFrame:
    """name, off, kmer of all k-mers; sequences are cut in tiles first, since a substring far in a text costs its way there."""
    n = F.length(text)
    cut = df.filter(n >= k).select("name", text, F.explode(F.sequence(F.lit(0), n - k, F.lit(TILE))).alias("_base"))
    tiles = cut.select("name", "_base", F.substring(text, F.col("_base") + 1, F.lit(TILE + k - 1)).alias("_tile"))
    rows = tiles.select("name", "_base", F.posexplode(seqs.kmers(F.col("_tile"), k)).alias("_i", "kmer"))
    return rows.select("name", (F.col("_base") + F.col("_i")).alias("off"), "kmer")


def occurrences(df: DataFrame, k: int, canonical: bool = True) -> DataFrame:
    """name, off (0-based) and kmer of every k-mer of ACGT only."""
    rows = _places(df, k)
    rows = rows.filter(F.length(F.translate("kmer", "ACGT", "")) == 0)
    return rows.withColumn("kmer", seqs.canonical(F.col("kmer"))) if canonical else rows


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _keys(raw: np.ndarray, offsets: np.ndarray, k: int, canonical: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all windows of k bytes, and which of them are k-mers of ACGT inside a text.

    A key has two bits a base, so numbers stand in the order of the strings. Runs of a power of two
    bases are joined to runs of k, forward and as reverse complement.
    """
    n = len(raw) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    code = _CODE[raw]
    bad = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(code > 3, out=bad[1:])
    fine = bad[k:] == bad[:-k]
    for end in offsets[1:-1]:  # a window that starts before a text's end and goes beyond it
        fine[max(0, end - k + 1) : end] = False
    one = (code & 3).astype(np.int64)
    runs, size = (one, 3 - one), 1
    ahead, done = None, 0
    while True:
        if k & size:
            if ahead is None:
                ahead, done = runs, size
            else:
                m = len(raw) - done - size + 1
                ahead = (ahead[0][:m] << 2 * size | runs[0][done : done + m], runs[1][done : done + m] << 2 * done | ahead[1][:m])
                done += size
        if 2 * size > k:
            break
        m = len(raw) - 2 * size + 1
        runs = (runs[0][:m] << 2 * size | runs[0][size : size + m], runs[1][size : size + m] << 2 * size | runs[1][:m])
        size *= 2
    return np.minimum(*ahead) if canonical else ahead[0], fine


def pack(raw: np.ndarray, offsets: np.ndarray, k: int, canonical: bool = True) -> np.ndarray:
    """Keys of all k-mers of ACGT in texts."""
    keys, fine = _keys(raw, offsets, k, canonical)
    return keys[fine]


def _placed(raw: np.ndarray, offsets: np.ndarray, k: int, canonical: bool = True):
    """Place and key of all k-mers of ACGT in texts, about ``PIECE`` at a time."""
    for at in range(0, len(raw), PIECE):
        end = min(len(raw), at + PIECE + k - 1)
        first, last = np.searchsorted(offsets, at, "right"), np.searchsorted(offsets, end, "left")
        keys, fine = _keys(raw[at:end], np.concatenate([[0], offsets[first:last] - at, [end - at]]), k, canonical)
        places = np.flatnonzero(fine)
        yield places + at, keys[places]


def _pieces(column: pa.Array, k: int, canonical: bool = True):
    """Row, place and key of all k-mers of ACGT of a string column, about ``PIECE`` at a time; places are bytes."""
    raw, offsets = _bytes(column)
    for places, keys in _placed(raw, offsets, k, canonical):
        row = np.searchsorted(offsets, places, "right") - 1
        yield row, places - offsets[row], keys


def md5_60(keys: np.ndarray, k: int) -> np.ndarray:
    """hash60 of k-mers (k up to 31) from their keys: one block of md5 for all of them at once."""
    out = np.empty(len(keys), np.int64)
    for at in range(0, len(keys), 1 << 14):
        out[at : at + (1 << 14)] = _md5_block(keys[at : at + (1 << 14)], k)
    return out


def _md5_block(keys: np.ndarray, k: int) -> np.ndarray:
    words = {14: 8 * k, k // 4: 0x80 << 8 * (k % 4)}
    for j in range(k // 4):
        words[j] = _FOUR[(keys >> 2 * (k - 4 * j - 4)) & 255]
    if k % 4:  # the last bases come first in the word, then the byte that ends a message
        mask = (1 << 8 * (k % 4)) - 1
        words[k // 4] = (_FOUR[(keys << 2 * (4 - k % 4)) & 255] & np.uint32(mask)) | np.uint32(0x80 << 8 * (k % 4))
    a, b, c, d = (np.full(len(keys), x, np.uint32) for x in _MD5_START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word = words.get(g, 0)
        f += a
        f += np.uint32((_MD5_ADD[i] + (word if isinstance(word, int) else 0)) & 0xFFFFFFFF)
        if not isinstance(word, int):
            f += word
        turn = _MD5_TURN[i // 16][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=t)
        np.left_shift(f, np.uint32(turn), out=f)
        np.bitwise_or(f, t, out=f)
        f += b
        a, d, c, b, f = d, c, b, f, a
    head = (a + np.uint32(_MD5_START[0])).byteswap().astype(np.int64) << 28
    return head | (b + np.uint32(_MD5_START[1])).byteswap().astype(np.int64) >> 4


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def bit_table(keys: DataFrame) -> bytes:
    """A bit table of the column ``key``; its size is fixed, whatever the number of keys."""

    def run(batches):
        table = np.zeros(1 << BITS, bool)
        for b in batches:
            table[_slots(b.column("key").to_numpy())] = True
        words = np.packbits(table, bitorder="little").view(np.int64)
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_pydict({"w": pa.array(used.astype(np.int32)), "bits": pa.array(words[used])})

    words = keys.select("key").mapInArrow(run, "w int, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << BITS - 6, np.int64)
    table[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return table.tobytes()


def keyed(df: DataFrame, k: int, canonical: bool = True, among: bytes | None = None) -> DataFrame:
    """name, off (0-based) and key of every k-mer of ACGT only (k up to 31, texts of ASCII letters).

    With a bit table ``among``, k-mers that surely are not in its set never leave their task.
    """

    def run(batches):
        table = None if among is None else np.unpackbits(np.frombuffer(among, np.uint8), bitorder="little").view(bool)
        for b in batches:
            for row, off, key in _pieces(b.column("seq"), k, canonical):
                if table is not None:
                    held = np.flatnonzero(table[_slots(key)])
                    row, off, key = row[held], off[held], key[held]
                yield pa.RecordBatch.from_pydict({"name": b.column("name").take(pa.array(row)), "off": pa.array(off), "key": pa.array(key)})

    return df.select("name", "seq").mapInArrow(run, "name string, off long, key long")


def hashed(df: DataFrame, k: int, below: int) -> DataFrame:
    """name, h: distinct hashes under ``below`` of the canonical k-mers of ACGT of a name (k up to 31)."""

    def run(batches):
        for b in batches:
            for row, _, key in _pieces(b.column("seq"), k):
                h = md5_60(key, k)
                held = np.flatnonzero(h < below)
                held = held[np.lexsort((h[held], row[held]))]
                first = np.ones(len(held), bool)
                first[1:] = (np.diff(row[held]) != 0) | (np.diff(h[held]) != 0)
                held = held[first]
                yield pa.RecordBatch.from_pydict({"name": b.column("name").take(pa.array(row[held])), "h": pa.array(h[held])})

    return df.select("name", "seq").mapInArrow(run, "name string, h long").distinct()


def sketches(df: DataFrame, k: int, size: int) -> DataFrame:
    """name, hs: the ``size`` least distinct hashes of a name's canonical k-mers of ACGT (k up to 31), in order."""

    def least(h):
        some = np.unique(np.partition(h, 2 * size)[: 2 * size]) if len(h) > 4 * size else h
        return some[:size] if size <= len(some) < len(h) else np.unique(h)[:size]

    def run(batches):
        for b in batches:
            for row, _, key in _pieces(b.column("seq"), k):
                if not len(row):
                    continue
                h = md5_60(key, k)
                cuts = np.flatnonzero(np.diff(row)) + 1
                own = [least(x) for x in np.split(h, cuts)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"name": b.column("name").take(pa.array(row[np.concatenate([[0], cuts])])), "hs": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))})

    parts = df.select("name", "seq").mapInArrow(run, "name string, hs array<long>").groupBy("name").agg(F.flatten(F.collect_list("hs")).alias("hs"))
    return parts.select("name", F.slice(F.array_sort(F.array_distinct("hs")), 1, size).alias("hs"))


def _held_twice(df: DataFrame, k: int) -> bytes:
    """A bit for each k-mer (k up to SMALL, as it stands) that two names hold.

    A task gives a table of those that two of its names hold, and of the others the one name.
    """

    def run(batches):
        own, many, ids = np.full(4**k, -1, np.int32), np.zeros(4**k, bool), {}
        for b in batches:
            name = np.array([ids.setdefault(x, len(ids)) for x in b.column("name").to_pylist()], np.int32)
            for row, _, key in _pieces(b.column("seq"), k, False):
                here = name[row]
                new = own[key] < 0
                own[key[new]] = here[new]
                many[key[own[key] != here]] = True
        names = pa.array(list(ids), pa.string())
        both, one = np.flatnonzero(many), np.flatnonzero((own >= 0) & ~many)
        for keys, held in ((both, pa.nulls(len(both), pa.string())), (one, names.take(pa.array(own[one])))):
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.astype(np.int32)), "name": held})

    found = df.select("name", "seq").mapInArrow(run, "key int, name string").groupBy("key")
    found = found.agg(F.max(F.col("name").isNull()).alias("many"), F.min("name").alias("a"), F.max("name").alias("z")).filter("many OR a < z")
    table = np.zeros(4**k, bool)
    table[found.select("key").toArrow().column("key").to_numpy()] = True
    return np.packbits(table).tobytes()


def shared_runs(df: DataFrame, k: int) -> DataFrame:
    """name, s, e (1-based) of runs under k-mers of ACGT (k up to SMALL, as they stand) that two names hold; runs may meet."""
    common = _held_twice(df, k)

    def run(batches):
        table = np.unpackbits(np.frombuffer(common, np.uint8))[: 4**k].astype(bool)
        for b in batches:
            for row, off, key in _pieces(b.column("seq"), k, False):
                held = np.flatnonzero(table[key])
                yield _runs(b.column("name"), row[held], off[held], k)

    return df.select("name", "seq").mapInArrow(run, "name string, s long, e long")


def _runs(names: pa.Array, row: np.ndarray, off: np.ndarray, k: int, gap: int = 0) -> pa.RecordBatch:
    """Windows of k at places in order, joined where they touch, overlap or are up to ``gap`` apart."""
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(off) > k + gap)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1 if len(first) else first
    return pa.RecordBatch.from_pydict({"name": names.take(pa.array(row[first])), "s": pa.array(off[first] + 1), "e": pa.array(off[last] + k)})


def packed(df: DataFrame, k: int, canonical: bool = True) -> DataFrame:
    """key, n of the k-mers (k up to 31); tasks count what they have before the shuffle, in bounded memory."""

    def run(batches):
        total, held, size = np.zeros(4**k if k <= SMALL else 0, np.int64), [], 0

        def counted():
            keys, many = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"key": pa.array(keys), "n": pa.array(many.astype(np.int64))})

        for b in batches:
            keys = pack(*_bytes(b.column("seq")), k, canonical)
            if k <= SMALL:
                total += np.bincount(keys, minlength=len(total))
                continue
            held.append(keys)
            size += len(keys)
            if size >= 4 * KEYS:
                yield counted()
                held, size = [], 0
        if k <= SMALL:
            keys = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.astype(np.int64)), "n": pa.array(total[keys])})
        elif held:
            yield counted()

    return df.select("seq").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def unpacked(keys: DataFrame, k: int) -> DataFrame:
    """The column ``key`` as strings, kmer."""
    rest = [f for f in keys.schema.fields if f.name != "key"]

    def run(batches):
        for b in batches:
            key = b.column("key").to_numpy()
            text = _BASE[np.stack([(key >> 2 * i) & 3 for i in range(k - 1, -1, -1)], axis=1)] if len(key) else np.zeros((0, k), np.uint8)
            ends = np.arange(len(key) + 1, dtype=np.int32) * k
            kmer = pa.StringArray.from_buffers(len(key), pa.py_buffer(ends.tobytes()), pa.py_buffer(text.tobytes()))
            yield pa.RecordBatch.from_pydict({"kmer": kmer} | {f.name: b.column(f.name) for f in rest})

    return keys.mapInArrow(run, ", ".join(["kmer string", *[f"{f.name} {f.dataType.simpleString()}" for f in rest]]))


def table(df: DataFrame, k: int, canonical: bool = True) -> DataFrame:
    """kmer, n; partial counts before the shuffle."""
    if k <= PACKED:
        return unpacked(packed(df, k, canonical), k)
    return occurrences(df, k, canonical).groupBy("kmer").agg(F.count("*").alias("n"))


def histogram(tab: DataFrame) -> DataFrame:
    return tab.groupBy(F.least("n", F.lit(TOP)).cast("long").alias("depth")).agg(F.count("*").alias("kmers"))


def gc_matrix(tab: DataFrame, top: int) -> DataFrame:
    gc = seqs.count_of(F.col("kmer"), "GC")
    return tab.groupBy(gc.alias("gc"), F.least("n", F.lit(top)).cast("long").alias("depth")).agg(F.count("*").alias("kmers"))


def profile(df: DataFrame, tab: DataFrame, k: int) -> DataFrame:
    """name, off, n of every position that starts a k-mer; 0 where it holds other letters or is not in the table."""
    rows = _places(df, k).withColumn("kmer", seqs.canonical(F.col("kmer")))
    return rows.join(tab, "kmer", "left").select("name", F.col("off").cast("long").alias("off"), F.least(F.coalesce("n", F.lit(0)), F.lit(TOP)).cast("long").alias("n"))


def quality_histogram(df: DataFrame, k: int, threshold: int, cap: int = 127) -> DataFrame:
    """Histogram of k-mers of reads (name, seq, qual; Phred + 33): a k-mer counts its good occurrences if any, else all its others."""
    if k <= SMALL:
        by = _quality_counts(df, k, threshold)
    else:
        good = F.transform(seqs.kmers(F.col("qual"), k), lambda q: F.length(F.regexp_replace(q, f"[{chr(92)}{chr(92)}x{33 + threshold:02x}-~]", "")) == 0)
        rows = df.select(F.explode(F.arrays_zip(seqs.kmers(F.col("seq"), k).alias("kmer"), good.alias("good"))).alias("x")).select(seqs.canonical(F.col("x.kmer")).alias("kmer"), "x.good")
        rows = rows.filter(F.length(F.translate("kmer", "ACGT", "")) == 0)
        by = rows.groupBy("kmer").agg(F.sum(F.col("good").cast("int")).alias("high"), F.sum((~F.col("good")).cast("int")).alias("low"))
    n = F.least(F.when(F.col("high") > 0, F.col("high")).otherwise(F.col("low")), F.lit(min(cap, 1000)))
    return by.groupBy(n.cast("long").alias("depth")).agg(F.count("*").alias("kmers"))


def _quality_counts(df: DataFrame, k: int, threshold: int) -> DataFrame:
    """key, high, low: good and other occurrences of each k-mer of reads; tasks count before the shuffle.

    Reads that do not have a quality of one byte for each base are an error.
    """

    def run(batches):
        total = np.zeros((2, 4**k), np.int64)
        for b in batches:
            (raw, offsets), (qual, places) = _bytes(b.column("seq")), _bytes(b.column("qual"))
            if not np.array_equal(offsets, places):
                raise ValueError("a read and its qualities differ in length")
            fine = (qual >= 33 + threshold) & (qual <= 126)
            # a base of low quality is masked: what pack leaves out then, but has of the read as it is, is not good
            high = np.bincount(pack(np.where(fine, raw, 78).astype(np.uint8), offsets, k), minlength=4**k)
            total[0] += high
            total[1] += np.bincount(pack(raw, offsets, k), minlength=4**k) - high
        keys = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys.astype(np.int64)), "high": pa.array(total[0][keys]), "low": pa.array(total[1][keys])})

    ascii_ = [F.regexp_replace(c, r"[^\x00-\x7F]", x).alias(c) for c, x in (("seq", "N"), ("qual", " "))]  # a character is a byte
    return df.select(*ascii_).mapInArrow(run, "key long, high long, low long").groupBy("key").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))


def hash60(x: Column) -> Column:
    """The first 60 bits of md5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")


def minimizers(df: DataFrame, k: int) -> DataFrame:
    """name, h: distinct hashes of all k-mers of a record (window 1), as they stand; a k-mer is k characters."""

    def run(batches):
        for b in batches:
            held, size = [], 0
            for name, seq in zip(b.column("name").to_pylist(), b.column("seq").to_pylist()):
                if len(seq or "") < k:
                    continue
                h = _character_hashes(seq, k)
                held.append((name, np.unique(h).view(np.int64)))
                size += len(held[-1][1])
                if size >= KEYS:
                    yield _named(held)
                    held, size = [], 0
            if held:
                yield _named(held)

    return df.select("name", "seq").mapInArrow(run, "name string, h long").repartition("name").distinct()  # one shuffle for this and sums by name


def _character_hashes(text: str, k: int) -> np.ndarray:
    """A hash of each run of k characters: of a byte each, or of four each where one has no code below 256."""
    if text.isascii():
        return _window_hashes(np.frombuffer(text.encode(), np.uint8), k)
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    wide = np.concatenate([[0], np.cumsum(code > 255)])
    h, far = _window_hashes(code.astype(np.uint8), k), wide[k:] > wide[:-k]
    if far.any():
        h[far] = _window_hashes(code.view(np.uint8), 4 * k)[::4][far]
    return h


def _named(held: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
    row = np.repeat(np.arange(len(held)), [len(h) for _, h in held])
    return pa.RecordBatch.from_pydict({"name": pa.array([n for n, _ in held], pa.string()).take(pa.array(row)), "h": pa.array(np.concatenate([h for _, h in held]))})


def syncmers(df: DataFrame, s: int, w: int) -> DataFrame:
    """name, off, h: the s-mers at an end of a window of w that hold its least hash; the first end wins ties."""
    rows = _places(df, s).withColumn("h", hash60(F.col("kmer")))
    order = Window.partitionBy("name").orderBy("off")
    rows = rows.withColumn("least", F.min("h").over(order.rowsBetween(0, w - 1))).withColumn("last", F.lead("h", w - 1).over(order)).filter("last IS NOT NULL")
    end = F.when(F.col("h") == F.col("least"), F.col("off")).when(F.col("last") == F.col("least"), F.col("off") + w - 1)
    return rows.withColumn("off", end).filter("off IS NOT NULL").select("name", F.col("off").cast("long").alias("off"), F.col("least").alias("h")).distinct()


def bottom(hashes: DataFrame, size: int) -> DataFrame:
    """The ``size`` least hashes of each name; ranks are limited before the shuffle."""
    w = Window.partitionBy("name").orderBy("h")
    return hashes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= size)


def fraction(hashes: DataFrame, scale: int) -> DataFrame:
    return hashes.filter(F.col("h") < (1 << 60) // scale)


def similarity(hashes: DataFrame, k: int) -> DataFrame:
    """Pairs n1 < n2 of names that share hashes: Jaccard, containment in n1, Mash distance to four places.

    Names with equal hash sets are one class while hashes are joined, so copies cost no pairs; a class
    shares its whole set with itself. Hashes that the same classes hold, as those of a passage, are
    joined once, with their number as weight; hashes of one class are not joined.
    """
    totals = hashes.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("h")).alias("b"))
    rep = totals.groupBy("n", "a", "b").agg(F.min("name").alias("rep"))
    members = totals.join(rep, ["n", "a", "b"]).select("name", "rep", "n")
    own = hashes.join(rep.select(F.col("rep").alias("name")), "name", "leftsemi").repartition("h")
    held = own.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.xxhash64("name").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "name")).alias("b")).filter("n > 1")
    once = held.groupBy("n", "a", "b").agg(F.min("h").alias("h"), F.count("*").alias("w")).select("h", "w")
    rows = own.join(once, "h")
    x, y = rows.select("h", "w", F.col("name").alias("r1")), rows.select("h", F.col("name").alias("r2"))
    shared = x.join(y, "h").filter("r1 < r2").groupBy("r1", "r2").agg(F.sum("w").alias("shared"))
    shared = shared.union(members.groupBy("rep").agg(F.count("*").alias("c"), F.first("n").alias("n")).filter("c > 1").select("rep", "rep", "n"))
    both = shared.union(shared.filter("r1 <> r2").select("r2", "r1", "shared"))
    pairs = both.join(members.select(F.col("rep").alias("r1"), F.col("name").alias("n1"), F.col("n").alias("t1")), "r1").join(members.select(F.col("rep").alias("r2"), F.col("name").alias("n2"), F.col("n").alias("t2")), "r2").filter("n1 < n2")
    j = F.col("shared") / (F.col("t1") + F.col("t2") - F.col("shared"))
    mash = F.least(F.lit(1.0), -F.log(2 * j / (1 + j)) / k)
    return pairs.select("n1", "n2", F.col("shared").cast("long").alias("shared"), F.round(j, 4).alias("jaccard"), F.round(F.col("shared") / F.col("t1"), 4).alias("containment"), F.round(F.greatest(mash, F.lit(0.0)), 4).alias("mash"))


def repeats(df: DataFrame, k: int, least: int, gap: int = 0) -> DataFrame:
    """name, s, e (1-based) of positions under k-mers with at least ``least`` occurrences, before unions.

    Up to PACKED bases they come as runs, in which holes of up to ``gap`` may be filled. A task counts the
    k-mers of a chunk of texts, and sends each distinct one once, in order, as its distance from the one
    before; what comes back is a bit for each.
    """
    if k > PACKED or k < 6 or least > 1 << RANGES:
        rows = occurrences(df, k)
        common = rows.groupBy("kmer").count().filter(F.col("count") >= least).select("kmer")
        return rows.join(common, "kmer", "leftsemi").select("name", (F.col("off") + 1).cast("long").alias("s"), (F.col("off") + k).cast("long").alias("e"))
    df, size = df.select("name", "seq"), CHUNK

    def count(batches):
        for chunk, _, _, raw, offsets in _chunks(batches, k, size):
            yield _counted(chunk, raw, offsets, k, least)

    def meet(batches):
        for _, rows in groupby(_rows(batches), key=lambda r: r["bucket"]):
            yield from _met(list(rows), least)

    def texts(batches):
        for chunk, names, bases, raw, offsets in _chunks(batches, k, size):
            code = _CODE[raw]
            packed = bool((code < 4).all())
            if packed:
                code = np.concatenate([code, np.zeros(-len(code) % 4, np.uint8)])
                raw = code[0::4] << 6 | code[1::4] << 4 | code[2::4] << 2 | code[3::4]
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "bucket": -1, "bits": raw.tobytes(), "packed": packed, "names": names, "bases": bases, "ends": offsets.tolist()}], _TEXTS)

    def back(batches):
        for chunk, rows in groupby(_rows(batches), key=lambda r: r["chunk"]):
            text, *bits = rows
            if text["bucket"] != -1:
                raise ValueError(f"the texts of chunk {chunk} were not read alike twice")
            offsets = np.array(text["ends"], np.int64)
            raw = np.frombuffer(text["bits"], np.uint8)
            if text["packed"]:
                raw = _BASE[np.stack([raw >> 6, raw >> 4 & 3, raw >> 2 & 3, raw & 3], axis=1).ravel()[: offsets[-1]]]
            places = _marked(raw, offsets, k, bits)
            row = np.searchsorted(offsets, places, "right") - 1
            off = places - offsets[row] + np.array(text["bases"], np.int64)[row]
            yield _runs(pa.array(text["names"], pa.string()), row, off, k, gap)

    counts = df.mapInArrow(count, "chunk string, bucket int, n int, low binary, rest binary").repartition("bucket").sortWithinPartitions("bucket")
    found = counts.mapInArrow(meet, "chunk string, bucket int, bits binary")
    whole = df.mapInArrow(texts, "chunk string, bucket int, bits binary, packed boolean, names array<string>, bases array<long>, ends array<long>")
    both = whole.unionByName(found, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "bucket")
    return both.mapInArrow(back, "name string, s long, e long")


_TEXTS = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("bits", pa.binary()), ("packed", pa.bool_()), ("names", pa.list_(pa.string())), ("bases", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def _rows(batches):
    for b in batches:
        for i in range(0, b.num_rows, 64):
            yield from b.slice(i, 64).to_pylist()


def _chunks(batches, k: int, size: int):
    """Name of a chunk, names of its texts, where they begin in the whole ones, their bytes and offsets.

    A chunk has up to ``size`` k-mers; longer texts are cut. Its name tells its place and its content,
    so texts that are read again in another order are noticed. A character that is not ASCII is one byte.
    """
    task, number, held, total = TaskContext.get().partitionId(), 0, [], 0

    def made():
        raw, ends = np.concatenate([x for _, _, x in held]), np.cumsum([0, *[len(x) for _, _, x in held]])
        names, bases = [n for n, _, _ in held], [b for _, b, _ in held]
        check = zlib.crc32(repr((names, bases, ends.tolist())).encode(), zlib.crc32(raw))
        return f"{task}.{number}.{check}", names, bases, raw, ends

    for b in batches:
        column = b.column("seq")
        raw, offsets = _bytes(column)
        if (raw > 127).any():
            raw, offsets = _bytes(pa.array([(t or "").encode("ascii", "replace").decode() for t in column.to_pylist()], pa.string()))
        ends = offsets.tolist()
        for i, name in enumerate(b.column("name").to_pylist()):
            for at in range(ends[i], ends[i + 1] - k + 1, size):
                part = raw[at : min(ends[i + 1], at + size + k - 1)]
                if held and total + len(part) > size:
                    yield made()
                    number, held, total = number + 1, [], 0
                held.append((name, at - ends[i], part))
                total += len(part)
    if held:
        yield made()


def _mixed(keys: np.ndarray, k: int) -> np.ndarray:
    """Other numbers for keys, one to one, of even density."""
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) & np.uint64((1 << 2 * k) - 1)).astype(np.int64)


def _counted(chunk: str, raw: np.ndarray, offsets: np.ndarray, k: int, least: int) -> pa.RecordBatch:
    """The distinct k-mers of a chunk by range: of distance and count as one number the low bytes, and the rest as bytes of 7 bits."""
    h = np.concatenate([_mixed(keys, k) for _, keys in _placed(raw, offsets, k)])
    h.sort()
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    n = np.minimum(np.diff(np.append(first, len(h))), least)
    h, shift = h[first], 2 * k - RANGES
    cuts = np.searchsorted(h, np.arange((1 << RANGES) + 1, dtype=np.int64) << shift)
    v = np.diff(h, prepend=0)
    used = np.flatnonzero(np.diff(cuts))
    v[cuts[used]] = h[cuts[used]] - (used << shift)
    v = v * least + n - 1
    low, v = (v & 255).astype(np.uint8), v >> 8
    size = np.ones(len(v), np.int64)
    for j in range(7, 63, 7):
        longer = v >> j > 0
        if not longer.any():
            break
        size += longer
    ends = np.concatenate([[0], np.cumsum(size)])
    rest, at = np.zeros(ends[-1], np.uint8), ends[:-1]
    while len(v):
        more = v > 127
        rest[at] = v & 127 | more << 7
        at, v = at[more] + 1, v[more] >> 7
    rows = [(u, a, b, low[a:b].tobytes(), _deflated(rest[ends[a] : ends[b]])) for u, a, b in zip(used.tolist(), cuts[used].tolist(), cuts[used + 1].tolist())]
    return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk] * len(rows), pa.string()), "bucket": pa.array([r[0] for r in rows], pa.int32()), "n": pa.array([r[2] - r[1] for r in rows], pa.int32()), "low": pa.array([r[3] for r in rows], pa.binary()), "rest": pa.array([r[4] for r in rows], pa.binary())})


def _deflated(x: np.ndarray) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return z.compress(x.tobytes()) + z.flush()


def _met(rows: list[dict], least: int):
    """A range's rows of all chunks: for each a bit by k-mer, set if all chunks together have it ``least`` times."""
    h, n = [], []
    for r in rows:
        rest = np.frombuffer(zlib.decompress(r["rest"], -15), np.uint8)
        ends = np.flatnonzero(rest < 128)
        at = np.concatenate([[0], ends[:-1] + 1])
        v = (rest[at] & 127).astype(np.int64)
        for j in range(1, 9):
            longer = np.flatnonzero(ends - at >= j)
            if not len(longer):
                break
            v[longer] |= (rest[at[longer] + j] & 127).astype(np.int64) << 7 * j
        v = v << 8 | np.frombuffer(r["low"], np.uint8)
        h.append(np.cumsum(v // least))
        n.append((v % least + 1).astype(np.int32))
    h, n = np.concatenate(h), np.concatenate(n)
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    common = np.add.reduceat(n[order], first, dtype=np.int64) >= least
    bits = np.empty(len(h), bool)
    bits[order] = np.repeat(common, np.diff(np.append(first, len(h))))
    at = np.cumsum([r["n"] for r in rows])[:-1]
    packed = [np.packbits(x).tobytes() for x in np.split(bits, at)]
    yield pa.RecordBatch.from_pydict({"chunk": pa.array([r["chunk"] for r in rows], pa.string()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "bits": pa.array(packed, pa.binary())})


def _marked(raw: np.ndarray, offsets: np.ndarray, k: int, bits: list[dict]) -> np.ndarray:
    """Places of a chunk's k-mers whose bit is set, in order."""
    both = [(places.astype(np.int32), _mixed(keys, k)) for places, keys in _placed(raw, offsets, k)]
    places, h = np.concatenate([p for p, _ in both]), np.concatenate([x for _, x in both])
    del both
    order = np.argsort(h)
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    sizes = np.diff(np.searchsorted(h[new], np.arange((1 << RANGES) + 1, dtype=np.int64) << 2 * k - RANGES))
    if [b["bucket"] for b in bits] != np.flatnonzero(sizes).tolist():
        raise ValueError("the texts of a chunk were not read alike twice")
    held = [np.unpackbits(np.frombuffer(b["bits"], np.uint8))[:n].view(bool) for b, n in zip(bits, sizes[sizes > 0].tolist())]
    known = np.concatenate([*held, np.zeros(0, bool)])
    return np.sort(places[order[known[np.cumsum(new) - 1]]]).astype(np.int64)


def mash(sketches: DataFrame, k: int, size: int) -> DataFrame:
    """Pairs n1 < n2 of names whose sketches (name, h; at most ``size`` hashes each) meet: shared, size, mash.

    Jaccard is estimated on the ``size`` least hashes of both: those in both sketches, over all. A shared
    hash of ranks r1 and r2 is in place r1 + r2 - i of both, as the i-th shared one, so no pair carries
    sketches. Names with equal sketches are one class while hashes are joined.
    """
    lists = sketches.groupBy("name").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    rep = lists.groupBy("hs").agg(F.min("name").alias("rep"))
    members = lists.join(rep, "hs").select("name", "rep")
    ranked = rep.select("rep", F.size("hs").alias("n"), F.posexplode("hs").alias("r", "h"))
    x, y = ranked.toDF("c1", "t1", "p1", "h"), ranked.toDF("c2", "t2", "p2", "h")
    met = x.join(y, "h").filter("c1 <= c2").groupBy("c1", "c2", "t1", "t2").agg(F.array_sort(F.collect_list(F.struct("p1", (F.col("p1") + F.col("p2") + 2).alias("p")))).alias("met"))
    shared = F.size(F.filter("met", lambda m, i: m["p"] - (i + 1) <= size)).cast("long")
    total = F.least(F.lit(size), F.col("t1") + F.col("t2") - F.size("met")).cast("long")
    one = met.select("c1", "c2", shared.alias("shared"), total.alias("size"))
    classes = one.union(one.filter("c1 <> c2").select("c2", "c1", "shared", "size"))
    both = classes.join(members.toDF("n1", "c1"), "c1").join(members.toDF("n2", "c2"), "c2").filter("n1 < n2").select("n1", "n2", "shared", "size")
    j = F.col("shared") / F.col("size")
    distance = F.greatest(F.least(F.lit(1.0), -F.log(2 * j / (1 + j)) / k), F.lit(0.0))
    return both.withColumn("mash", F.when(F.col("shared") == 0, 1.0).otherwise(F.round(distance, 4)))


def _window_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k bytes, eight bytes at a time."""
    n, h = len(raw) - k + 1, np.uint64(k)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    for at in range(0, k, 8):
        size = min(8, k - at)
        lane = np.zeros(n, np.uint64)
        for j in range(size):
            lane |= padded[at + j : at + j + n].astype(np.uint64) << np.uint64(8 * j)
        h = (h ^ lane) * np.uint64(0x9E3779B97F4A7C55)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(29))
    return h


def jumping_places(hashes: np.ndarray, w: int) -> list[int]:
    """Places of minimizers: the leftmost least hash of a window, then the window after it, and the last window's."""
    if len(hashes) < w:
        return []
    windows = np.lib.stride_tricks.sliding_window_view(hashes, w)
    least = np.concatenate([windows[i : i + 65536].argmin(axis=1) + np.arange(i, min(i + 65536, len(windows))) for i in range(0, len(windows), 65536)])
    out, at, last = [], 0, len(hashes) - w
    while at < last:
        out.append(int(least[at]))
        at = out[-1] + 1
    if not out or out[-1] != least[last]:
        out.append(int(least[last]))
    return out


def jumping(df: DataFrame, k: int, w: int) -> DataFrame:
    """name, h: distinct hashes of a record's jumping minimizers in windows of ``w`` k-mers; shorter records have none."""

    def run(batches):
        for b in batches:
            for name, seq in zip(b.column("name").to_pylist(), b.column("seq").to_pylist()):
                raw = np.frombuffer((seq or "").encode(), np.uint8)
                if len(raw) < k + w - 1:
                    continue
                h = _window_hashes(raw, k)
                own = np.unique(h[jumping_places(h, w)]).view(np.int64)
                yield pa.RecordBatch.from_pydict({"name": pa.array([name] * len(own), pa.string()), "h": pa.array(own)})

    return df.select("name", "seq").mapInArrow(run, "name string, h long").distinct()
