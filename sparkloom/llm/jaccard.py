"""Grouped prefix join on word shingles with exact Jaccard verification.

1. Each text becomes its set of shingle hashes. A fixed-size table of counters over hash buckets,
   summed over all texts, orders shingles from rare to frequent; any total order gives right
   results, this one keeps lists short.
2. Texts with equal sets are one class. Classes with the same size and the same prefix (the part
   of a set that must meet that of a partner) are one group; only groups are indexed.
   Prefix shingles that a single group holds are in no list and never leave their task: a bit table
   of a fixed size, made from shortened hashes of all, tells which ones surely are.
3. Groups that share a prefix shingle, and pass the size and position filters, are candidates.
   Lists expand to classes; pairs whose marks (parities of counts by hash) leave room for enough
   overlap are verified on whole sets.
4. Lists are not expanded into all pairs: rounds (see rounds.py) compare members only across
   components not yet joined, until every list is one component or all compared.

Hashes have 64 bits; two different shingles count as equal with a probability of 2^-64.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import without
from .common import Scratch, arrow_map, small_batches
from .rounds import collapsed, connect, numbered
from .words import shingle_sets

#: Counters of the sketch, and the parts in which tasks send it.
COUNTERS, PARTS = 1 << 20, 64
#: Numbers of 64 bits in a class's marks, which bound overlaps from above; sets of more than BIG have wide ones too.
MARKS, WIDE, BIG = 16, 64, 256

#: Binary digits of a shingle hash that say its part of the bit table, those sent besides, and the digits of a bit's place in a part.
PART, SENT, PLACE = 10, 32, 17
#: Hashes that a task gathers before it sends them.
GATHER = 1 << 20


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def _marks(h: np.ndarray, size: int = MARKS) -> np.ndarray:
    """``size`` numbers of 64 bits: whether a set has an odd count of hashes with each choice of low bits."""
    odd = np.bincount((h & np.uint64(64 * size - 1)).astype(np.int64), minlength=64 * size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sig(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def bucket_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How many sets hold a shingle of each bucket, as 16-bit ranks; the size does not depend on the data."""

    def count(batches):
        total = np.zeros(COUNTERS, np.uint64)
        for b in batches:
            sets = [h for _, h in shingle_sets(b.column("text"), size)]
            if sets:
                total += np.bincount(_bucket(np.concatenate(sets)), minlength=COUNTERS).astype(np.uint64)
        if total.any():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.arange(PARTS, dtype=np.int32)), "counts": pa.array([x.tobytes() for x in np.split(total, PARTS)], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(x, np.uint64)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    sent = arrow_map(docs.select("text"), count, "chunk int, counts binary").repartition(8, "chunk")
    total = np.zeros(COUNTERS, np.uint64)
    for k, x in arrow_map(sent, add, "chunk int, counts binary").collect():
        total[k * (COUNTERS // PARTS) : (k + 1) * (COUNTERS // PARTS)] = np.frombuffer(x, np.uint64)
    unit = max(1, int(total.mean()) // 1024)
    return np.minimum(total // np.uint64(unit), 65535).astype(np.uint16)


def _prefixes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, sig (of the set), psig (of the prefix), prefix in the global order, marks and wide marks."""
    order = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, size))

    def run(batches):
        counts = order.value
        for b in batches:
            n, sig, psig, prefix, marks, wide = [], [], [], [], [], []
            for _, h in shingle_sets(b.column("text"), size):
                n.append(len(h))
                marks.append(_marks(h))
                wide.append(_marks(h, WIDE) if len(h) > BIG else None)
                if not len(h):
                    sig.append(None), psig.append(None), prefix.append(h)
                    continue
                keep = len(h) - -(-percent * len(h) // 100) + 1
                first = h[np.argsort(counts[_bucket(h)], kind="stable")[:keep]]
                sig.append(_sig(h))
                psig.append(_sig(first))
                prefix.append(first)
            ends = np.cumsum([0, *map(len, prefix)], dtype=np.int32)
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()), "n": pa.array(n, pa.int64()), "sig": pa.array(sig, pa.binary()), "psig": pa.array(psig, pa.binary()), "prefix": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))), "marks": pa.array(marks, pa.list_(pa.int64())), "wide": pa.array(wide, pa.list_(pa.int64()))})

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n long, sig binary, psig binary, prefix array<long>, marks array<long>, wide array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for b in batches:
            sets = [h for _, h in shingle_sets(b.column("text"), size)]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()), "sig": pa.array([_sig(h) if len(h) else None for h in sets], pa.binary()), "items": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))})

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, sig binary, items array<long>")


def shared_bits(index: DataFrame) -> np.ndarray:
    """A bit for each start of PART + PLACE digits of a hash: set where two rows' ``prefix`` hold a hash that starts so.

    Hashes travel by their first digits, sorted and by bytes; equal starts of different hashes
    set a bit too many, and that is all. The table's size does not depend on the data.
    """

    def send(batches):
        held, n = [], 0

        def out():
            h = np.sort(np.concatenate(held))
            ends = np.searchsorted(h >> np.uint64(64 - PART), np.arange((1 << PART) + 1))
            low = (h >> np.uint64(64 - PART - SENT)).astype(np.uint32)
            parts = [k for k in range(1 << PART) if ends[k] < ends[k + 1]]
            raw = [low[ends[k] : ends[k + 1]].view(np.uint8).reshape(-1, 4).T.tobytes() for k in parts]
            return pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32()), "low": pa.array(raw, pa.binary())})

        for b in batches:
            held.append(b.column("prefix").flatten().to_numpy().view(np.uint64))
            n += len(held[-1])
            if n >= GATHER:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def find(batches):
        part, held = None, []

        def out():
            low = np.sort(np.concatenate([np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view(np.uint32)[:, 0] for x in held]))
            bits = np.zeros(1 << PLACE, bool)
            bits[low[1:][low[1:] == low[:-1]] >> np.uint32(SENT - PLACE)] = True
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        for b in batches:
            for k, x in zip(b.column("part").to_pylist(), b.column("low").to_pylist()):
                if k != part and held:
                    yield out()
                    held = []
                part = k
                held.append(x)
        if held:
            yield out()

    spread = arrow_map(index.select("prefix"), send, "part int, low binary").repartition("part").sortWithinPartitions("part")
    table = np.zeros((1 << PART, (1 << PLACE) // 8), np.uint8)
    for k, x in arrow_map(spread, find, "part int, bits binary").collect():
        table[k] = np.frombuffer(x, np.uint8)
    return table.reshape(-1)


def _shared_tokens(index: DataFrame) -> DataFrame:
    """gid, n, pos, token of the prefixes (columns doc_id, n, prefix): all that two rows hold, and a few more."""
    shared = index.sparkSession.sparkContext.broadcast(shared_bits(index))

    def run(batches):
        table = shared.value
        for b in batches:
            prefix = b.column("prefix")
            ends = prefix.offsets.to_numpy()
            token = prefix.flatten().to_numpy()
            at = (token.view(np.uint64) >> np.uint64(64 - PART - PLACE)).astype(np.int64)
            keep = np.flatnonzero((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))[keep]
            pos = keep - (ends[:-1] - ends[0])[row]
            yield pa.Table.from_pydict({"gid": pa.array(b.column("doc_id").to_numpy()[row]), "n": pa.array(b.column("n").to_numpy()[row].astype(np.int32)), "pos": pa.array(pos.astype(np.int32)), "token": pa.array(token[keep])})

    return arrow_map(index.select("doc_id", "n", "prefix"), run, "gid long, n int, pos int, token long")


def _passes(percent: int, a: str, b: str, overlap: str) -> str:
    """overlap / (a + b - overlap) >= percent / 100, in whole numbers."""
    return f"{100 + percent} * ({overlap}) >= {percent} * ({a} + {b})"


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Words are what white space parts, ASCII letters in lower case. A text with fewer words than
    ``size`` is one shingle; a null text or one without words has none and is linked with
    nothing. Two rows link when their sets' Jaccard similarity is at least ``percent`` / 100.
    component_id is the smallest doc_id that links reach. A row with a null doc_id is counted
    but has no component. Repeated rows are equal sets and so linked.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    rows = scratch.keep(_prefixes(docs, size, percent), "prefixes")
    live = rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.keep(live.groupBy("sig", "n", "psig").agg(F.min("doc_id").alias("cls"), F.count("*").alias("copies"), *[F.max(F.get("marks", F.lit(i))).alias(f"m{i}") for i in range(MARKS)]), "classes")
    groups = classes.groupBy("n", "psig").agg(F.min("cls").alias("gid"), F.count("*").alias("many"))

    # Lists of groups that share a prefix shingle.
    # a row for each group: rows of other documents are taken out, few of them by a shuffle
    held = live.select("doc_id", "n", "psig").join(groups, ["n", "psig"])
    others = scratch.keep(held.filter("doc_id <> gid").select("doc_id", "psig").distinct(), "others")
    index = without(live.select("doc_id", "psig", "n", "prefix"), ["doc_id", "psig"], others)
    index = _shared_tokens(index)
    # the least place of members that meet in several lists is that of the same shingle for all of them
    lists = collapsed(index.withColumnRenamed("gid", "cls"), ["n"], ["pos"]).withColumnRenamed("cls", "gid")

    # Expand to classes. A group of several classes is a list of its own.
    several = classes.join(groups.filter("many > 1"), ["n", "psig"]).select("gid", "cls", F.col("n").cast("int").alias("n"))
    other = lists.join(several.select("gid", "cls"), "gid", "left").select("token", F.coalesce("cls", "gid").alias("cls"), "n", "pos")
    own = several.select(F.xxhash64("gid", F.lit("group")).alias("token"), "cls", "n", F.lit(0).alias("pos"))
    lists = scratch.keep(numbered(other.union(own)), "lists")
    scratch.release()
    narrow = scratch.keep(rows.select("doc_id", "n", "sig"), "narrow")
    named = classes.select(F.col("cls").alias("doc_id"), "sig")
    wide = rows.filter("wide IS NOT NULL AND doc_id IS NOT NULL").join(named, ["doc_id", "sig"], "leftsemi").select(F.col("doc_id").alias("cls"), "wide")
    wide = scratch.keep(wide.dropDuplicates(["cls"]), "wide")
    scratch.drop("prefixes", "others")
    linked = F.expr(_passes(percent, "size(sa)", "size(sb)", "size(array_intersect(sa, sb))"))
    # each element that only one set has turns one bit: ham <= n1 + n2 - 2 overlap
    ham = " + ".join(f"bit_count(m{i}1 ^ m{i}2)" for i in range(MARKS))
    near = f"{100 + percent} * (n1 + n2 - ({ham})) >= {2 * percent} * (n1 + n2)"
    apart = F.aggregate(F.zip_with("w1", "w2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    close = F.coalesce((100 + percent) * (F.col("n1") + F.col("n2") - apart) >= 2 * percent * (F.col("n1") + F.col("n2")), F.lit(True))
    marks = classes.select("cls", *[f"m{i}" for i in range(MARKS)])
    sided = lambda key, x: classes.select(F.col("cls").alias(key), F.col("n").alias(f"n{x}"), *[F.col(f"m{i}").alias(f"m{i}{x}") for i in range(MARKS)])
    fits = f"100 * least(n1, n2) >= {percent} * greatest(n1, n2) AND " + _passes(percent, "n1", "n2", "least(pos1, pos2) + least(n1 - pos1, n2 - pos2)")

    def test(pairs: DataFrame) -> DataFrame:
        """Whole sets of the classes that pairs name, read from the texts, and their intersections."""
        scratch.drop("sets", "pairs")
        pairs = pairs.join(sided("a", 1), "a").join(sided("b", 2), "b").filter(near).select("a", "b", "n1", "n2")
        pairs = pairs.join(wide.toDF("a", "w1"), "a", "left").join(wide.toDF("b", "w2"), "b", "left").filter(close).select("a", "b")
        pairs = scratch.keep(pairs, "pairs")
        if not scratch.rows["pairs"]:
            return pairs.withColumn("linked", F.lit(False))
        ids = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        named = classes.join(ids, "cls").select(F.col("cls").alias("doc_id"), "sig")
        sets = scratch.keep(_class_sets(docs, named, size), "sets")
        scratch.release()
        a, b = sets.toDF("a", "sa"), sets.toDF("b", "sb")
        return pairs.join(a, "a").join(b, "b").select("a", "b", linked.alias("linked"))

    labels = connect(lists, ["n", "pos"], fits, test, scratch, steps=(1, 32), marks=marks, near=near)
    scratch.drop("sets", "pairs")
    if labels is not None:
        classes = classes.join(labels.toDF("cls", "component"), "cls", "left")
    else:
        classes = classes.withColumn("component", F.col("cls"))
    joined = classes.select("sig", "copies", F.col("cls"), F.coalesce("component", "cls").alias("component")).filter("copies > 1 OR component <> cls").select("sig", "component")
    out = narrow.join(joined, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _class_sets(docs: DataFrame, named: DataFrame, size: int) -> DataFrame:
    """doc_id, items of the named classes (doc_id, sig): only rows that a fixed-size filter lets through are shuffled."""
    bits = 1 << 22
    h = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = named.select((h / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {bits}) % 64 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(bits // 64, np.int64)
    got = words.toPandas()  # at most bits / 64 rows
    table[got["w"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def maybe(batches):
        t = shared.value
        for b in batches:
            w = b.column("h").to_numpy()
            keep = (t[w >> 6] >> (w & 63)) & 1 == 1
            yield b.select(["doc_id", "text"]).filter(pa.array(keep))

    few = arrow_map(docs.filter("doc_id IS NOT NULL").select("doc_id", "text", h.alias("h")), maybe, "doc_id long, text string")
    return _sets(few, size).join(named, ["doc_id", "sig"], "leftsemi").select("doc_id", "items")
