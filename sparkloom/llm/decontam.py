"""Benchmark decontamination by template windows.

Texts and items become words; numbers, units after numbers, and names become typed placeholders
(slots). Windows of consecutive canonical words are joined by hash, so a question with other
numbers or names still meets its item. Where windows of one alignment match, the slots must be
consistent: each value of the item stands for one value in the text, or the other way round (values
may meet by chance on one side). Windows with the item's own values, or without slots, always count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import BITS
from .common import Scratch, arrow_map, small_batches
from .words import LOWER, joined, pieces, text_bytes, word_hashes, word_spans

#: Words of a window, and literal words that it needs; windows with fewer match as they are.
WINDOW, LITERAL = 8, 4
#: A text holds an item if at least half of its windows match, or this many (13 words in a row).
ENOUGH = 6
# Units of measurement and currencies, and number words.
UNITS = "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent mph kmh degrees celsius fahrenheit watt watts volt volts"
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"

_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 digit
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_STOPS = np.zeros(256, bool)
_STOPS[list(b'.!?\n:;|"')] = True
_SLOTS = np.array([0, 0x51ED2700A1B2C3D5, 0x62FE3811B2C3D4E7, 0x73FF4922C3D4E5F9], np.uint64)


def _lexicon(words: str) -> np.ndarray:
    raw, offsets = text_bytes(pa.array([words]))
    starts, ends, _ = word_spans(_KIND[raw] > 0, offsets)
    return np.sort(word_hashes(raw, starts, ends))


def canonical(column: pa.Array):
    """(kind, value, first word of each text): kind 0 literal, 1 number, 2 unit, 3 name."""
    raw, offsets = text_bytes(column)
    kind = _KIND[raw]
    letter = kind > 0
    if len(raw) > 2:  # a point or comma between digits belongs to the number
        inner = (kind[:-2] == 2) & (kind[2:] == 2) & ((raw[1:-1] == 46) | (raw[1:-1] == 44))
        letter[1:-1] |= inner
    starts, ends, first = word_spans(letter, offsets)
    value = word_hashes(LOWER[raw], starts, ends)
    kinds = np.zeros(len(value), np.uint8)
    if len(value):
        digits = np.concatenate([[0], np.cumsum(kind == 1)])
        kinds[(digits[ends] == digits[starts]) | np.isin(value, _lexicon(NUMBERS))] = 1
        kinds[1:][(kinds[:-1] == 1) & np.isin(value[1:], _lexicon(UNITS)) & (kinds[1:] == 0)] = 2
        upper = (raw[starts] >= 65) & (raw[starts] <= 90)
        second = raw[np.minimum(starts + 1, len(raw) - 1)]
        lower = (ends - starts > 1) & (second >= 97) & (second != 255)
        stops = np.concatenate([[0], np.cumsum(_STOPS[raw])])
        inside = np.zeros(len(value), bool)
        inside[1:] = stops[starts[1:]] == stops[ends[:-1]]
        heads = first[:-1][first[:-1] < first[1:]]
        inside[heads] = False
        kinds[upper & lower & inside & (kinds == 0)] = 3
        # a unit's number must be in the same text
        kinds[heads[kinds[heads] == 2]] = 0
    return kinds, value, first


def windows(column: pa.Array, size: int):
    """(row, word, hash, place) arrays of the windows of ``size`` words, and a function for their slots.

    A window with names comes once with them as slots and once as they are: a capital may stand
    for the start of a sentence in one text and not in the other. One with few literals comes
    without slots; that depends on its own words alone. None if there is no window.
    """
    kinds, value, first = canonical(column)
    at = np.arange(max(0, len(value) - size + 1))
    if not len(at):
        return None
    row = np.searchsorted(first, at, side="right") - 1
    inside = at + size <= first[row + 1]
    out, forms = [], [kinds, np.where(kinds == 3, 0, kinds), np.zeros_like(kinds)]
    names = np.concatenate([[0], np.cumsum(kinds == 3)])
    for form, k in enumerate(forms):
        literal = np.concatenate([[0], np.cumsum(k == 0 if form < 2 else (kinds != 1) & ~np.isin(value, _lexicon(UNITS)))])
        enough = literal[at + size] - literal[at] >= min(LITERAL, size)
        ok = inside & (enough if form < 2 else ~enough)
        if form == 1:
            ok &= names[at + size] > names[at]
        h = joined(np.where(k > 0, _SLOTS[k], value), size)
        out.append((row[ok], at[ok] - first[row[ok]], h[ok], at[ok] * 3 + form))

    def slots(place: int) -> list[int]:
        i, k = place // 3, forms[place % 3]
        return value[i : i + size][k[i : i + size] > 0].view(np.int64).tolist()

    return *(np.concatenate(x) for x in zip(*out)), slots


def item_windows(items: DataFrame, size: int, whole: bool) -> DataFrame:
    """h, item_id, q, slots, of (windows of the item), most (those that match with other values too).

    ``whole``: items of exactly ``size`` words alone.
    """

    def run(batches):
        for b in batches:
            got = windows(b.column("text"), size)
            if got is None:
                continue
            row, q, h, at, slots = got
            first = canonical(b.column("text"))[2]
            words = np.diff(first)[row]
            keep = np.flatnonzero((words == size) if whole else (words >= size))
            of = words[keep] - size + 1
            free = np.unique(((row.astype(np.int64) << 32) | q)[at % 3 < 2]) >> 32
            most = np.bincount(free, minlength=len(first))[row[keep]]
            yield pa.RecordBatch.from_pydict({"h": pa.array(h[keep].view(np.int64)), "item_id": b.column("item_id").cast(pa.int64()).take(pa.array(row[keep])), "q": pa.array(q[keep].astype(np.int32)), "islots": pa.array([slots(i) for i in at[keep].tolist()], pa.list_(pa.int64())), "of": pa.array(of.astype(np.int32)), "most": pa.array(most.astype(np.int32)), "free": pa.array(at[keep] % 3 < 2)})

    return arrow_map(items.filter("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text"), run, "h long, item_id long, q int, islots array<long>, of int, most int, free boolean")


def text_windows(docs: DataFrame, size: int, table: np.ndarray) -> DataFrame:
    """doc_id, rk, h, p, dslots of the texts' windows that may be an item's."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    mask = np.uint64(BITS - 1)

    def run(batches):
        t = shared.value
        for b in batches:
            for at0, part in pieces(b.column("text")):
                got = windows(part, size)
                if got is None:
                    continue
                row, p, h, at, slots = got
                spot = (h & mask).astype(np.int64)
                hit = np.flatnonzero((t[spot >> 6] >> (spot & 63)) & 1)
                if len(hit):
                    rows = pa.array(row[hit] + at0)
                    yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").take(rows), "rk": b.column("rk").take(rows), "h": pa.array(h[hit].view(np.int64)), "p": pa.array(p[hit].astype(np.int32)), "dslots": pa.array([slots(i) for i in at[hit].tolist()], pa.list_(pa.int64()))})

    rows = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rk"), "text")
    return arrow_map(rows, run, "doc_id long, rk long, h long, p int, dslots array<long>")


def _bits_of(hashes: DataFrame) -> np.ndarray:
    """The bit table of a column h by its own low bits, from at most BITS / 64 rows."""
    spot = F.col("h").bitwiseAND(F.lit(BITS - 1))
    words = hashes.select(F.shiftright(spot, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(BITS // 64, np.int64)
    table[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return table


def contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, rk (hash of the text), item_id, n_windows, item_windows, exact of each text that holds an item.

    n_windows counts the item's windows that match consistently; exact tells that all slots have
    the item's own values. Half of the windows is enough, and so is half of those that match with
    other values too, if any do. Null texts and ids of items match nothing; items that are shorter
    than a window are looked for as a whole. Repeated items are one; rows that repeat a text are
    each found. Empty tables give an empty result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    found = None
    for n in range(1, size + 1):
        part = scratch.keep(item_windows(items, n, n < size).distinct(), "items")
        if part.isEmpty():
            continue
        hits = text_windows(docs, n, _bits_of(part)).join(part, "h")
        found = hits if found is None else found.union(hits)
    if found is None:
        return spark.createDataFrame([], "doc_id long, rk long, item_id long, n_windows long, item_windows int, exact boolean")
    # slots of one alignment: as many pairs as values on one side, or else its literal windows alone
    line = ["doc_id", "rk", "item_id", "of", "most", (F.col("p") - F.col("q")).alias("diagonal")]
    pair = F.transform(F.arrays_zip("islots", "dslots"), lambda x: F.struct(x["islots"].alias("i"), x["dslots"].alias("d")))
    same = F.forall("pairs", lambda x: x["i"] == x["d"])
    lined = found.select(*line, "q", "free", pair.alias("pairs")).withColumn("literal", F.when(same, F.col("q"))).groupBy("doc_id", "rk", "item_id", "of", "most", "diagonal")
    lined = lined.agg(F.collect_set("q").alias("qs"), F.collect_set(F.when(F.col("free"), F.col("q"))).alias("free"), F.collect_set("literal").alias("literal"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    one = lambda x: F.size(F.array_distinct(F.transform("pairs", lambda y: y[x])))
    fits = (F.size("pairs") == one("i")) | (F.size("pairs") == one("d"))
    lined = lined.withColumn("qs", F.when(fits, F.col("qs")).otherwise(F.col("literal"))).filter(F.size("qs") > 0)
    count = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    out = lined.groupBy("doc_id", "rk", "item_id", "of", "most").agg(count("qs").alias("n_windows"), count(F.array_intersect("qs", "free")).alias("n_free"), F.min(same).alias("exact"))
    half = F.max(F.expr("most > 0 AND 2 * n_free >= most")).alias("half")
    out = out.groupBy("doc_id", "rk", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("of").alias("item_windows"), F.max("exact").alias("exact"), half)
    return out.filter(f"n_windows >= {ENOUGH} OR 2 * n_windows >= item_windows OR half").drop("half")
