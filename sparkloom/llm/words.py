"""Words and shingles of whole texts as 64-bit hashes, by array operations on an Arrow buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_R = np.uint64(0x9E3779B97F4A7C55)
_STEPS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: ASCII upper case to lower case; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes that part words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts and ends of runs of true bytes that do not cross texts, and each text's first word (one more at the end)."""
    n = len(is_word)
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | head[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | head[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes of a word that are hashed eight at a time; a longer word goes through xxHash.
SHORT = 64
_LANES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word: eight bytes are taken in, then all is mixed, until the word ends."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(raw) + 1, 8), (1, 1))
    lane = eight[starts].view(np.uint64).ravel() & _LANES[np.minimum(size, 8)]
    h = mixed(size.astype(np.uint64) * _R ^ lane)
    at, live = 8, np.flatnonzero((size > 8) & (size <= SHORT))
    while len(live):
        left = size[live] - at
        lane = eight[starts[live] + at].view(np.uint64).ravel() & _LANES[np.minimum(left, 8)]
        h[live] = mixed((h[live] + _R) ^ lane)
        at, live = at + 8, live[left > 8]
    for i in np.flatnonzero(size > SHORT).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]], seed=1)
    return h


def joined(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words: position i stands for words i to i + size - 1."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * _STEPS[0] + words[j : j + n]
    return mixed(total)


def pieces(column: pa.Array, most: int = 1 << 19):
    """Yields (first row, slice of the column) with about ``most`` bytes, or one text."""
    _, offsets = text_bytes(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def shingle_sets(column: pa.Array, size: int = 5):
    """Yields (row, ascending distinct hashes) of each text: runs of ``size`` words, fewer words as one run."""
    for at, part in pieces(column):
        raw, offsets = text_bytes(part)
        starts, ends, first = word_spans(~BLANK[raw], offsets)
        words = word_hashes(LOWER[raw], starts, ends)
        runs = joined(words, size)
        for i in range(len(part)):
            a, b = first[i], first[i + 1]
            if b - a >= size:
                h = np.sort(runs[a : b - size + 1])
                keep = np.empty(len(h), bool)
                keep[:1] = True
                np.not_equal(h[1:], h[:-1], out=keep[1:])
                yield at + i, h[keep]
            elif b > a:
                yield at + i, joined(words[a:b], int(b - a)) ^ np.uint64(b - a)
            else:
                yield at + i, words[:0]
