"""2bit records and files: two bits a base, with blocks of N and of lower case.

A record is a binary value of one sequence; a file is a header, an index and records. Tasks encode
and decode; a file is written by each task under a name of its own, so a repeated task replaces it.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Signature, codes of the bases T, C, A, G.
MAGIC = 0x1A412743
_LETTERS = np.frombuffer(b"TCAG", np.uint8)
_CODES = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"TCAG"):
    _CODES[[_b, _b + 32]] = _i
_PLACES = np.array([6, 4, 2, 0], np.uint8)


def _blocks(flags: np.ndarray) -> np.ndarray:
    """Starts and ends of runs of true, in two columns."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def encode(seq: bytes, mask: bool = True) -> bytes:
    """One record; what is no base is N, lower case bases are masked."""
    raw = np.frombuffer(seq, np.uint8)
    if len(raw) >= 1 << 32:
        raise ValueError("a 2bit record holds less than 2^32 bases")
    code = _CODES[raw]
    parts = [struct.pack("<I", len(raw))]
    for flags in (code > 3, (raw >= 97) & (code < 4) & mask):
        b = _blocks(flags)
        parts += [struct.pack("<I", len(b)), b[:, 0].astype("<u4").tobytes(), (b[:, 1] - b[:, 0]).astype("<u4").tobytes()]
    four = np.zeros(-(-len(raw) // 4) * 4, np.uint8)
    four[: len(raw)] = np.where(code > 3, 0, code)
    return b"".join([*parts, struct.pack("<I", 0), np.bitwise_or.reduce(four.reshape(-1, 4) << _PLACES, axis=1).astype(np.uint8).tobytes()])


def tables(record: bytes, order: str = "<") -> tuple[int, np.ndarray, np.ndarray, int]:
    """(length, blocks of N, masked blocks, place of the packed bases)."""
    size, at, out = struct.unpack_from(f"{order}I", record)[0], 4, []
    for _ in range(2):
        n = struct.unpack_from(f"{order}I", record, at)[0]
        both = np.frombuffer(record, f"{order}u4", 2 * n, at + 4).astype(np.int64).reshape(2, n)
        out.append(np.stack([both[0], both[0] + both[1]], axis=1))
        at += 4 + 8 * n
    return size, out[0], out[1], at + 4


def decode(record: bytes, start: int = 0, end: int | None = None, mask: bool = True, order: str = "<") -> bytes:
    """The bases from ``start`` to ``end`` (0-based); only their bytes are unpacked."""
    size, gaps, low, at = tables(record, order)
    end = size if end is None else min(end, size)
    if start > size:
        raise ValueError(f"start {start} is beyond the sequence's {size} bases")
    if start >= end:
        return b""
    packed = np.frombuffer(record, np.uint8, -(-end // 4) - start // 4, at + start // 4)
    skip = start % 4
    seq = _LETTERS[(packed[:, None] >> _PLACES & 3).ravel()[skip : skip + end - start]].copy()
    for blocks, change in ((gaps, lambda s: 78), (low if mask else low[:0], lambda s: seq[s] | 32)):
        for a, b in blocks[(blocks[:, 1] > start) & (blocks[:, 0] < end)].tolist():
            s = slice(max(a, start) - start, min(b, end) - start)
            seq[s] = change(s)
    return seq.tobytes()


def records(df: DataFrame, mask: bool = True) -> DataFrame:
    """name, record of sequences (name, seq)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"name": b.column("name"), "record": pa.array([encode((s or "").encode(), mask) for s in b.column("seq").to_pylist()], pa.binary())})

    return df.select("name", "seq").mapInArrow(run, "name string, record binary")


def sequences(recs: DataFrame, mask: bool = True) -> DataFrame:
    """name, seq of records."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"name": b.column("name"), "seq": pa.array([decode(r, mask=mask).decode() for r in b.column("record").to_pylist()], pa.string())})

    return recs.select("name", "record").mapInArrow(run, "name string, seq string")


def sizes(recs: DataFrame) -> DataFrame:
    """name, len, solid (without N) of records, from their tables alone."""

    def run(batches):
        for b in batches:
            got = [tables(r) for r in b.column("record").to_pylist()]
            gaps = [int((t[1][:, 1] - t[1][:, 0]).sum()) for t in got]
            yield pa.RecordBatch.from_pydict({"name": b.column("name"), "len": pa.array([t[0] for t in got], pa.int64()), "solid": pa.array([t[0] - g for t, g in zip(got, gaps)], pa.int64())})

    return recs.select("name", "record").mapInArrow(run, "name string, len long, solid long")


def masked(recs: DataFrame, gaps_only: bool = False) -> DataFrame:
    """name, s, e (1-based) of maximal stretches of N or lower case, from the tables; only N with ``gaps_only``."""

    def run(batches):
        for b in batches:
            out = {"name": [], "s": [], "e": []}
            for name, record in zip(b.column("name").to_pylist(), b.column("record").to_pylist()):
                _, gaps, low, _ = tables(record)
                spans = sorted((gaps if gaps_only else np.concatenate([gaps, low])).tolist())
                joined: list[list[int]] = []
                for s, e in spans:
                    if joined and s <= joined[-1][1]:
                        joined[-1][1] = max(e, joined[-1][1])
                    else:
                        joined.append([s, e])
                for s, e in joined:
                    for k, v in zip(out, (name, s + 1, e)):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("name", pa.string()), ("s", pa.int64()), ("e", pa.int64())]))

    return recs.select("name", "record").mapInArrow(run, "name string, s long, e long")


def extract(recs: DataFrame, ranges: DataFrame) -> DataFrame:
    """The columns of ``ranges`` (name, s, e, strand; 1-based) and seq, unpacked for the range alone; reverse complement on -."""
    from ..functions import seqs

    both = ranges.join(recs, "name")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields if f.name != "record")

    def run(batches):
        for b in batches:
            seq = [decode(r, s - 1, e).decode() for r, s, e in zip(*(b.column(c).to_pylist() for c in ("record", "s", "e")))]
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in b.schema.names if c != "record"} | {"seq": pa.array(seq, pa.string())})

    out = both.mapInArrow(run, kinds + ", seq string")
    return out.withColumn("seq", F.when(F.col("strand") == "-", seqs.revcomp(F.col("seq"))).otherwise(F.col("seq")))


def file_bytes(named: list[tuple[str, bytes]]) -> bytes:
    """A whole file of records."""
    at = 16 + sum(9 + len(n.encode()) for n, _ in named)
    head = [struct.pack("<IIII", MAGIC, 1, len(named), 0)]
    for name, record in named:
        raw = name.encode()
        if len(raw) > 255:
            raise ValueError(f"name of more than 255 bytes: {name}")
        head.append(bytes([len(raw)]) + raw + struct.pack("<Q", at))
        at += len(record)
    return b"".join([*head, *[r for _, r in named]])


def parse_file(content: bytes) -> list[tuple[str, bytes, str]]:
    """(name, record, byte order) of a file; version 0 has offsets of 32 bits, version 1 of 64."""
    order = {MAGIC: "<", int.from_bytes(MAGIC.to_bytes(4, "little"), "big"): ">"}.get(struct.unpack_from("<I", content)[0])
    if order is None:
        raise ValueError("no 2bit signature")
    version, count = struct.unpack_from(f"{order}II", content, 4)
    if version > 1:
        raise ValueError(f"2bit version {version}")
    at, places = 16, []
    for _ in range(count):
        n = content[at]
        name = content[at + 1 : at + 1 + n].decode()
        places.append((name, struct.unpack_from(f"{order}{'Q' if version else 'I'}", content, at + 1 + n)[0]))
        at += 1 + n + (8 if version else 4)
    return [(name, content[p:], order) for name, p in places]


def read(spark: SparkSession, path: str, mask: bool = True) -> DataFrame:
    """name, seq of 2bit files; a task takes a file."""

    def run(batches):
        for b in batches:
            for content in b.column("content").to_pylist():
                for name, record, order in parse_file(content):
                    yield pa.RecordBatch.from_pydict({"name": pa.array([name]), "seq": pa.array([decode(record, mask=mask, order=order).decode()])})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "name string, seq string")


def write(df: DataFrame, path: str, mask: bool = True) -> DataFrame:
    """(file, sequences, bytes): each task writes a file ``part-N.2bit`` under ``path``, a store that pyarrow opens."""

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        named = [(n, encode((s or "").encode(), mask)) for b in batches for n, s in zip(b.column("name").to_pylist(), b.column("seq").to_pylist())]
        if named:
            store, at = fs.FileSystem.from_uri(path)
            store.create_dir(at)
            to, content = f"{at.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.2bit", file_bytes(named)
            with store.open_output_stream(to) as out:
                out.write(content)
            yield pa.RecordBatch.from_pydict({"file": pa.array([to]), "sequences": pa.array([len(named)]), "bytes": pa.array([len(content)])})

    return df.select("name", "seq").mapInArrow(run, "file string, sequences long, bytes long")
