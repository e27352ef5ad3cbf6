"""LAV alignments as PSL records."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PSL = (
    "match int, mismatch int, rep int, n int, q_num_insert int, q_base_insert int, t_num_insert int, t_base_insert int, strand string, q_name string, q_size int, q_start int, q_end int, "
    "t_name string, t_size int, t_start int, t_end int, block_count int, block_sizes array<int>, q_starts array<int>, t_starts array<int>"
)
_STANZA = re.compile(r"^\s*(\S+) \{\s*$(.*?)^\s*\}\s*$", re.M | re.S)
# Endings of file names that a sequence's name leaves out.
_ENDINGS = (".nib", ".fasta", ".fa", ".2bit")


def _name(line: str) -> str:
    word = line.split()[0].removeprefix('"').removeprefix(">").split('"')[0].rsplit("/", 1)[-1]
    return next((word.removesuffix(e) for e in _ENDINGS if word.endswith(e)), word)


def _lines(body: str) -> list[str]:
    return [x for x in map(str.strip, body.splitlines()) if x and not x.startswith("#")]


def records(text: str) -> Iterator[dict]:
    """A record for each alignment stanza that has blocks; sizes and names come from the last stanzas before it."""
    sizes = names = strand = None
    for kind, body in _STANZA.findall(text):
        lines = _lines(body)
        if kind == "s":
            sizes = [int(x.split()[2]) for x in lines[:2]]
        elif kind == "h":
            names, strand = [_name(x) for x in lines[:2]], "-" if any("(reverse" in x for x in lines) else "+"
        elif kind == "a":
            blocks = [(a - 1, b - 1, c, d, round(p)) for a, b, c, d, p in ([*map(int, x.split()[1:5]), float(x.split()[5])] for x in lines if x.startswith("l "))]
            while blocks and blocks[0][1] == blocks[0][3]:
                blocks.pop(0)
            while blocks and blocks[-1][1] == blocks[-1][3]:
                blocks.pop()
            if not blocks:
                continue
            if sizes is None or names is None:
                raise ValueError("an alignment stands before its sizes or names")
            yield _record(blocks, sizes, names, strand)


def _record(blocks: list[tuple[int, int, int, int, int]], sizes: list[int], names: list[str], strand: str) -> dict:
    width = [te - t for t, _, te, _, _ in blocks]
    same = [min(n, (n * b[4] + 50) // 100) for n, b in zip(width, blocks)]
    q_gaps, t_gaps = ([max(0, b[i] - a[i + 2]) for a, b in zip(blocks, blocks[1:])] for i in (1, 0))
    q_from, q_to = min(b[1] for b in blocks), max(b[3] for b in blocks)
    if strand == "-":
        q_from, q_to = sizes[1] - q_to, sizes[1] - q_from
    some = lambda gaps: sum(g > 0 for g in gaps)
    return {
        "match": sum(same), "mismatch": sum(width) - sum(same), "rep": 0, "n": 0, "q_num_insert": some(q_gaps), "q_base_insert": sum(q_gaps), "t_num_insert": some(t_gaps), "t_base_insert": sum(t_gaps), "strand": strand,
        "q_name": names[1], "q_size": sizes[1], "q_start": q_from, "q_end": q_to, "t_name": names[0], "t_size": sizes[0], "t_start": min(b[0] for b in blocks), "t_end": max(b[2] for b in blocks),
        "block_count": len(blocks), "block_sizes": width, "q_starts": [b[1] for b in blocks], "t_starts": [b[0] for b in blocks],
    }


def read(spark: SparkSession, path: str) -> DataFrame:
    """PSL records of LAV files; a file is one stream, so a task takes whole files."""

    def run(batches):
        for b in batches:
            for text in b.column("value").to_pylist():
                rows = list(records(text))
                if rows:
                    numbers = pa.list_(pa.int32())
                    kinds = {"strand": pa.string(), "q_name": pa.string(), "t_name": pa.string(), "block_sizes": numbers, "q_starts": numbers, "t_starts": numbers}
                    yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], kinds.get(k, pa.int32())) for k in rows[0]})

    return spark.read.text(path, wholetext=True).mapInArrow(run, PSL)
