"""Token ids in ORC: stripes of run-length encoded integers, row indexes and Bloom filters on doc_id.

Documents are range-partitioned and sorted by doc_id before they are encoded, so a file holds a
range of ids in order; stripes are read in parallel, and a filter on doc_id skips files and
stripes by their statistics and Bloom filters.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, small_batches
from .encode import encoder, tokenizer_path

SCHEMA = "part int, row long, doc_id long, ids array<int>"


def encode_documents(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """part, row (from 0 in each part), doc_id, ids; parts hold ascending ranges of doc_id, null ids first.

    A null text counts as empty and has the end id only; rows that repeat an id stand in the
    order of their texts.
    """
    path = path or tokenizer_path()
    small_batches(docs.sparkSession)
    spread = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        enc, row, part = encoder(path), 0, TaskContext.get().partitionId()
        for b, flat, ends in enc.stream(batches):
            ends = ends + np.arange(len(ends))
            held = np.empty(ends[-1], np.int32)
            own = np.ones(len(held), bool)
            own[ends[1:] - 1] = False
            held[own], held[~own] = flat, end_id
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(held))
            n = b.num_rows
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(n, part, np.int32)), "row": pa.array(np.arange(row, row + n)), "doc_id": b.column("doc_id").cast(pa.int64()), "ids": ids})
            row += n

    return arrow_map(spread, run, SCHEMA, keeps=("encoder",))


def write_tokens(docs: DataFrame, to: str, path: str | None = None, end_id: int = 2, stripe_mb: int = 16, row_index: int = 1000) -> None:
    """Write the ids of all documents as ORC files under ``to``."""
    options = {
        "compression": "zstd",
        "orc.encoding.strategy": "SPEED",
        "orc.create.index": "true",
        "orc.row.index.stride": str(row_index),
        "orc.stripe.size": str(stripe_mb << 20),
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
    }
    encode_documents(docs, path, end_id).write.options(**options).orc(to)


def read_tokens(spark: SparkSession, at: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of written files; ``doc_ids`` are looked up through statistics and Bloom filters."""
    df = spark.read.schema(SCHEMA).orc(at)
    return df if doc_ids is None else df.filter(F.col("doc_id").isin(doc_ids))


def describe_tokens(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, in the files' global order."""
    small_batches(tokens.sparkSession)

    def run(batches):
        for b in batches:
            ids = b.column("ids")
            ends = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_pydict({"part": b.column("part"), "row": b.column("row"), "doc_id": b.column("doc_id"), "n_tokens": pa.array(np.diff(ends).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    rows = arrow_map(tokens, run, "part int, row long, doc_id long, n_tokens long, ids_crc32 long")
    scratch = Scratch(tokens.sparkSession)
    rows = scratch.keep(rows, "rows")
    # a row for each part: the sum of the parts before it
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    out = rows.join(parts, rows.part == parts._part)
    return out.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def tokenize_to_orc(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder, read them back and describe them: doc_id, start, n_tokens, ids_crc32.

    A null text has the end id alone; null ids come first; rows that repeat an id stand in the order
    of their texts, null first; an empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    write_tokens(docs, f"{scratch.top}/tokens.orc", path, end_id)
    return describe_tokens(read_tokens(docs.sparkSession, f"{scratch.top}/tokens.orc"))
