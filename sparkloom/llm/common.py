"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of one Arrow batch that goes to Python; long texts make batches of fewer rows.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session by bytes, so that long texts do not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def process_cache() -> dict:
    """A dict that lives as long as this Python process and outlasts one task."""
    return sys.modules.setdefault("_sparkloom_cache", types.ModuleType("_sparkloom_cache")).__dict__


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one if all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or process_cache().get("folder")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = process_cache()["folder"] = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return folder


#: Rows of a small table that one task takes.
TASK_ROWS = 50_000


@contextmanager
def tasks_for(spark: SparkSession, rows: int):
    """Shuffles of tables of about ``rows`` rows: no more partitions than these need. The session's number comes back."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 1 + rows // TASK_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended: the folder's owner cleans up
        pass


class Scratch:
    """Tables in the shared folder: they cut lineage and outlive lost executors.

    ``keep`` writes a frame and reads it back; ``rows`` tells how many rows each name's last table has.
    A kept table goes when ``drop`` is called; what a returned frame still reads goes when the
    driver's Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.rows, self.written = spark, {}, {}, 0
        self.top = f"{shared_folder(spark).rstrip('/')}/sparkloom-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.top)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.written += 1
        path = self.paths[name] = f"{self.top}/{name}-{self.written}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        self.rows[name] = seen.get["n"]
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let go of shuffle files that no live frame needs: Spark deletes them when the driver's garbage is collected.

        What the driver's Python has freed goes back to the system as well.
        """
        gc.collect()
        trim()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for n in names:
            if n in self.paths:
                _delete(self.spark, self.paths.pop(n))


#: What workers keep from task to task, by the first word of its key in the cache.
KEPT = ("encoder", "powers")


def forget(keeps: tuple[str, ...]) -> None:
    """Drop what earlier tasks of other operators left in this worker."""
    cache = process_cache()
    for k in [k for k in cache if (k[0] if isinstance(k, tuple) else k) in KEPT]:
        if (k[0] if isinstance(k, tuple) else k) not in keeps:
            del cache[k]


def trim() -> None:
    """Give freed memory back to the system: a worker lives on after its task."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, fn, schema: str, keeps: tuple[str, ...] = ()) -> DataFrame:
    """``fn`` takes and yields pyarrow tables or batches; one call for each partition. ``keeps``: of KEPT, what it uses."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        try:
            for out in fn(batches):
                yield from out.to_batches(max_chunksize=65536) if isinstance(out, pa.Table) else [out]
        finally:
            trim()

    return df.mapInArrow(run, schema)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """16 bytes that stand for a row: its id and whole text. Repeated rows share a key."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col(text)).cast("binary")))


def salted_rank(df: DataFrame, keys: list[str], salt: Column, order: list[Column]) -> DataFrame:
    """``salt`` and ``rank_in`` (from 0) of each row in its (keys, salt) cell: no window holds a whole hot key."""
    df = df.withColumn("salt", salt.cast("int"))
    w = Window.partitionBy(*keys, "salt").orderBy(*order)
    return df.withColumn("rank_in", F.row_number().over(w) - 1)
