"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import threading
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that one slice of an Arrow batch holds (a longer text is alone in its slice).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, one machine (a local master, as in tests) gets a temporary
    folder; a cluster has none that all executors share, so that is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back, so a lost executor repeats nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def carries(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df`` as the last reader of ``table``: to discard the one deletes the other."""
    _paths[df] = _paths.pop(table)
    return df


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


#: Bits of a bitmap of ids at most (8 MB); beyond some 30 million ids it lets more and more pass, which costs time alone.
MOST_BITS = 1 << 26


#: Rows and bytes of an Arrow batch between the JVM and a worker, at most, in jobs of whole texts (a longer text is alone in its batch).
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of an Arrow batch, which both sides hold as a whole; a bound that is lower already stays.
    By default a batch has 10,000 rows, some 34 MB of texts and more where they are long, and the JVM keeps what it took."""
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        known = int(re.match(r"-?\d+", spark.conf.get(key))[0])
        if not 0 < known <= bound:
            spark.conf.set(key, str(bound))


class Marks:
    """A bitmap of the hashed values of a column, for tasks to skip most rows that a join would drop. It is built by grouped
    bitmaps, at most ``MOST_BITS`` bits, sent to the tasks, and never says no to a value that the column holds."""

    def __init__(self, df: DataFrame, column: str):
        self.bits = max(1 << 15, min(MOST_BITS, 1 << (64 * max(1, df.count()) - 1).bit_length()))
        place = self.place(column)
        found = df.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")).collect()
        flags = np.zeros(self.bits // 8 + (1 << 12), np.uint8)
        for r in found:  # bucket k holds the places from (k - 1) * 32768 + 1 on
            flags[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(bytes(r.bitmap), np.uint8)
        self.flags = df.sparkSession.sparkContext.broadcast(flags)

    def place(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.bits)) + 1

    def may_hold(self, places: np.ndarray) -> np.ndarray:
        at = places - 1
        return (self.flags.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


#: After so many seconds without a task a worker releases what it remembers.
IDLE_SECONDS = 1.0

_held: dict[str, Callable[[], object]] = {}
_lock = threading.Lock()
_turns = 0


def _release(names: list[str]) -> None:
    for name in names:
        _held.pop(name)()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def turn_of(operator: str, release: Callable[[], object] = lambda: None) -> None:
    """Called in a worker when a task of ``operator`` begins. Spark uses Python workers again for other stages, so what they
    remember belongs to one operator at a time: the memories of the others are released and given back to the system."""
    global _turns
    with _lock:
        _turns += 1
        others = [name for name in _held if name != operator]
        if others:
            _release(others)
        _held[operator] = release


def task_ends() -> None:
    """Called in a worker when a task ends. Spark may leave the worker idle and give the next tasks to others, so its memories
    are released if no task begins in ``IDLE_SECONDS``."""
    own = _turns

    def let_go() -> None:
        with _lock:
            if own == _turns:
                _release(list(_held))

    timer = threading.Timer(IDLE_SECONDS, let_go)
    timer.daemon = True
    timer.start()


def resting(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as the function of a task after which its worker rests."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            task_ends()

    return task


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most ``most`` bytes of the column ``text``."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for row, size in enumerate(sizes):
            if row > start and total + size > most:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)
