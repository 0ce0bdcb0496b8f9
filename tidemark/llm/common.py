"""What the operators share: tables in the shared folder, Arrow batches as bytes, rolling fingerprints."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_held: dict = {}


def held_model(key, build: Callable[[], object]) -> object:
    """The model that this Python worker holds under key. It holds one at a time: workers outlive a stage, and what the stage
    before looked up should not take memory from the next."""
    if key not in _held:
        forget_models()
        _held[key] = build()
    return _held[key]


def forget_models() -> None:
    """Gives the memory of what this Python worker holds back to the system."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or a local one where nothing is set and all runs in one JVM."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/tidemark-shared"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here, and lost executors cost no recomputation. The
    shuffle files of the write go when it ends."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    before = spark.conf.get(_CLEANUP_SETTING, None)
    spark.conf.set(_CLEANUP_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP_SETTING)
        else:
            spark.conf.set(_CLEANUP_SETTING, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    for df in tables:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_at)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most (or one row), unless the session has a bound of its own. A batch of 10,000 whole
    texts would be held several times over, by the JVM and by Python."""
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def slices(batches, text_at: int, most: int = 4 << 20):
    """Record batches cut so that the texts of each have `most` bytes at most, or are one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string or binary column, one after another, and their n + 1 bounds; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values evenly."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_CODES = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, U64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[size] = tuple(both)
    up, down = _powers[size]
    return up[:n], down[:n]


class Rolling:
    """Polynomial fingerprints of any range of `data`, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers_to(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_CODES[data] * up[: len(data)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._down[starts])

    def every(self, width: int) -> np.ndarray:
        """Of the range of `width` that starts at each place."""
        n = len(self._sums) - width
        return mixed((self._sums[width:] - self._sums[:n]) * self._down[:n]) if n > 0 else np.zeros(0, U64)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Fingerprints of ranges of data that rise and don't overlap, in pieces of whole ranges, so that a long text takes no more memory than
    short ones."""
    out, at = np.empty(len(starts), U64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + piece, side="right")))
        base = starts[at]
        out[at:to] = Rolling(data[base : ends[to - 1]]).of(starts[at:to] - base, ends[at:to] - base)
        at = to
    return out


def row_keys(df: DataFrame, text: str = "text") -> DataFrame:
    """Columns _d and _t, which name a document by id and text, so that joins stand null and repeated ids."""
    return df.withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn("_t", F.xxhash64(F.col("doc_id"), F.col(text)))
