"""What the training-data operators share: the shared folder, written tables, words and their hashes."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one that the cluster names in spark.checkpoint.dir.

    Where none is named, a local session (tests) gets a temporary one; on a cluster that is an error, since
    executors don't see each other's disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tracewright-{uuid.uuid4().hex}"


def written(df: DataFrame, *, partition_by: tuple[str, ...] = (), compression: str | None = None, batch_rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so a lost executor costs no recomputation.

    batch_rows: so many rows at most go to a Python worker at once, in this write alone."""
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    if compression:
        writer = writer.option("compression", compression)
    with batches_of(spark, batch_rows):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int | None):
    """Within it, Arrow batches of at most so many rows (None: as the session has it)."""
    before = spark.conf.get(BATCH_ROWS)
    if rows:
        spark.conf.set(BATCH_ROWS, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        if rows:
            spark.conf.set(BATCH_ROWS, before)


def give_back() -> None:
    """Give memory that nothing uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other C libraries need not
    if trim:
        trim(0)


_KEPT: dict[str, dict] = {}


def worker_cache(operator: str) -> dict:
    """What a Python worker keeps between tasks of one operator.

    Workers outlive stages, so a task of another operator first drops what the last one kept, and gives the memory
    back to the system: an executor holds the caches of one operator, however many stages a session runs.
    """
    if operator not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[operator] = {}
    return _KEPT[operator]


def unclash(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns that an operator adds win; columns of the input with such a name become in_<name>."""
    for name in names:
        if name in df.columns:
            df = df.withColumnRenamed(name, f"in_{name}")
    return df


def text_bytes(col: str = "text") -> Column:
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")


def total_bytes(docs: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of all texts: one number, summed on the executors."""
    return int(docs.agg(F.sum(text_bytes(col))).first()[0] or 0)


def parts_for(n_bytes: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(n_bytes / each))


def words(text: str | None) -> list[bytes]:
    """Runs of anything but space and U+0009 to U+000D; bytes.split() breaks at just these."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word, the same on every machine."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))


#: An odd multiplier for the polynomial hash of word runs.
STEP = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64 bits: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n consecutive words, by doubling: log2(n) vector operations."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    power, have, done, out = hashes, 1, 0, None
    with np.errstate(over="ignore"):
        while True:
            if n & have:
                if out is None:
                    out = power
                else:  # out covers `done` words, then `have` more follow
                    m = len(hashes) - done - have + 1
                    out = out[:m] * np.uint64(pow(STEP, have, 1 << 64)) + power[done : done + m]
                done += have
            if have * 2 > n:
                break
            m = len(power) - have
            power = power[:m] * np.uint64(pow(STEP, have, 1 << 64)) + power[have : have + m]
            have *= 2
        return mixed(out[: len(hashes) - n + 1])
