"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: its allocator trims itself or not
    _libc = None

#: Folder for tables between stages where the session names none (tests, one machine).
LOCAL_SCRATCH = "/tmp/gridloom-scratch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the cluster's shared folder; removed when the JVM ends.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset (a single machine) a local one is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(base or LOCAL_SCRATCH).rstrip('/')}/gridloom/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later step reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        parent = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(parent, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer referred to.

    It does so when the driver collects its garbage, which by itself may be long
    after; what one collection finds may let go of more, so there are two.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def trim() -> None:
    """Give freed memory of this worker back: workers live on between tasks, and keep their peaks else."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def row_key() -> Column:
    """A key of a document row from its id and text; a null text is as an empty one."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; None yields nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes, order-sensitive."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for i in range(width):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
        acc ^= acc >> np.uint64(29)
    return mix64(acc)
