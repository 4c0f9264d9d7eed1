"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at once (a longer document is its own step).
CHUNK_BYTES = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names; only where that is unset and Spark runs in this
    one process, a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="checkpoints-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor never makes Spark repeat what came
    before, and expensive Python stages run once however often they are read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` made and nothing reads any more."""
    files = df.inputFiles()
    if files:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        conf = df.sparkSession._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Arrow batches of ``rows`` rows at most from here on: both sides of a batch of long texts are held outside the JVM's heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty, without Python strings and, where no null holds bytes, without a copy."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not (pa.types.is_string(column.type) or kind is np.int64):
        column, kind = column.cast(pa.large_string()), np.int64
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.null_count and np.diff(at)[column.is_null().to_numpy(zero_copy_only=False)].any():
        return utf8(column.fill_null(""))
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values[at[0] : at[-1]], at - at[0]


@functools.cache
def c_library() -> ctypes.CDLL | None:
    """The C library, if it is one that can be asked to give memory back."""
    found = ctypes.CDLL(None)
    return found if hasattr(found, "malloc_trim") else None


def release(cycles: bool = True) -> None:
    """Gives what a task has freed back to the machine: a Python worker lives on, and would hold it through all later stages."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if c_library():
        c_library().malloc_trim(0)


def tidy_group(solve: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``solve`` for one group after another, giving memory back after each."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return solve(table)
        finally:
            release(cycles=False)

    return run


def tidy_pair(solve: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``tidy_group`` for cogroups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return solve(left, right)
        finally:
            release(cycles=False)

    return run


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about ``size`` (CHUNK_BYTES) bytes of text, with the text's bytes and offsets; at the end freed memory is given back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = utf8(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + (size or CHUNK_BYTES), "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last
    batch = data = at = None
    release()


def crc32_mod(column: str, mod: int):
    """crc32 of a column as text, modulo ``mod``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod
