"""What the training-data operators share: fold rules, shared-folder tables, Arrow text access."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_column: str, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees, from ``spark.checkpoint.dir``; it has to be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if spark.conf.get("spark.master", "").startswith("local") and not spark.conf.get("spark.master").startswith("local-cluster"):
        return f"file://{_own_folder()}"  # driver and executors are one process
    raise ValueError("spark.checkpoint.dir names no folder that all executors share")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Lineage ends at the files, so a lost executor costs at most the tasks it was running. The files of a session are
    in one folder, which ``remove_stored`` and the end of the driver's Python delete.
    """
    spark = df.sparkSession
    path = f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _run_folder(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)
        atexit.register(remove_stored, spark)
    return path


def remove_stored(spark: SparkSession) -> None:
    """Delete all tables that this session has stored; what was computed from them can't be computed again."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    for path in list(_FOLDERS):
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
        _FOLDERS.discard(path)


_FOLDERS: set[str] = set()


def utf8(column: pa.Array) -> list[bytes]:
    """The rows of a string column as UTF-8; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype="<i8", count=len(column) + 1 + column.offset)[column.offset :]
    data = memoryview(column.buffers()[2]) if column.buffers()[2] is not None else memoryview(b"")
    empty = column.is_null().to_pylist() if column.null_count else None
    at = offsets.tolist()
    return [b"" if empty and empty[i] else bytes(data[at[i] : at[i + 1]]) for i in range(len(column))]


def pieces(batches: Iterator[pa.RecordBatch], most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``most_bytes`` of data (one row at least).

    After the last one, what the task has freed goes back to the system: Python workers outlive their task, and
    several of them wait beside those at work when an executor goes from one stage to the next.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
    give_back()


def give_back() -> None:
    """Return memory that Arrow's pool and the C library hold free to the system, where they can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
