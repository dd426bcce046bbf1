"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import checkpoint_dir

#: Bytes of text that one step of a task looks at; bounds the Python memory of a task.
BLOCK_BYTES = 4 << 20


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors and the driver share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and later
    plans see real sizes, and a lost executor costs a re-read, not a recomputation."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage.  Spark deletes the shuffle files of a plan only once nothing on the driver
    refers to it, and a driver with memory to spare may leave them on the executors' disks for many steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI as Spark names it (``file:``, ``hdfs:``, ``s3:`` ...)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def fold(key: Column, divisor: int) -> Column:
    """crc32(key as text) modulo ``divisor``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, memoryview, np.ndarray]:
    """Offsets, UTF-8 data and null mask of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    null = column.is_null().to_numpy(zero_copy_only=False)
    if null.any():
        column = column.fill_null("")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + len(column) + 1)[column.offset:]
    data = column.buffers()[2]
    return off, memoryview(data) if data is not None else memoryview(b""), null


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; one longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors (once per application), as ``--py-files`` does."""
    name = "strata_llm_modules.zip"
    if name in spark.sparkContext._python_includes:
        return
    root = Path(__file__).resolve().parents[2]
    path = os.path.join(tempfile.mkdtemp(prefix="strata-"), name)
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted((root / "strata").rglob("*.py")):
            z.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(path)


def stream_bound(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the named columns go to Python, whatever else the input carries; the code for it is shipped."""
    ship(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in columns])


def join_classes(rows: DataFrame, classes: DataFrame, key: str, n_rows: str, shares: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``classes``, which has one row per ``key`` and their number of
    ``rows`` in ``n_rows``, safe from hot keys: a key of more than one row in ``shares`` is joined by
    broadcast, and there can't be ``shares`` such keys; the rest is an ordinary join."""
    most = rows.count() / shares
    hot = F.broadcast(classes.where(F.col(n_rows) > most))
    return (rows.join(hot, key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(classes.where(F.col(n_rows) <= most), key)))


def small(df: DataFrame, row_bytes: int, max_bytes: int = 32 << 20) -> DataFrame:
    """``df``, marked for broadcast if its rows, of ``row_bytes`` at most, are measured to fit
    ``max_bytes``; else an ordinary side of a join.  For tables that ``materialise`` wrote."""
    return F.broadcast(df) if df.count() * row_bytes <= max_bytes else df
