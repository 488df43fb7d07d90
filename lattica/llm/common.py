"""Helpers that the corpus operators share: table access, Arrow batches, shared-folder tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]

#: Upper-case to lower-case for A-Z alone; Spark's lower() would also change other letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of the batches that Python workers get, and rows that a file is decoded by, where the session has left Spark's own, which suit short rows.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "16777216")}


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors where the launch environment doesn't, and batches fit long texts."""
    for key, (usual, own) in BATCHES.items():
        if spark.conf.get(key, usual) in (usual, "64MB", f"{usual}b"):
            spark.conf.set(key, own)
    places = {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    sc = spark.sparkContext
    if str(ROOT) in places or any(os.path.realpath(f"{p}/lattica") == str(ROOT / "lattica") for p in places):
        return
    if getattr(sc, "_lattica_shipped", False):
        return
    out = Path(tempfile.mkdtemp()) / "lattica_package.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in (ROOT / "lattica").rglob("*.py"):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(out))  # the driver's file server hands it to every executor
    sc._lattica_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where it names none, a temporary one of a session whose executors run in the driver's own process; on a
    cluster that is an error, as each executor would write to a disk that the others don't see.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = getattr(spark.sparkContext, "_lattica_shared", None)
        if not found:
            found = spark.sparkContext._lattica_shared = f"file://{tempfile.mkdtemp(prefix='lattica-shared-')}"
            drop_at_exit(spark, found)
    return found.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception as e:  # the session may have ended; what is left is only space
        print(f"not removed: {path}: {type(e).__name__}")


_leftover: dict[str, SparkSession] = {}


def drop_at_exit(spark: SparkSession, path: str) -> None:
    if not _leftover:
        atexit.register(_drop_all)
    _leftover[path] = spark


def _drop_all() -> None:
    for path, spark in _leftover.items():
        if spark.sparkContext._jsc is not None:
            drop(spark, path)


#: Rows of one file of a table whose rows were bounded by a count before it was written.
FILE_ROWS = 100_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and outlives executors.

    `rows`: at most so many, by a count; they need no more tasks and files than that.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(rows // FILE_ROWS + 1)
    path = f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def forget(df: DataFrame | None) -> None:
    """Remove a table made by written() that nothing reads any more."""
    path = getattr(df, "_lattica_path", None)
    if path:
        drop(df.sparkSession, path)
        _leftover.pop(path, None)


def raw(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def _trim() -> None:
    """Gives freed memory back to the system; where the C library can't, nothing happens."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same over batches, by a worker that holds no freed memory while it waits for another task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            _trim()

    return run


def batches_of(schema: pa.Schema, rows: Iterable[dict[str, list]]) -> Iterator[pa.RecordBatch]:
    for columns in rows:
        yield pa.RecordBatch.from_pydict({f.name: columns[f.name] for f in schema}, schema=schema)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
