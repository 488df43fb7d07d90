"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.

    Where it names none, a temporary folder of a session whose executors run in the driver's own process, as in
    tests; on a cluster that is an error, as each executor would write to a disk that the others don't see.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = getattr(spark.sparkContext, "_lattica_graph_dir", None)
        if not found:
            found = spark.sparkContext._lattica_graph_dir = f"file://{tempfile.mkdtemp(prefix='lattica-graph-')}"
            _keep(spark, found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows written and read again, so that an iteration's lineage ends and lost executors cost nothing but a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _keep(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def release(df: DataFrame | None) -> None:
    path = getattr(df, "_lattica_path", None)
    if path:
        _remove(df.sparkSession, path)
        _kept.pop(path, None)


def _keep(spark: SparkSession, path: str) -> None:
    if not _kept:
        atexit.register(lambda: [_remove(s, p) for p, s in _kept.items() if s.sparkContext._jsc is not None])
    _kept[path] = spark


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
