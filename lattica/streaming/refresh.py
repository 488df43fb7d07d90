"""Incremental refresh: windows, sessions and dedup over a stream of facts.

Runs are triggered with availableNow: a run takes what has arrived, writes its results through a
checkpointed sink, and ends. A later run goes on where it stopped. Windows close with a watermark.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.storage import shared_dir

WATERMARK = "10 minutes"


def stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A Parquet folder or file as a stream; new files are new facts."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if name.endswith(".parquet"):
        return reader.option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name[:-8]}*.parquet")
    return reader.parquet(path)


def run(out: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """The rows of a finished availableNow run, none if nothing was new; with a checkpoint of one's own the next run goes on from it.

    In complete and update mode these are the last batch's rows.
    """
    spark = out.sparkSession
    at = f"{shared_dir(spark)}/lattica-stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], out.schema).write.parquet(f"{at}/rows")  # there to be read, whatever comes
    batches: list[int] = []
    if mode == "append":

        def put(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/rows/batch={n}")  # a batch that is run again replaces itself
            batches.append(n)
    else:

        def put(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/rows/batch={n}")
            batches[:] = [n]

    q = out.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint or f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if not batches:
        return spark.read.schema(out.schema).parquet(f"{at}/rows")
    return spark.read.schema(out.schema).parquet(*(f"{at}/rows/batch={n}" for n in sorted(set(batches))))


def _timed(events: DataFrame) -> DataFrame:
    """Event time with a zone: watermarks need one, and Parquet files may hold time without."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = WATERMARK) -> DataFrame:
    """Events by window and type."""
    return _timed(events).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = WATERMARK) -> DataFrame:
    """Changes of a user debounced: one row once none has come for the gap."""
    return _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def distinct_facts(events: DataFrame, keys: list[str], late: str = WATERMARK) -> DataFrame:
    return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def tree_mark(files: DataFrame) -> DataFrame:
    """One fingerprint of a file listing (path, size): equal listings have equal ones, at any order. Files are marked apart and summed, so none meet in one task."""
    each = F.conv(F.substring(F.sha1(F.concat_ws("|", "path", F.col("size").cast("string"))), 1, 12), 16, 10).cast("decimal(38,0)")
    return files.agg(F.count(F.lit(1)).alias("files"), F.sha1(F.sum(each).cast("string")).alias("mark"))


CURRENT = "current"


def publish(tables: DataFrame | dict[str, DataFrame | Callable[[DataFrame], DataFrame]], path: str) -> bool:
    """Write a new version of a table, or of several that belong together, beside the last one, then point to it.

    A table may be given as a function of the one before it, as that was written.

    The pointer is a file that is replaced by one rename: readers see all of the old version or all of the
    new one, and a crash before the rename leaves the old one. If the (first) table is empty, nothing is
    published. The version before the last is removed.
    """
    tables = {"rows": tables} if isinstance(tables, DataFrame) else tables
    first = next(iter(tables))
    spark = tables[first].sparkSession
    version = f"v-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    fs = hadoop(version).getFileSystem(spark._jsc.hadoopConfiguration())
    written = None
    for name, table in tables.items():
        table = table(written) if callable(table) else table
        table.write.parquet(f"{path}/{version}/{name}")
        written = spark.read.schema(table.schema).parquet(f"{path}/{version}/{name}")
        if name == first and written.isEmpty():
            fs.delete(hadoop(version), True)
            return False
    last = _versions(spark, path)
    spark.createDataFrame([("\n".join([version, *last[:1]]),)], "value string").coalesce(1).write.text(f"{path}/_pointer-{version}")
    made = next(f.getPath() for f in fs.listStatus(hadoop(f"_pointer-{version}")) if f.getPath().getName().startswith("part-"))
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hadoop(version).toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fs.makeQualified(made), fs.makeQualified(hadoop(CURRENT)), overwrite)
    fs.delete(hadoop(f"_pointer-{version}"), True)
    for old in last[1:]:
        fs.delete(hadoop(old), True)
    return True


def _versions(spark: SparkSession, path: str) -> list[str]:
    """The published version, and the one before it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{CURRENT}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    return [r["value"] for r in spark.read.text(f"{path}/{CURRENT}").collect()]  # two lines


def published(spark: SparkSession, path: str, name: str = "rows") -> DataFrame:
    """The published version of a table, or of one of several."""
    return spark.read.parquet(f"{path}/{_versions(spark, path)[0]}/{name}")


def stale(tree: DataFrame, indexed_at) -> DataFrame:
    """files, newest, is_stale: whether any file (path, modificationTime) is newer than a graph's time."""
    newer = F.col("modificationTime") > F.lit(indexed_at).cast("timestamp")
    return tree.agg(F.count_if(newer).alias("files"), F.max("modificationTime").alias("newest"), F.coalesce(F.bool_or(newer), F.lit(False)).alias("is_stale"))
