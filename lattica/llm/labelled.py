"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: UTF-8 bytes of a sample's texts: fewer rows are taken where texts are long.
SAMPLE_BYTES = 48_000_000


def remainder(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; -1 without an id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce((F.crc32(column.cast("string").cast("binary")) % folds).cast("int"), F.lit(-1))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, size: int = SAMPLE_BYTES) -> DataFrame:
    """order, label (0 or 1) and text of at most `rows` labels outside the held-out fold, those of the least id hashes.

    Texts are whole. Rows are taken until they hold `size` bytes; the first one is taken however long it is.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder("doc_id", folds) != held_out))
    chosen = usable.select(F.xxhash64("doc_id").alias("order"), F.col("doc_id").alias("labelled"), F.col(label).cast("int").alias("label")).orderBy("order", "labelled", "label").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lengths = texts.select("doc_id", F.octet_length("text").cast("long").alias("bytes")).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))  # at most `rows` ids are sent
    by_order = Window.orderBy("order", "labelled", "bytes", "label").rowsBetween(Window.unboundedPreceding, -1)
    within = lengths.groupBy("order", "labelled", "label").agg(F.sum("bytes").alias("bytes")).withColumn("before", F.coalesce(F.sum("bytes").over(by_order), F.lit(0))).where(F.col("before") < size)  # at most `rows` rows
    return texts.join(F.broadcast(within), F.col("doc_id") == F.col("labelled")).select("order", "label", "text")
