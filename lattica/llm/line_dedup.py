"""Line dedup with sharded cuckoo filters backed by exact reference counts.

A line's key is the line without white space at its ends and with A-Z lower-cased; keys are held as
128-bit hashes. The index of a corpus has three tables, all sharded by the key's hash:

- postings: each (key, document) once, the exact references;
- counts: per key the number of documents and the largest doc_id, summed before the shuffle;
- filters: per shard one cuckoo filter of the keys that `min_docs` documents hold.

Dedup sends a document's keys to their shard, where the cuckoo filter lets through only lines that
are probably repeated; the exact counts then decide. Inserting or deleting documents changes the
postings and recounts the keys they touch; each shard's filter is updated in place, by inserting
the keys that became repeated and deleting those that no longer are. Deleting what was inserted
gives the former index, so dedup stays reversible.

A hot key has as many postings as documents: probes of a shard are dealt over salts, each with a
copy of the shard's filter, and the exact join is one whose skew Spark can split.

Null or empty texts are one empty line. Rows of equal doc_id count as one document and lose the
same lines; a null doc_id is one document, smaller than all others. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lattica.llm.common import forget, lean, raw, ship, written

#: Keys of one shard's filter, about.
SHARD_KEYS = 200_000
#: Postings of one probing group, about.
GROUP_ROWS = 500_000


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; supports deletion. Keys are 64-bit hashes."""

    SLOTS = 4

    def __init__(self, buckets: int) -> None:
        self.buckets = 1 << max(1, (buckets - 1).bit_length())
        self.table = np.zeros((self.buckets, self.SLOTS), np.uint16)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        out = cls(max(2, int(len(keys) / (cls.SLOTS * 0.8)) + 1))
        while True:
            if all(out.insert(k) for k in keys.tolist()):
                return out
            out = cls(out.buckets * 2)

    @staticmethod
    def _mix(x: int) -> int:
        x = (x ^ (x >> 31)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        return x ^ (x >> 29)

    def _places(self, key: int) -> tuple[int, int, int]:
        x = self._mix(key & 0xFFFFFFFFFFFFFFFF)
        print_ = (x >> 48) or 1
        first = x & (self.buckets - 1)
        return print_, first, first ^ (self._mix(print_) & (self.buckets - 1))

    def insert(self, key: int) -> bool:
        """False if no place was found; the filter is then too full and must be rebuilt."""
        mark, i, j = self._places(key)
        for place in (i, j):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return True
        undo = []
        for turn in range(500):
            slot = (mark + turn) % self.SLOTS
            undo.append((i, slot, int(self.table[i, slot])))
            mark, self.table[i, slot] = int(self.table[i, slot]), mark
            i ^= self._mix(mark) & (self.buckets - 1)
            free = np.flatnonzero(self.table[i] == 0)
            if len(free):
                self.table[i, free[0]] = mark
                return True
        for place, slot, was in reversed(undo):
            self.table[place, slot] = was
        return False

    def delete(self, key: int) -> bool:
        """Takes one copy of a key that was inserted before."""
        mark, i, j = self._places(key)
        for place in (i, j):
            found = np.flatnonzero(self.table[place] == mark)
            if len(found):
                self.table[place, found[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.int64).view(np.uint64)
        mixed = self._mix_all(x)
        marks = np.maximum(mixed >> np.uint64(48), np.uint64(1))
        ones = np.uint64(self.buckets - 1)
        first = mixed & ones
        second = first ^ (self._mix_all(marks) & ones)
        marks = marks.astype(np.uint16)[:, None]
        return (self.table[first.astype(np.int64)] == marks).any(1) | (self.table[second.astype(np.int64)] == marks).any(1)

    @staticmethod
    def _mix_all(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls(2)
        out.table = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        out.buckets = len(out.table)
        return out


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key, or null if it is shorter than so many code points."""
    key = line.strip().lower()  # of bytes: ASCII white space and letters alone
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return key


def hash_key(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


@dataclass
class LineIndex:
    """The tables of an indexed corpus; see the module's docstring."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int
    min_docs: int


def postings_of(docs: DataFrame, min_chars: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """k0, k1, doc_id: each document's keys, once for each row."""
    ship(docs.sparkSession)
    schema = StructType([StructField("k0", LongType()), StructField("k1", LongType()), StructField("doc_id", docs.schema[doc_id].dataType)])
    arrow = to_arrow_schema(schema)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k0, k1, at = [], [], []
            for k, data in enumerate(raw(b.column("text"))):
                keys = {key for line in data.split(b"\n") if (key := line_key(line, min_chars)) is not None}
                for h0, h1 in map(hash_key, keys):
                    k0.append(h0)
                    k1.append(h1)
                at += [k] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(k0, pa.int64()), pa.array(k1, pa.int64()), b.column("doc_id").take(pa.array(at, pa.int32()))], schema=arrow)

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).select("text", "doc_id").mapInArrow(lean(keyed), schema)


def _counted(postings: DataFrame, min_docs: int) -> DataFrame:
    """Repeated keys with their documents; postings must be distinct."""
    return postings.groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keep")).where(F.col("n_docs") >= min_docs)


def _shard(shards: int):
    return F.pmod("k1", F.lit(shards)).cast("int")


FILTERS = "shard int, filter binary"


def _filters(counts: DataFrame, shards: int) -> DataFrame:
    def build(t: pa.Table) -> pa.Table:
        made = CuckooFilter.of(t.column("k0").to_numpy())
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "filter": pa.array([made.to_bytes()], pa.binary())})

    return counts.select(_shard(shards).alias("shard"), "k0").groupBy("shard").applyInArrow(build, FILTERS)


def build(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, shard_keys: int = SHARD_KEYS) -> LineIndex:
    postings = written(postings_of(docs, min_chars).dropDuplicates(["k0", "k1", "doc_id"]), "postings")
    counts = written(_counted(postings, min_docs), "counts")
    shards = -(-counts.count() // shard_keys) or 1
    filters = written(_filters(counts, shards), "filters")
    return LineIndex(postings, counts, filters, shards, min_chars, min_docs)


def _updated(index: LineIndex, postings: DataFrame, touched: DataFrame) -> LineIndex:
    """The index over new postings; only the filters' changed keys are put in or taken out."""
    postings = written(postings, "postings")
    keys = touched.select("k0", "k1").distinct()
    again = _counted(postings.join(keys, ["k0", "k1"], "left_semi"), index.min_docs)
    counts = written(index.counts.join(keys, ["k0", "k1"], "left_anti").unionByName(again), "counts")
    had, has = index.counts.select("k0", "k1"), counts.select("k0", "k1")
    changes = had.join(has, ["k0", "k1"], "left_anti").withColumn("put", F.lit(False)).unionByName(has.join(had, ["k0", "k1"], "left_anti").withColumn("put", F.lit(True)))
    rows = changes.select(_shard(index.shards).alias("shard"), "k0", "put")

    def change(old: pa.Table, new: pa.Table) -> pa.Table:
        shard = (old if old.num_rows else new).column("shard")[0].as_py()
        f = CuckooFilter.from_bytes(old.column("filter")[0].as_py()) if old.num_rows else CuckooFilter.of(np.array([], np.int64))
        keys, put = new.column("k0").to_pylist(), new.column("put").to_pylist()
        for k, p in zip(keys, put, strict=True):
            if not p:
                f.delete(k)
        full = not all([f.insert(k) for k, p in zip(keys, put, strict=True) if p])
        return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([None if full else f.to_bytes()], pa.binary())})

    changed = index.filters.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(change, FILTERS)
    filters = written(changed, "filters")
    full = filters.where("filter is null").select("shard")
    if full.limit(1).count():  # a shard that ran full is built anew from the exact counts
        anew = _filters(counts.withColumn("shard", _shard(index.shards)).join(full, "shard", "left_semi").drop("shard"), index.shards)
        filters = written(filters.where("filter is not null").unionByName(anew), "filters")
    return LineIndex(postings, counts, filters, index.shards, index.min_chars, index.min_docs)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """Adds documents; those that the index has already add the lines that are new."""
    new = written(postings_of(docs, index.min_chars), "added")
    return _updated(index, index.postings.unionByName(new).dropDuplicates(["k0", "k1", "doc_id"]), new)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """Takes out the documents of column doc_id."""
    gone = doc_ids.select(F.col("doc_id").alias("gone")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("gone"))
    return _updated(index, index.postings.join(gone, same, "left_anti"), index.postings.join(gone, same, "left_semi"))


def drops(index: LineIndex, postings: DataFrame) -> DataFrame:
    """doc_id, k0, k1 of the lines that the postings' documents lose."""
    spark = postings.sparkSession
    salts = -(-postings.count() // (index.shards * GROUP_ROWS)) * 8 or 1
    probes = postings.select(_shard(index.shards).alias("shard"), F.pmod(F.xxhash64("doc_id", "k1"), F.lit(salts)).cast("int").alias("salt"), "k0", "k1", "doc_id")
    filters = index.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "filter")
    schema = StructType([postings.schema[c] for c in ("k0", "k1", "doc_id")])
    arrow = to_arrow_schema(schema)

    def probe(lines: pa.Table, held: pa.Table) -> pa.Table:
        if not held.num_rows or not lines.num_rows:
            return arrow.empty_table()
        hit = CuckooFilter.from_bytes(held.column("filter")[0].as_py()).contains(lines.column("k0").to_numpy())
        return lines.select(["k0", "k1", "doc_id"]).filter(pa.array(hit))

    ship(spark)
    possible = probes.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInArrow(probe, schema)
    return possible.join(index.counts, ["k0", "k1"]).where(F.coalesce(F.col("doc_id") < F.col("keep"), F.col("keep").isNotNull())).select("doc_id", "k0", "k1")


def deduplicated(docs: DataFrame, index: LineIndex | None = None, min_chars: int = 20, min_docs: int = 3, text: str = "text", lines: bool = True) -> DataFrame:
    """The documents with the lines they keep, and n_lines (before) and n_dropped if `lines`.

    Without an index the documents themselves are indexed. Rows of a document are all returned.
    """
    own = index is None
    index = index or build(docs, min_chars, min_docs)
    lost = drops(index, index.postings if own else postings_of(docs, index.min_chars).dropDuplicates(["k0", "k1", "doc_id"]))
    lists = lost.groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_list(F.struct("k0", "k1")).alias("gone"))
    counted = [StructField("n_lines", LongType()), StructField("n_dropped", LongType())]
    least = index.min_chars
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != text)).alias("row"), docs["doc_id"].alias("id"), docs[f"`{text}`"].alias("text"))
    joined = packed.join(lists, F.col("id").eqNullSafe(F.col("gone_id")), "left").select("row", "text", "gone")
    schema = StructType([joined.schema["row"], StructField("text", StringType()), *counted])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for data, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                if not gone:
                    texts.append(data)
                    n_lines.append((data or "").count("\n") + 1)
                    n_dropped.append(0)
                    continue
                gone = {(g["k0"], g["k1"]) for g in gone}
                had = data.encode().split(b"\n")
                kept = [line for line in had if (key := line_key(line, least)) is None or hash_key(key) not in gone]
                texts.append(b"\n".join(kept).decode())
                n_lines.append(len(had))
                n_dropped.append(len(had) - len(kept))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, arrow.field("text").type), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], schema=arrow)

    done = joined.mapInArrow(lean(cut), schema)
    names = {"n_lines", "n_dropped"} if lines else set()
    return done.select(*(F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in names), *sorted(names, reverse=True))


def report(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    kept = deduplicated(docs.select("doc_id", "text"), None, min_chars, min_docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


__all__ = ["CuckooFilter", "LineIndex", "build", "deduplicated", "delete", "drops", "forget", "insert", "postings_of", "report"]
