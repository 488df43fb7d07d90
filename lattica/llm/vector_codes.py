"""Vector code compression: product quantisation in whole numbers, so that every machine gives the same codes.

A component x becomes the integer floor(scale * x). A vector is cut into `parts` consecutive parts, and each
part position has a codebook of up to `entries` integer entries. It starts as that part of the vectors with
the smallest ids. A round broadcasts the codebooks (parts x entries x width integers, a size that the
parameters bound); every task adds up its parts by nearest entry, batch by batch, and a grouped shuffle
merges the tasks' sums. An entry becomes the componentwise floor(sum / count) of its parts, one without parts stays.

Distances of a batch to all entries come from |x|^2 - 2 x.c + |c|^2 with one int64 matrix product a part; equal
distances go to the lower entry. Where values are so large that int64 might not hold a distance, the same is
computed with Python's unbounded integers. Sums travel as limbs of 31 bits, each added up as a long, so they are
exact however many or large the values are.

Vectors are read from the input in every round and nothing of its size is kept, so lost executors cost a
recomputation of their tasks.

A row whose vector is null, or holds a null or a non-finite component, is dropped, and so is one whose length is
not that of the kept vector with the smallest id. A length that `parts` does not divide is cut at floor(i * length / parts). Null ids come after all
others; of rows with one id the least vector (position by position) stands for it among the first codebooks, and
each row has a code of its own. Fewer ids than `entries` make smaller codebooks; an empty table has none and
gives an empty result. `encode` keeps extra columns and replaces those named as its results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lattica.llm.common import free_name, lean, ship, written

#: Bits of a limb, and limbs of a sum: doubles reach 2^1024, their scaled sums a little more.
LIMB_BITS = 31
#: Below this bound of |value| components are held in int64.
INT_BOUND = 1 << 62
#: Rows of the table of sums by label up to which it is broadcast (some 30 bytes each).
BROADCAST_LABELS = 200_000
LONG_MAX = (1 << 63) - 1


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite numbers: int64 where it surely fits, else Python integers."""
    x = values.astype(np.float64)
    if not x.size or np.abs(x).max() < INT_BOUND / scale and scale & (scale - 1) == 0:
        return np.floor(x * scale).astype(np.int64)
    exact = [n * scale // d for n, d in map(float.as_integer_ratio, x.ravel().tolist())]
    return np.array(exact, object).reshape(x.shape)


def cuts(width: int, parts: int) -> list[int]:
    return [i * width // parts for i in range(parts + 1)]


@dataclass
class Codebooks:
    """Per part a list of integer entries; `width` is the length of a vector."""

    entries: list[list[list[int]]]
    width: int
    scale: int = 4096

    @property
    def parts(self) -> int:
        return len(self.entries)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for e in part for x in e).encode()).hexdigest()

    def decode(self, codes: list[int]) -> list[float]:
        """The vector that a code stands for."""
        return [x / self.scale for part, k in zip(self.entries, codes, strict=True) for x in part[k]]


def kept(column: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors of a batch (all of `width`; of any length if None) and, with a width, their components."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts = np.asarray(lists.offsets)
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ok = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[starts[1:]] == bad[starts[:-1]])
    if width is None:
        return np.flatnonzero(ok), flat
    rows = np.flatnonzero(ok & (np.diff(starts) == width))
    return rows, flat[(starts[:-1][rows, None] + np.arange(width)).ravel()].reshape(len(rows), width)


def nearest(x: np.ndarray, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first nearest entry and the squared distance to it, exactly."""
    width = x.shape[1]
    c = np.array(entries, object).reshape(len(entries), width)
    most = max([abs(v) for v in c.ravel()], default=0) + (int(np.abs(x).max()) if x.size else 0)
    kind = np.int64 if width * most * most < INT_BOUND else object
    x, c = x.astype(kind), c.astype(kind)
    if not width:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    norms = (c * c).sum(axis=1)
    rest = norms[None, :] - 2 * (x @ c.T)
    first = np.argmin(rest, axis=1)
    return first, (x * x).sum(axis=1) + rest[np.arange(len(x)), first]


def _limbs(value: int) -> list[int]:
    """The value as signed digits of 31 bits, lowest first."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << LIMB_BITS) - 1)))
        value >>= LIMB_BITS
    return out or [0]


def _seeds(vectors: DataFrame, id_col: str, vector: str, entries: int, width: int | None = None) -> list[list[float]]:
    """The vectors (of `width`, if given) of the `entries` smallest ids: each task gives its own few, a grouped shuffle merges them."""
    schema = StructType([StructField("id", vectors.schema[id_col].dataType), StructField("v", ArrayType(vectors.schema[vector].dataType.elementType))])
    arrow = to_arrow_schema(schema)
    order = lambda i: (i is None, i)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            rows, _ = kept(b.column(1), width)
            ids = b.column(0).take(pa.array(rows)).to_pylist()
            worst = max(held, key=order) if len(held) >= entries else None
            some = [k for k, i in enumerate(ids) if len(held) < entries or order(i) <= order(worst)]
            some = sorted(some, key=lambda k: order(ids[k]))
            distinct = sorted({*(ids[k] for k in some)}, key=order)[:entries]
            chosen = set(distinct)
            some = [k for k in some if ids[k] in chosen]
            for k, v in zip(some, b.column(1).take(pa.array(rows[some])).to_pylist(), strict=True):
                held[ids[k]] = min(held.get(ids[k], v), v)
            held = {i: held[i] for i in sorted(held, key=order)[:entries]}
        yield pa.RecordBatch.from_pydict({"id": list(held), "v": list(held.values())}, schema=arrow)

    few = vectors.select(vectors[f"`{id_col}`"], vectors[f"`{vector}`"]).mapInArrow(lean(least), schema)
    merged = few.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.col("id").asc_nulls_last()).limit(entries)
    return [r["v"] for r in merged.collect()]  # at most `entries` rows


def _sums(vectors: DataFrame, vector: str, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and componentwise sum of the parts nearest to each entry."""
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(books)
    schema = StructType([StructField(n, LongType()) for n in ("part", "entry", "place", "limb", "value")])
    arrow = to_arrow_schema(schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        at = cuts(books.width, books.parts)
        total: dict[tuple[int, int], list[int]] = {}
        for b in batches:
            rows, values = kept(b.column(0), books.width)
            if not len(rows):
                continue
            x = whole(values, books.scale)
            for p, entries in enumerate(books.entries):
                own = x[:, at[p] : at[p + 1]]
                to, _ = nearest(own, entries)
                narrow = own.dtype != object and (not own.size or int(np.abs(own).max()) * len(own) < INT_BOUND)
                for e in np.unique(to).tolist():
                    those = own[to == e]
                    sums = [len(those), *(those.sum(axis=0) if narrow else those.astype(object).sum(axis=0)).tolist()]
                    had = total.get((p, e))
                    total[p, e] = [a + c for a, c in zip(had, sums, strict=True)] if had else sums
        rows = [(p, e, place, limb, v) for (p, e), sums in total.items() for place, s in enumerate(sums, -1) for limb, v in enumerate(_limbs(s))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], schema=arrow)

    merged = vectors.select(vectors[f"`{vector}`"]).mapInArrow(lean(add), schema).groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value"))
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in merged.collect():  # parts x entries x (width + 1) x limbs rows at most
        places = found.setdefault((r["part"], r["entry"]), {})
        places[r["place"]] = places.get(r["place"], 0) + (r["value"] << (LIMB_BITS * r["limb"]))
    sent.unpersist()
    return {k: (v[-1], [v[i] for i in sorted(v) if i >= 0]) for k, v in found.items()}


def fit(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """Codebooks after `rounds` rounds over all vectors; None where no vector is usable."""
    if min(parts, entries) < 1 or scale < 1:
        raise ValueError("parts, entries and scale must be positive")
    ship(vectors.sparkSession)
    first = _seeds(vectors, id_col, vector, entries)
    if not first:
        return None
    width = len(first[0])
    at = cuts(width, parts)
    if any(len(v) != width for v in first):
        first = _seeds(vectors, id_col, vector, entries, width)
    seeds = [whole(np.array(v, np.float64), scale).tolist() for v in first]
    books = Codebooks([[v[at[p] : at[p + 1]] for v in seeds] for p in range(parts)], width, scale)
    for _ in range(rounds):
        for (p, e), (count, sums) in _sums(vectors, vector, books).items():
            books.entries[p][e] = [s // count for s in sums]
    return books


def encode(vectors: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """Adds `codes` (array of entry numbers by part), `code` (two hex digits a part) and `error` (squared distance in scaled units).

    `vector` isn't returned. An error beyond 2^63 - 1 is given as that number; with more than 256 entries a number has as many hex digits as it needs.
    """
    ship(vectors.sparkSession)
    new = [StructField("codes", ArrayType(LongType())), StructField("code", StringType()), StructField("error", LongType())]
    names = {f.name for f in new}
    keep = [c for c in vectors.columns if c != vector and c.lower() not in names]
    schema = StructType([vectors.schema[c] for c in keep] + new)
    arrow = to_arrow_schema(schema)
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        at = cuts(books.width, books.parts)
        for b in batches:
            rows, values = kept(b.column(len(keep)), books.width)
            x = whole(values, books.scale)
            to, far = zip(*(nearest(x[:, at[p] : at[p + 1]], entries) for p, entries in enumerate(books.entries)), strict=True)
            wide = any(d.dtype == object for d in far) or sum(int(d.max()) for d in far if len(d)) > LONG_MAX
            error = sum(d.astype(object) if wide else d for d in far)
            codes = np.stack(to, axis=1).tolist()
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).take(pa.array(rows)) for k in range(len(keep))), pa.array(codes, pa.list_(pa.int64())), pa.array(["".join(f"{k:02x}" for k in c) for c in codes], pa.string()), pa.array([min(int(e), LONG_MAX) for e in error], pa.int64())],
                schema=arrow,
            )

    return vectors.select(*(vectors[f"`{c}`"] for c in keep), vectors[f"`{vector}`"]).mapInArrow(lean(coded), schema)


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Adds label_error, the sum of errors over rows of equal label, nulls together; sums beyond 2^63 - 1 are given as that number.

    Sums are formed before the shuffle. Their table is broadcast up to BROADCAST_LABELS rows, as counted, and joined by a shuffle beyond.
    """
    own = written(coded, "vector-codes")  # codes and errors, without the vectors
    sums = written(own.groupBy(F.col(f"`{label}`").alias("its_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s")), "label-errors")
    few = sums.count() <= BROADCAST_LABELS
    other = free_name(own, "its_label")
    sums = sums.select(F.col("its_label").alias(other), F.least("s", F.lit(LONG_MAX)).cast("long").alias("label_error"))
    return own.drop("label_error").join(F.broadcast(sums) if few else sums, own[f"`{label}`"].eqNullSafe(F.col(other)), "left").drop(other)


def report(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code, error, label_error and the digest of the codebooks for each usable row of (vec_id, embedding, label)."""
    chosen = vectors.select("vec_id", "embedding", "label")
    books = fit(chosen, parts=parts, entries=entries, rounds=rounds, scale=scale)
    if books is None:
        return chosen.where(F.lit(False)).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    return with_label_error(encode(chosen, books)).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
