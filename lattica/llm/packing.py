"""Best-fit packing with bins of several permitted capacities.

Items are taken by decreasing length. Each goes to the fullest open bin that still has room for it;
if none has, the bin size is opened that costs least for each token it is likely to hold: the item,
and what of the smaller items still to come would fill the rest. At the end every bin is downsized
to the smallest permitted capacity that holds its contents. Items longer than the largest capacity
are split: full bins, and a remainder that is packed like any other item.

All items of a length are alike, so a packing is computed on a histogram of lengths: bins in the
same state form runs, and one step places as many items as a run takes. The result is the same as
item by item, and its size depends on the largest capacity, not on the number of items.

`sequences` packs documents into sequences of tokens and gives each sequence's content. Documents are
dealt by a hash of what they hold into shards of about `SHARD_BYTES` of text, and each shard is packed
by itself: tokens move once, and no step sees all documents. A shard's last bins are downsized like
all others, so what it costs to pack by shards is a part of one sequence in each. Copies have one
hash; where one text has more bytes in all than a shard should, its rows are dealt over more shards.

`packed` gives places to items of which only the lengths are known, all packed together: items get
their places by their rank among those of equal length, counted in two levels (offsets of shards,
ranks within a shard), so a length that a third of all rows have doesn't meet in one task.

Null and empty texts have length 0: they are in no bin. Rows of equal id are separate items. Extra
columns pass through `packed`, those with a result's name are replaced; `sequences` doesn't read them.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from lattica.llm.common import lean, ship, written

CAPACITIES = (512, 1024, 2048, 4096)
#: What a sequence costs beside its tokens, in tokens.
SEQUENCE_COST = 16
#: Items that share a shard of packed(), about; ranks are counted within shards.
SHARD_ROWS = 200_000
#: Bytes of text in a shard of sequences(), about.
SHARD_BYTES = 4_000_000


class Plan:
    """Where the items of each length go: runs of ranks, and the bins' capacities."""

    def __init__(self, counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, sequence_cost: int = SEQUENCE_COST) -> None:
        self.sizes = sorted(set(capacities))
        self.cost = sequence_cost
        self.left = {n: c for n, c in counts.items() if n > 0 and c > 0}
        if self.left and max(self.left) > self.sizes[-1]:
            raise ValueError("an item is longer than the largest capacity")
        #: length, first rank, items, first bin, items a bin, place in the bin
        self.steps: list[tuple[int, int, int, int, int, int]] = []
        #: runs of bins (first, end, capacity opened) by room left
        self.open: dict[int, deque[tuple[int, int, int]]] = {}
        self.rooms: list[int] = []
        self.bins = 0
        self.volume = sum(n * c for n, c in self.left.items())
        for n in sorted(self.left, reverse=True):
            self._place(n, self.left[n])
        #: first bin, end, capacity, tokens held
        self.runs = sorted((a, b, self.sizes[bisect_left(self.sizes, opened - room)], opened - room) for room, runs in self.open.items() for a, b, opened in runs)

    def _add(self, room: int, run: tuple[int, int, int]) -> None:
        if room not in self.open:
            self.open[room] = deque()
        if not self.open[room]:
            insort(self.rooms, room)
        self.open[room].append(run)

    def _best_size(self, n: int, smaller: int) -> int:
        """The capacity of least cost a token: bins fill with items of this length, the rest as far as smaller items go round."""
        def rate(size: int) -> float:
            whole = size // n * n
            return (size + self.cost) / (whole + min(size - whole, smaller))

        return min((c for c in self.sizes if c >= n), key=lambda c: (rate(c), c))

    def _place(self, n: int, items: int) -> None:
        rank = 0
        self.volume -= n * items
        while items:
            k = bisect_left(self.rooms, n)
            if k == len(self.rooms):
                size = self._best_size(n, self.volume)
                per = size // n
                some = max(1, items // per)
                self._add(size, (self.bins, self.bins + some, size))
                self.bins += some
                continue
            room = self.rooms[k]
            first, end, opened = self.open[room].popleft()
            if not self.open[room]:
                self.rooms.pop(k)
            per = min(room // n, items)
            some = min(end - first, items // per)
            self.steps.append((n, rank, per * some, first, per, opened - room))
            rank += per * some
            items -= per * some
            if first + some < end:
                self.open.setdefault(room, deque()).appendleft((first + some, end, opened))
                if len(self.open[room]) == 1:
                    insort(self.rooms, room)
            self._add(room - per * n, (first, first + some, opened))


RESULT = [T.StructField("piece", T.IntegerType()), T.StructField("piece_start", T.LongType()), T.StructField("piece_length", T.LongType()), T.StructField("bin", T.LongType()), T.StructField("bin_capacity", T.IntegerType()), T.StructField("bin_place", T.IntegerType())]


def packed(items: DataFrame, length: str | Column, capacities: tuple[int, ...] = CAPACITIES, sequence_cost: int = SEQUENCE_COST, tie: str = "doc_id") -> DataFrame:
    """One row per piece of every item: its own columns, piece, piece_start, piece_length, bin, bin_capacity, bin_place.

    `length` is in tokens; equal lengths are ranked by a hash of the row, then `tie`, so rows that change
    places are equal but for columns of maps. Bins that full
    pieces of split items fill are numbered after those that were packed.
    """
    spark = items.sparkSession
    ship(spark)
    top = max(capacities)
    names = {f.name for f in RESULT}
    own = [c for c in items.columns if c.lower() not in names]
    measured = items.select(F.struct(*(items[f"`{c}`"] for c in own)).alias("row"), F.coalesce(items[length] if isinstance(length, str) else length, F.lit(0)).cast("long").alias("n"), F.xxhash64(F.col(f"`{tie}`"), *(F.col(f"`{c}`") for c in own if "map<" not in items.schema[c].dataType.simpleString())).alias("h"), F.col(f"`{tie}`").alias("tie"))
    measured = written(measured, "lengths")
    shards = -(-measured.count() // SHARD_ROWS) or 1
    rest = F.col("n") % top
    placed = measured.withColumn("rest", rest).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    histogram = written(placed.groupBy("rest", "shard").agg(F.count(F.lit(1)).alias("items"), F.sum(F.expr(f"n div {top}")).alias("full")), "histogram")
    counts = {r["rest"]: r["items"] for r in histogram.groupBy("rest").agg(F.sum("items").alias("items")).collect()}  # at most `top` rows
    plan = Plan(counts, capacities, sequence_cost)
    steps = sorted(plan.steps)
    model = spark.sparkContext.broadcast((np.array(steps or [(0,) * 6], np.int64), np.array(plan.runs or [(0, 0, 0, 0)], np.int64), plan.bins))  # bounded by the largest capacity
    offsets = histogram.select("rest", "shard", (F.sum("items").over(Window.partitionBy("rest").orderBy("shard")) - F.col("items")).alias("before"))
    full_offsets = histogram.groupBy("shard").agg(F.sum("full").alias("full")).select(F.col("shard").alias("own"), (F.sum("full").over(Window.orderBy("shard")) - F.col("full")).alias("full_before"))  # a row per shard
    by_length = Window.partitionBy("rest", "shard").orderBy("h", "tie")
    in_shard = Window.partitionBy("shard").orderBy("h", "tie").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.expr(f"n div {top}")
    long_items = placed.where(F.col("n") >= top).withColumn("full_rank", F.coalesce(F.sum(whole).over(in_shard), F.lit(0))).join(full_offsets, F.col("shard") == F.col("own")).withColumn("full_rank", F.col("full_rank") + F.col("full_before"))
    pieces = long_items.select("row", "n", F.col("full_rank"), F.posexplode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece", "at"))
    filled = pieces.select("row", F.col("piece"), (F.col("at") * top).alias("piece_start"), F.lit(top).cast("long").alias("piece_length"), (F.col("full_rank") + F.col("at") + plan.bins).alias("bin"), F.lit(top).alias("bin_capacity"), F.lit(0).alias("bin_place"))
    empty = placed.where("n = 0").select("row", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("piece_start"), F.lit(0).cast("long").alias("piece_length"), *(F.lit(None).cast(t).alias(c) for c, t in (("bin", "long"), ("bin_capacity", "int"), ("bin_place", "int"))))
    ranked = placed.where("rest > 0").withColumn("rank", F.row_number().over(by_length) - 1).join(offsets.select(F.col("rest").alias("r"), F.col("shard").alias("s"), "before"), (F.col("rest") == F.col("r")) & (F.col("shard") == F.col("s"))).select("row", "n", "rest", (F.col("rank") + F.col("before")).alias("rank"))
    schema = T.StructType([measured.schema["row"], *RESULT])
    arrow = to_arrow_schema(schema)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, runs, _ = model.value
        key = steps[:, 0] << 40 | steps[:, 1]
        for b in batches:
            n, rest, rank = (b.column(c).to_numpy() for c in ("n", "rest", "rank"))
            s = steps[np.searchsorted(key, rest << 40 | rank, side="right") - 1]
            at = rank - s[:, 1]
            bins = s[:, 3] + at // s[:, 4]
            run = runs[np.searchsorted(runs[:, 0], bins, side="right") - 1]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array((n // top).astype(np.int32)), pa.array(n - rest), pa.array(rest), pa.array(bins), pa.array(run[:, 2].astype(np.int32)), pa.array((s[:, 5] + at % s[:, 4] * rest).astype(np.int32))], schema=arrow)

    out = ranked.mapInArrow(lean(assign), schema).unionByName(filled).unionByName(empty)
    return out.select(*(F.col(f"row.`{c}`") for c in own), *(f.name for f in RESULT))


def place(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, sequence_cost: int = SEQUENCE_COST) -> tuple[np.ndarray, ...]:
    """item, start, length, bin, capacity and place of every piece of items of these lengths, by bin and place; equal lengths in order."""
    top = max(capacities)
    rest, full = lengths % top, lengths // top
    some = np.flatnonzero(rest)
    by_length = some[np.argsort(rest[some], kind="stable")]
    sizes, first, counts = np.unique(rest[by_length], return_index=True, return_counts=True)
    plan = Plan(dict(zip(sizes.tolist(), counts.tolist(), strict=True)), capacities, sequence_cost)
    n = rest[by_length]
    rank = np.arange(len(n)) - np.repeat(first, counts)
    steps, runs = np.array(sorted(plan.steps) or [(0,) * 6], np.int64), np.array(plan.runs or [(0,) * 4], np.int64)
    s = steps[np.searchsorted(steps[:, 0] << 40 | steps[:, 1], n << 40 | rank, side="right") - 1]
    at = rank - s[:, 1]
    bins = s[:, 3] + at // np.maximum(s[:, 4], 1)
    capacity = runs[np.searchsorted(runs[:, 0], bins, side="right") - 1][:, 2]
    place = s[:, 5] + at % np.maximum(s[:, 4], 1) * n
    long_items = np.repeat(np.arange(len(lengths)), full)
    own = np.arange(len(long_items)) - np.repeat(np.cumsum(full) - full, full)
    whole = np.full(len(long_items), top)
    columns = [(by_length, long_items), (lengths[by_length] - n, own * top), (n, whole), (bins, plan.bins + np.arange(len(long_items))), (capacity, whole), (place, np.zeros(len(long_items), np.int64))]
    out = [np.concatenate(c).astype(np.int64) for c in columns]
    order = np.lexsort((out[5], out[3]))
    return tuple(c[order] for c in out)


_encodings: dict[str, object] = {}


def encoding(path: str):
    """The worker's encoder of a file of ranks; strings of special tokens are ordinary text to it."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _sharded(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """doc_id, text, h and shard of every row."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("doc_id", "text"))
    sizes = texts.groupBy("h").agg(F.sum(F.octet_length("text").cast("long") + 64).alias("bytes"))
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    shards = -(-total // shard_bytes) or 1
    hot = sizes.where(F.col("bytes") > shard_bytes).select(F.col("h").alias("hot"), F.ceil(F.col("bytes") / shard_bytes).alias("over"))  # total / shard_bytes rows at most
    salted = texts.join(hot, F.col("h") == F.col("hot"), "left").withColumn("salt", F.when(F.col("over").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("over"))).otherwise(F.lit(0)))
    return salted.select("doc_id", "text", "h", F.pmod(F.xxhash64("h", "salt"), F.lit(shards)).alias("shard"))


SEQUENCE = [T.StructField("bin", T.LongType()), T.StructField("bin_capacity", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.ArrayType(T.IntegerType()))]


def sequences(docs: DataFrame, tokenizer_path: str, capacities: tuple[int, ...] = CAPACITIES, sequence_cost: int = SEQUENCE_COST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per sequence: bin, bin_capacity, n_tokens, and its pieces in order: doc_ids, starts (in the document's tokens), lengths; tokens is the content.

    A document without tokens gets a row of its own, without bin and capacity. `tokenizer_path` is
    read on the executors; nothing is put between the pieces.
    """
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    dealt = _sharded(docs, shard_bytes)
    counted = T.StructType([dealt.schema[c] for c in ("shard", "h", "doc_id")] + [T.StructField("ids", T.BinaryType())])
    arrow = to_arrow_schema(counted)
    width = "<u2" if encoding(tokenizer_path).n_vocab <= 1 << 16 else "<u4"  # what moves is the tokens

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer_path).encode_ordinary
        for b in batches:
            ids = [np.array(encode(x), width).tobytes() for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("shard", "h", "doc_id")), pa.array(ids, pa.binary())], schema=arrow)

    schema = T.StructType([T.StructField(f.name, T.ArrayType(id_type)) if f.name == "doc_ids" else f for f in SEQUENCE])
    out = to_arrow_schema(schema)

    def pack(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("h", "ascending"), ("ids", "ascending")]))
        shard = table.column("shard")[0].as_py()
        ids = [np.frombuffer(x, width) for x in table.column("ids").to_pylist()]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        item, start, length, bins, capacity, _ = place(lengths, capacities, sequence_cost)
        empty = np.flatnonzero(lengths == 0)
        firsts = np.flatnonzero(np.diff(bins, prepend=-1))
        ends = np.concatenate([firsts[1:], [len(bins)]]).astype(np.int64) if len(bins) else np.zeros(0, np.int64)
        tokens = np.concatenate([ids[i][s : s + n] for i, s, n in zip(item.tolist(), start.tolist(), length.tolist(), strict=True)] or [np.zeros(0, width)]).astype(np.int32)
        token_ends = np.cumsum(length)[ends - 1] if len(bins) else ends
        members = pa.array(np.concatenate([item, empty]))
        pieces_at = np.concatenate([[0], ends, len(bins) + 1 + np.arange(len(empty))]).astype(np.int32)
        tokens_at = np.concatenate([[0], token_ends, np.full(len(empty), len(tokens))]).astype(np.int32)
        lists = lambda at, values, f: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values.cast(f.type.value_type)).cast(f.type)
        zeros = np.zeros(len(empty), np.int64)
        none = pa.nulls(len(empty), pa.int64())
        columns = [
            pa.concat_arrays([pa.array(shard << 32 | bins[firsts]), none]),
            pa.concat_arrays([pa.array(capacity[firsts]), none]).cast(pa.int32()),
            pa.array(np.diff(tokens_at).astype(np.int32)),
            lists(pieces_at, table.column("doc_id").combine_chunks().take(members), out.field("doc_ids")),
            lists(pieces_at, pa.array(np.concatenate([start, zeros])), out.field("starts")),
            lists(pieces_at, pa.array(np.concatenate([length, zeros])), out.field("lengths")),
            lists(tokens_at, pa.array(tokens), out.field("tokens")),
        ]
        return pa.Table.from_arrays(columns, schema=out)

    return dealt.select("text", "shard", "h", "doc_id").mapInArrow(lean(tokenize), counted).groupBy("shard").applyInArrow(pack, schema)
