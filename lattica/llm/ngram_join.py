"""N-gram Jaccard self-join as a blocked sparse matrix product.

The incidence matrix has a row for each different set of word n-grams and a column for each n-gram;
the product of the matrix with its transpose holds all overlaps. Only entries that can reach the
threshold are computed:

- Documents with the same set are one row, named by a hash of the set.
- Columns are ordered by how common they are, counted over all documents in blocks of columns
  (n-grams of one hash bucket), rare blocks first. For Jaccard t a row of n columns needs an overlap
  of ceil(t n) at least with any partner, so of its n - ceil(t n) + 1 first columns it shares one with
  every partner. Only these enter the first product.
- The product runs over blocks of columns, and the overlap counts of pairs accumulate. With c of the first
  columns in common, the overlap is c + max(rest of either row) at most; a pair for which that is
  less than t / (1 + t) times both sizes, or whose sizes differ too much, is discarded.
- The rows of surviving pairs are multiplied in full, which gives the exact overlap.

Links are wanted as components, so pairs within a component needn't be multiplied. In a group of near
copies every row is in the same columns; before the product, rounds of stars join each row with one
other of its columns, so a column costs as many pairs as it has rows, until most of the group is one
component. The product then takes the pairs across components, and all of them: no link is lost.

Documents without words have no n-gram and no link; those of fewer words than n have their whole
sequence as one. Null is empty. Repeated rows are linked as copies. Extra columns aren't read by
`linked`; `one_of_each` returns them as they are.

A set's name has 64 bits, and 64 more tell whether two sets have one name; where they do, each set
gets a name from both, and names are compared anew until every one belongs to one set, so sets are
told apart by 128 bits. An n-gram is 64 bits: a pair of documents of a million n-grams each has one in
common by chance once in ten million pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from lattica.llm.common import forget, lean, raw, ship, written
from lattica.llm.components import components

#: Blocks of columns whose frequencies order the columns.
BLOCK_BITS = 20
#: Parts in which the frequencies of a task's blocks are summed, and rows of one part that are summed at once.
PARTS, SUMMED = 64, 1024
#: Rounds of stars, and columns of a row that a round after the first draws from.
STAR_ROUNDS, DRAWS = 4, 4
SPAN_ROUNDS = 3
#: Rows of a column that are multiplied by a join, and rows of a chunk where more are.
FEW, CHUNK = 12, 512
REMEMBERED = 400_000
#: Most names whose texts are picked out by a broadcast of their ids; more of them meet the documents in a shuffled join.
BROADCAST_NAMES = 1_000_000

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
_BASE = 0x5851F42D4C957F2D
_SPACE = np.isin(np.arange(256), [0x20, *range(9, 14)])
_BYTE = np.random.default_rng(1729).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes hashed at once; longer texts are taken in pieces that end between words.
_PIECE = 1 << 18
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_of(n: int) -> list[np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, _PIECE + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(data: bytes) -> np.ndarray:
    """A polynomial hash of each word, from sums over the whole text: words between ASCII white space, A-Z lower-cased."""
    data = data.lower()
    out, at = [], 0
    while at < len(data):
        end = len(data)
        if end - at > _PIECE:
            cut = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, _PIECE, at)])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:
                rest = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, -1, at)])
                end = at + int(rest[0]) + 1 if len(rest) else end
        a = np.frombuffer(data, np.uint8, end - at, at)
        edges = np.flatnonzero(np.diff(_SPACE[a], prepend=True, append=True))
        up, down = _powers_of(len(a) + 1)
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_BYTE[a] * up[: len(a)], out=sums[1:])
        starts = edges[0::2]
        h = (sums[edges[1::2]] - sums[starts]) * down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(_MULTIPLIERS[0])
        out.append(h ^ (h >> np.uint64(29)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def ngrams(data: bytes, size: int) -> np.ndarray:
    """Hashes of the distinct n-grams of a text, sorted."""
    h = word_hashes(data)
    if not len(h):
        return h
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(_MULTIPLIERS[k % 8])
        out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def set_name(grams: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """First name and mark of a set, as signed numbers."""
    h = xxhash.xxh3_128_intdigest(grams.tobytes())
    return _signed(h & ((1 << bits) - 1)), _signed(h >> 64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Names:
    """Names of sets: the first one, or where different sets share it, the first that they don't share."""

    def __init__(self, bits: int = 64) -> None:
        self.bits, self.shared = bits, set()

    def settled(self, name: int, mark: int) -> int:
        k, out = 0, name
        while out in self.shared:
            k += 1
            out = _signed((mark ^ (name << k)) & ((1 << self.bits) - 1))
        return out

    def of(self, grams: np.ndarray) -> int:
        return self.settled(*set_name(grams, self.bits))


def named_sets(found: DataFrame, names: Names) -> tuple[DataFrame, DataFrame]:
    """The documents (id, name, n) and the sets (name, id: the least of its documents) under names that no two sets share."""
    first = found.where("n is not null").select("id", "name", "mark", "n")
    while True:
        docs = first
        if names.shared:
            def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    new = [None if x is None else names.settled(x, m) for x, m in zip(b.column("name").to_pylist(), b.column("mark").to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(new, pa.int64()), b.column("mark"), b.column("n")], schema=b.schema)

            docs = first.mapInArrow(lean(settle), first.schema)
        sets = written(docs.where("n > 0").groupBy("name").agg(F.min("id").alias("id"), F.min("mark").alias("lo"), F.max("mark").alias("hi")), "sets")
        again = [r["name"] for r in sets.where("lo <> hi").select("name").toLocalIterator()]  # of 10^11 sets some hundreds
        if not again:
            return docs.select("id", "name", "n"), sets.select("name", "id")
        names.shared.update(again)
        forget(sets)


def described(docs: DataFrame, size: int, bits: int = 64) -> DataFrame:
    """id, first name, mark and n of each document, and rows without n that hold how many n-grams of the task's documents each block has: name is the part."""
    schema = StructType([StructField("id", docs.schema["id"].dataType), StructField("name", LongType()), StructField("mark", LongType()), StructField("n", IntegerType()), StructField("blocks", BinaryType())])
    arrow = to_arrow_schema(schema)
    mask = np.uint64((1 << BLOCK_BITS) - 1)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << BLOCK_BITS, np.int64)
        blocks: list[np.ndarray] = []
        for b in batches:
            names, marks, sizes = [], [], []
            for data in raw(b.column("text")):
                g = ngrams(data, size)
                name, mark = set_name(g, bits) if len(g) else (None, None)
                names.append(name)
                marks.append(mark)
                sizes.append(len(g))
                blocks.append((g & mask).astype(np.int64))
                if len(blocks) >= 500:
                    held += np.bincount(np.concatenate(blocks), minlength=len(held))
                    blocks = []
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(names, pa.int64()), pa.array(marks, pa.int64()), pa.array(sizes, pa.int32()), pa.nulls(len(sizes), arrow.field("blocks").type)], schema=arrow)
        if blocks:
            held += np.bincount(np.concatenate(blocks), minlength=len(held))
        if held.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(held, PARTS)]
            yield pa.RecordBatch.from_arrays([pa.nulls(PARTS, arrow.field("id").type), pa.array(range(PARTS), pa.int64()), pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.int32()), pa.array(parts, arrow.field("blocks").type)], schema=arrow)

    return docs.mapInArrow(lean(describe), schema)


def block_ranks(found: DataFrame) -> np.ndarray:
    """Each block's place when blocks are ordered by how many n-grams they have."""

    def total(t: pa.Table) -> pa.Table:
        held = np.zeros((1 << BLOCK_BITS) // PARTS, np.int64)
        for x in t.column("blocks"):
            held += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        return pa.table({"part": t.column("part").slice(0, 1), "salt": t.column("salt").slice(0, 1), "blocks": pa.array([zlib.compress(held.tobytes(), 1)], pa.binary())})

    sums = found.where("blocks is not null").select(F.col("name").cast("int").alias("part"), F.spark_partition_id().alias("salt"), "blocks")
    tasks = found.where("blocks is not null and name = 0").count()
    for salts in [n for n in (SUMMED * SUMMED, SUMMED) if n < tasks] + [1]:  # a group has as many rows as there are tasks to a salt
        sums = sums.withColumn("salt", F.pmod("salt", F.lit(salts))).groupBy("part", "salt").applyInArrow(total, "part int, salt int, blocks binary")
    counts = np.zeros((PARTS, (1 << BLOCK_BITS) // PARTS), np.int64)
    for r in sums.collect():  # PARTS rows
        counts[r["part"]] = np.frombuffer(zlib.decompress(r["blocks"]), np.int64)
    ranks = np.empty(counts.size, np.uint32)
    ranks[np.argsort(counts.ravel(), kind="stable")] = np.arange(counts.size, dtype=np.uint32)
    return ranks


def columns_of(grams: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Column numbers in the order of the product, one to one with the n-grams."""
    return (ranks[(grams & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(63 - BLOCK_BITS)) | (grams >> np.uint64(BLOCK_BITS + 1))


def least_overlap(n: int, percent: int) -> int:
    """Of a row of n columns with any partner."""
    return -(-percent * n // 100)


def first_columns(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / F.lit(100)) + 1


def postings(docs: DataFrame, size: int, percent: int, ranks, names: Names) -> DataFrame:
    """column, name, n: the first columns of every row; a task's copies give them once."""
    schema = StructType([StructField("column", LongType()), StructField("name", LongType()), StructField("n", IntegerType())])
    arrow = to_arrow_schema(schema)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, had = ranks.value, set()
        for b in batches:
            columns, own, sizes, held = [], [], [], 0
            for data in raw(b.column("text")):
                g = ngrams(data, size)
                if not len(g):
                    continue
                name = names.of(g)
                if name in had:
                    continue
                if len(had) >= REMEMBERED:
                    had.clear()
                had.add(name)
                p = len(g) - least_overlap(len(g), percent) + 1
                c = columns_of(g, order)
                columns.append(np.partition(c, p - 1)[:p].astype(np.int64))
                own.append(np.full(p, name, np.int64))
                sizes.append(np.full(p, len(g), np.int32))
                held += p
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (columns, own, sizes)], schema=arrow)
                    columns, own, sizes, held = [], [], [], 0
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (columns, own, sizes)], schema=arrow)

    return docs.select("text").mapInArrow(lean(post), schema)


def _verified(pairs: DataFrame, texts: _Texts, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full rows reach the threshold; other columns stay."""
    extra = [c for c in pairs.columns if c not in ("a", "b")]
    schema = StructType([pairs.schema[c] for c in ["a", "b", *extra]])
    names, held_texts = texts.names, texts.of(pairs)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, held = [], (None, None)
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), raw(batch.column("x")), raw(batch.column("y")), strict=True):
                if held[0] != y:
                    held = (y, ngrams(y, size))
                x, y = ngrams(x, size), held[1]
                both = np.concatenate([x, y])
                both.sort()
                n = int((both[1:] == both[:-1]).sum())
                hit.append(100 * n >= percent * (len(x) + len(y) - n) and names.of(x) == a and names.of(y) == b)  # rows of one id may have other texts
            hit = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(hit) for c in ["a", "b", *extra]], names=["a", "b", *extra])

    joined = pairs.join(held_texts.select(F.col("name").alias("a"), F.col("text").alias("x")), "a").join(held_texts.select(F.col("name").alias("b"), F.col("text").alias("y")), "b")
    return joined.select("a", "b", *extra, "x", "y").mapInArrow(lean(multiply), schema).distinct()


class _Texts:
    """Texts by name, picked out of the documents as pairs ask for them."""

    def __init__(self, docs: DataFrame, sets: DataFrame, names: Names) -> None:
        self.docs, self.sets, self.names, self.parts = docs, sets, names, []

    def of(self, pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
        for p in self.parts:
            wanted = wanted.join(p.select("name"), "name", "left_anti")
        wanted = written(wanted.join(self.sets.select("name", "id"), "name"), "wanted")
        n = wanted.count()
        if n:
            holders = F.broadcast(wanted) if n <= BROADCAST_NAMES else wanted
            self.parts.append(written(self.docs.join(holders, "id").select("name", "text"), "texts"))
        forget(wanted)
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out

    def forget(self) -> None:
        for p in self.parts:
            forget(p)


def _merged(named: DataFrame | None, links: DataFrame) -> DataFrame:
    """name, component after links between components (a, b)."""
    new = components(links)
    if named is None:
        return written(new.select(F.col("node").alias("name"), "component"), "components")
    joined = named.join(new.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("name", F.coalesce("to", "component").alias("component"))
    return written(joined.unionByName(new.join(named.select(F.col("component").alias("node")).distinct(), "node", "left_anti").select(F.col("node").alias("name"), "component")), "components")


def linked(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", star_rounds: int = STAR_ROUNDS, name_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links of Jaccard percent / 100 or more."""
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    found, names = written(described(base, size, name_bits), "described"), Names(name_bits)
    described_docs, sets = named_sets(found, names)
    ranks = spark.sparkContext.broadcast(block_ranks(found))  # 2 MB
    posted = written(postings(base, size, percent, ranks, names), "postings")
    shared = posted.groupBy("column").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).where("lo < hi").select("column")
    members = written(posted.join(shared, "column").groupBy("column", "name").agg(F.first("n").alias("n")), "members")
    forget(posted)
    sizes = members.groupBy("column").agg(F.count(F.lit(1)).alias("rows"))
    scores = members.join(sizes, "column").groupBy("name").agg(F.sum("rows").alias("score"))
    bare, members = members, written(members.join(scores, "name"), "members")
    forget(bare)
    texts = _Texts(base, sets, names)

    named = None
    for turn in range(star_rounds):
        placed = _placed(members, named)
        counted = _starred(placed, percent) if turn == 0 else _drawn(placed, members, turn, percent)
        chosen = counted.groupBy("name", "component").agg(F.max_by("centre", F.struct("share", "centre.name")).alias("centre"))
        pairs = written(chosen.select(F.col("name").alias("a"), F.col("centre.name").alias("b"), F.col("component").alias("ca"), F.col("centre.component").alias("cb")), "stars")
        tried = pairs.count()
        found_links = _links(pairs, tried, texts, size, percent)
        forget(pairs)
        if found_links is None:
            break
        merged = found_links.count()
        named = _merged(named, found_links)
        forget(found_links)
        if turn and merged * 20 < tried:  # most of what is left isn't linked; the product will tell
            break

    placed = _placed(members, named)
    crossing = placed.groupBy("column").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("column")
    placed = written(placed.join(crossing, "column"), "crossing")
    survive = written(_product(placed, percent), "pairs")
    named = _spanned(survive, named, texts, size, percent)
    for t in (members, placed, survive):
        forget(t)
    texts.forget()

    sets = sets.withColumnRenamed("id", "least")
    if named is not None:
        with_component = sets.join(named, "name", "left").select("name", "least", F.coalesce("component", "name").alias("component"))
        smallest = with_component.groupBy("component").agg(F.min("least").alias("component_id"))
        sets = with_component.join(smallest, "component").select("name", "component_id")
    else:
        sets = sets.select("name", F.col("least").alias("component_id"))
    return described_docs.join(sets, "name", "left").select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _near(n: Column, m: Column, percent: int) -> Column:
    """Sizes that allow the threshold."""
    return F.least(n, m).cast("long") * 100 >= F.greatest(n, m).cast("long") * percent


def _possible(n: Column, m: Column, c: Column, percent: int) -> Column:
    """Sizes of which c common first columns, and all later columns in common, would reach the threshold."""
    rest = F.greatest(n - first_columns(n, percent), m - first_columns(m, percent))
    return _near(n, m, percent) & ((c + rest) * (100 + percent) >= percent * (n.cast("long") + m))


def _placed(members: DataFrame, named: DataFrame | None) -> DataFrame:
    if named is None:
        return members.withColumn("component", F.col("name"))
    return members.join(named, "name", "left").withColumn("component", F.coalesce("component", "name"))


def _crossed(placed: DataFrame, order: Column) -> DataFrame:
    """Rows with a centre of each of their columns that components share: the row that comes last in the order."""
    lists = placed.groupBy("column").agg(F.max_by(F.struct("name", "n", "component"), order).alias("centre"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("column", "centre")
    return placed.join(lists, "column")


def _starred(placed: DataFrame, percent: int) -> DataFrame:
    """name, component, centre, share: possible partners that are their columns' most central rows, as an unedited original is: those that have most columns in common with most rows."""
    stars = _crossed(placed, F.struct("score", "name")).where(F.col("component") != F.col("centre.component"))
    counted = stars.groupBy("name", "component", "n", "centre").agg(F.count(F.lit(1)).alias("c"))
    return counted.where(_possible(F.col("n"), F.col("centre.n"), F.col("c"), percent)).withColumn("share", F.col("c") / (F.col("n") + F.col("centre.n")))


def _drawn(placed: DataFrame, members: DataFrame, turn: int, percent: int) -> DataFrame:
    """The same for partners drawn from DRAWS of each row's columns, with all columns in common counted."""
    drawn = _crossed(placed, F.xxhash64("name", "column", F.lit(turn))).withColumn("draw", F.row_number().over(Window.partitionBy("name").orderBy(F.xxhash64("column", F.lit(turn)), "column")))
    pairs = drawn.where((F.col("draw") <= DRAWS) & (F.col("component") != F.col("centre.component")) & _near(F.col("n"), F.col("centre.n"), percent)).select("name", "component", "n", "centre").distinct()
    own = members.select("name", "column")
    both = pairs.withColumn("other", F.col("centre.name")).join(own, "name").join(own.withColumnRenamed("name", "other"), ["other", "column"])
    counted = both.groupBy("name", "component", "n", "centre").agg(F.count(F.lit(1)).alias("c"))
    return counted.where(_possible(F.col("n"), F.col("centre.n"), F.col("c"), percent)).withColumn("share", F.col("c") / (F.col("n") + F.col("centre.n")))


def _product(placed: DataFrame, percent: int) -> DataFrame:
    """a, b, ca, cb, share: the pairs of rows in different components that their overlap counts leave possible.

    Columns of few rows are multiplied by a join. Columns of many rows are multiplied in blocks: those
    with the same central row, as the columns of a group of near copies have, make a block, whose rows
    are cut into chunks; a task takes two chunks, accumulates the counts of all the block's columns,
    and discards the pairs that couldn't be possible if all other columns agreed. So a large group
    costs few rows, whatever its number of columns. Counts of a pair in several blocks are added.
    """
    sizes = placed.groupBy("column").agg(F.count(F.lit(1)).alias("of"), F.max_by("name", F.struct("score", "name")).alias("block"))
    sized = placed.join(sizes, "column").drop("score")
    few, many = sized.where(F.col("of") <= FEW), sized.where(F.col("of") > FEW)
    left, right = few.select("column", F.col("name").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca")), few.select("column", F.col("name").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    joined = left.join(right, "column").where("ca < cb").where(_near(F.col("na"), F.col("nb"), percent))
    by_join = joined.groupBy("a", "b", "na", "nb", "ca", "cb").agg(F.count(F.lit(1)).alias("c"))

    held = many.groupBy("block", "name").agg(F.count(F.lit(1)).alias("inside"))
    all_of = sized.groupBy("name").agg(F.count(F.lit(1)).alias("all"))
    chunks = held.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    rows = many.join(held, ["block", "name"]).join(all_of, "name").join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("name"), F.col("chunks")))
    paired = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select("block", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "name", "n", "component", "column", (F.col("all") - F.col("inside")).alias("outside"))
    dealt = paired.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "column", "name")
    in_blocks = dealt.mapInArrow(lean(_multiplied(percent)), "a long, b long, na int, nb int, ca long, cb long, c long")
    counted = by_join.unionByName(in_blocks).groupBy("a", "b", "na", "nb", "ca", "cb").agg(F.sum("c").alias("c"))
    return counted.where(_possible(F.col("na"), F.col("nb"), F.col("c"), percent)).select("a", "b", "ca", "cb", (F.col("c") / (F.col("na") + F.col("nb"))).alias("share"))


class _Block:
    """Overlap counts of the rows of two chunks of a block, added up column by column."""

    def __init__(self, i: int, j: int) -> None:
        self.same = i == j
        self.i = i
        self.places: tuple[dict[int, int], ...] = ({}, {})
        self.rows: tuple[list[tuple], ...] = ([], [])
        self.counts = np.zeros((64, 64), np.int32)

    def add(self, t: dict[str, np.ndarray]) -> None:
        """Rows of whole columns, sorted by column."""
        names, first, at = np.unique(t["name"], return_index=True, return_inverse=True)
        sides = np.zeros(len(names), np.int8) if self.same else (t["chunk"][first] != self.i).astype(np.int8)
        place = np.empty(len(names), np.int64)
        for k, (name, f, side) in enumerate(zip(names.tolist(), first.tolist(), sides.tolist(), strict=True)):
            own = self.places[side]
            if name not in own:
                own[name] = len(own)
                self.rows[side].append(tuple(int(t[c][f]) for c in ("name", "n", "component", "outside")))
            place[k] = own[name]
        most = max(map(len, self.rows))
        if most > len(self.counts):
            bigger = np.zeros((max(most, 2 * len(self.counts)),) * 2, np.int32)
            bigger[: len(self.counts), : len(self.counts)] = self.counts
            self.counts = bigger
        place, side = place[at], sides[at]
        cuts = np.flatnonzero(np.diff(t["column"], prepend=t["column"][0] - 1))
        for lo, hi in zip(cuts, [*cuts[1:], len(at)], strict=True):
            if self.same:
                self.counts[np.ix_(place[lo:hi], place[lo:hi])] += 1
            else:
                of = side[lo:hi] == 0
                self.counts[np.ix_(place[lo:hi][of], place[lo:hi][~of])] += 1

    def pairs(self, percent: int) -> pa.RecordBatch:
        """The pairs that could be possible if all columns outside the block agreed."""
        left = np.array(self.rows[0], np.int64).reshape(-1, 4)
        right = left if self.same else np.array(self.rows[1], np.int64).reshape(-1, 4)
        x, y = np.nonzero(self.counts[: len(left), : len(right)])
        c = self.counts[x, y].astype(np.int64)
        a, b = left[x], right[y]
        if not self.same:
            swap = (a[:, 2] > b[:, 2])[:, None]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
        n, m = a[:, 1], b[:, 1]
        rest = np.maximum(-(-percent * n // 100) - 1, -(-percent * m // 100) - 1)
        most = c + np.minimum(a[:, 3], b[:, 3]) + rest
        keep = (a[:, 2] < b[:, 2]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (most * (100 + percent) >= percent * (n + m))
        a, b, c = a[keep], b[keep], c[keep]
        return pa.RecordBatch.from_pydict({"a": a[:, 0], "b": b[:, 0], "na": a[:, 1].astype(np.int32), "nb": b[:, 1].astype(np.int32), "ca": a[:, 2], "cb": b[:, 2], "c": c})


def _multiplied(percent: int):
    """Pairs and their counts from rows sorted by block, its two chunks, and column; a column's rows and one block's counts are held."""
    fields = ("block", "i", "j", "chunk", "name", "n", "component", "column", "outside")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, open_rows = None, None, None
        for batch in _and_none(batches):
            if batch is None:
                t = open_rows
            else:
                t = {f: batch.column(f).to_numpy(zero_copy_only=False) for f in fields}
                if open_rows is not None:
                    t = {f: np.concatenate([open_rows[f], t[f]]) for f in fields}
            if t is None or not len(t["block"]):
                continue
            moved = np.flatnonzero(np.any([t[f][1:] != t[f][:-1] for f in ("block", "i", "j")], axis=0)) + 1
            end = len(t["block"])
            if batch is not None:  # the last column may go on in the next batch
                other = np.flatnonzero(t["column"] != t["column"][-1])
                end = max([0, *(other[-1:] + 1).tolist(), *moved[-1:].tolist()])
                open_rows = {f: v[end:] for f, v in t.items()}
            cuts = [0, *moved[moved < end].tolist(), end]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                own = tuple(int(t[f][lo]) for f in ("block", "i", "j"))
                if own != key:
                    if block is not None:
                        yield block.pairs(percent)
                    key, block = own, _Block(*own[1:])
                block.add({f: v[lo:hi] for f, v in t.items()})
        if block is not None:
            yield block.pairs(percent)

    return multiply


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _spanned(pairs: DataFrame, named: DataFrame | None, texts: _Texts, size: int, percent: int) -> DataFrame | None:
    """Components after all links among the pairs (a, b, ca, cb, share).

    First each component's most promising pair is multiplied, again and again while that leaves many
    fewer: pairs that come to lie within a component needn't be. Then all that are left are, at once
    where few of the promising ones are links.
    """
    open_pairs, own, poor = pairs, None, False
    for turn in range(SPAN_ROUNDS + 1):
        best, tried = None, 0
        if not poor and turn < SPAN_ROUNDS:
            sides = open_pairs.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), "a", "b", "ca", "cb", "share"), F.struct(F.col("cb").alias("c"), "a", "b", "ca", "cb", "share"))).alias("s")).select("s.*")
            best = written(sides.groupBy("c").agg(F.max_by(F.struct("a", "b", "ca", "cb"), F.struct("share", "a", "b")).alias("p")).select("p.*").distinct(), "best")
            tried = best.count()
        n_open = open_pairs.count()
        all_at_once = best is None or n_open <= 4 * tried
        links = _links(open_pairs.select("a", "b", "ca", "cb"), n_open, texts, size, percent) if all_at_once else _links(best, tried, texts, size, percent)
        poor = links is None or links.count() * 10 < tried
        if links is not None:
            named = _merged(named, links)
            forget(links)
        if all_at_once:
            forget(best)
            break
        rest = open_pairs.join(best.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "share")
        if named is None:
            rest = rest.withColumn("ca", F.col("a")).withColumn("cb", F.col("b"))
        else:
            side = lambda c: named.select(F.col("name").alias(c), F.col("component").alias(f"c{c}"))
            rest = rest.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b"))
        new = written(rest.where("ca <> cb").select("a", "b", "ca", "cb", "share"), "open")
        forget(best)
        forget(own)
        open_pairs = own = new
        if new.isEmpty():
            break
    forget(own)
    return named


def _links(pairs: DataFrame, n_pairs: int, texts: _Texts, size: int, percent: int) -> DataFrame | None:
    """Links between components (a, b) of so many pairs, if there are any."""
    if not n_pairs:
        return None
    links = written(_verified(pairs, texts, size, percent).select(F.col("ca").alias("a"), F.col("cb").alias("b")), "links", n_pairs)
    if links.limit(1).count():
        return links
    forget(links)
    return None


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that a smaller doc_id is linked to, directly or not.

    Repeated rows of a kept id stay once for each text. Rows without an id have no place in a group
    and stay as they are.
    """
    named = docs.where(docs[doc_id].isNotNull())
    keep = linked(named, size, percent, doc_id, text).where("doc_id = component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    kept = named.join(keep, doc_id, "left_semi").dropDuplicates([doc_id, text])  # dealt by the join already
    return kept.unionByName(docs.where(docs[doc_id].isNull()))


def report(docs: DataFrame) -> DataFrame:
    return linked(docs, size=4, percent=85)
