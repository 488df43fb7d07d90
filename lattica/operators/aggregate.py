"""Aggregations and rankings over a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.operators.build import number_rows
from lattica.storage import cut, release

#: Numbers of targets in one block: two to this power.
BLOCK_BITS = 16
#: Items of a feature in one array, about, and rows whose pairs one task sums.
PAIR_BLOCK, ROWS_A_TASK = 4_096, 100_000


def users_by_target(edges: DataFrame, kinds: list[str], limit: int | None = None) -> DataFrame:
    """dst, users: distinct sources by target, most used first; ties by id. A top-k report with `limit`."""
    out = edges.where(F.col("kind").isin(kinds)).groupBy("dst").agg(F.count_distinct("src").alias("users"))
    return out.orderBy(F.desc("users"), "dst").limit(limit) if limit else out


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, key, n: nodes by kind; edges by kind and by confidence; entries by kind; gated edges. One pass over each table."""

    def count(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
        grouped = rows.groupBy(*(key.cast("string").alias(what) for what, key in keys.items())).agg(F.count(F.lit(1)).alias("n"))  # few combinations, summed before they move
        each = F.explode(F.array(*(F.struct(F.lit(what).alias("what"), F.col(f"`{what}`").alias("key")) for what in keys))).alias("k")
        return grouped.select(each, "n").groupBy("k.what", "k.key").agg(F.sum("n").alias("n")).where("key is not null")

    of_nodes = count(nodes, {"node kind": F.col("kind"), "entry kind": F.col("entry_kind")})
    return of_nodes.unionByName(count(edges, {"edge kind": F.col("kind"), "confidence": F.col("confidence"), "gated": F.col("gate").isNotNull()})).select("what", "key", "n")


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, n_in, n_out of every node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    sums = ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def co_callers(edges: DataFrame, target: DataFrame, kinds: list[str], limit: int = 40) -> DataFrame:
    """id, shared, containment: sources that share targets with `target` (id), by how much of its own targets; a top-k report."""
    used = edges.where(F.col("kind").isin(kinds)).select("src", "dst")
    own = used.join(target.select(F.col("id").alias("src")), "src", "left_semi").select("dst").distinct()
    total = own.agg(F.count(F.lit(1)).alias("total"))
    shared = used.join(own, "dst", "left_semi").distinct().join(target.select(F.col("id").alias("src")), "src", "left_anti").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("shared"))
    out = shared.join(F.broadcast(total)).select("id", "shared", F.round(F.col("shared") / F.col("total"), 2).alias("containment"))  # one row
    return out.orderBy(F.desc("shared"), "id").limit(limit)


def distinct_beyond(calls: DataFrame, uses: DataFrame) -> DataFrame:
    """id, n: distinct targets (to) that each id's functions (id, fn; distinct) use (fn, to; distinct); ids that reach none are left out.

    Targets get numbers, and a function's numbers travel as an array, not as a row for each; an array holds the
    numbers of one block, so that none grows with the graph.
    """
    numbered = number_rows(uses.select("to").distinct(), ["to"], "n").select("to", F.col("n").cast("int").alias("n"), F.shiftright("n", BLOCK_BITS).cast("int").alias("block"))
    sets = uses.join(numbered, "to").groupBy("fn", "block").agg(F.collect_list("n").alias("ns"))
    met = calls.join(sets, "fn").select("id", "block", "ns").repartition("id")
    counted = met.groupBy("id", "block").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ns")))).alias("n"))
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


def shared_pairs(left: DataFrame, right: DataFrame, weight: Column, tasks: int, same: bool = False) -> DataFrame:
    """a, b, sum: pairs of items (item, feature; distinct) with a feature in common and the sum of the features' weights; of one side (`same`) each pair once, a before b.

    `weight` is an expression over the right side's columns. A feature's items travel as arrays of PAIR_BLOCK at most to the task of
    `a`, where pairs are made and summed: no row of a pair moves.
    """
    block = F.pmod(F.hash("item"), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("feature")) / PAIR_BLOCK))
    sets = right.select("feature", "item", weight.alias("w"), block.alias("block")).groupBy("feature", "block").agg(F.first("w").alias("w"), F.collect_list("item").alias("bs"))
    met = left.select(F.col("item").alias("a"), "feature").join(sets, "feature")
    met = met.select("a", "w", F.expr("filter(bs, b -> b > a)").alias("bs") if same else "bs").where(F.size("bs") > 0)
    return met.repartition(tasks, "a").select("a", "w", F.explode("bs").alias("b")).groupBy("a", "b").agg(F.sum("w").alias("sum"))


def first_per_pair(rows: DataFrame, pair: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*pair).orderBy(*order))).where("_n = 1").drop("_n")


def label_counts(rows: DataFrame, label: Column) -> DataFrame:
    """Rows with the number of rows of the same label: whether a label needs a suffix."""
    return rows.withColumn("label", label).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("label")))


def signature_groups(rows: DataFrame, item: str, order: str, part: Column) -> DataFrame:
    """signature, n, sample, letter rank: items grouped by the sequence of their parts; the largest group is A."""
    signed = rows.groupBy(item).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), part.alias("p")))), lambda x: x["p"]), ">").alias("signature"))
    groups = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("sample"))
    return groups


def bins(value: Column, edges_: list[int]) -> Column:
    """First bucket whose edge the value doesn't exceed."""
    out = F.when(F.lit(False), F.lit(""))
    for e in edges_:
        out = out.when(value <= e, f"<={e}")
    return out.otherwise(f">{edges_[-1]}")


def mutual_best(scores: DataFrame, a: str = "a", b: str = "b", margin: float = 0.8) -> DataFrame:
    """Pairs that are each other's best score, and whose runner-up on either side is under margin times it."""
    for side, other in ((a, b), (b, a)):
        order = Window.partitionBy(side).orderBy(F.desc("score"), other)
        scores = scores.withColumn(f"_n{side}", F.row_number().over(order)).withColumn(f"_r{side}", F.lead("score").over(order))
    clear = lambda side: F.coalesce(F.col(f"_r{side}") < F.col("score") * margin, F.lit(True))
    return scores.where((F.col(f"_n{a}") == 1) & (F.col(f"_n{b}") == 1) & clear(a) & clear(b)).select(a, b, "score")


def idf_cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, score: cosine of items' distinct features, weighted by how rare a feature is on both sides together.

    `left` and `right` have item, feature. Features shared by more than half of all items say nothing and weigh 0.
    """
    tasks = (left.count() + right.count()) // ROWS_A_TASK + 1
    sides = cut(left.select(F.lit(0).alias("side"), "item", "feature").unionByName(right.select(F.lit(1).alias("side"), "item", "feature")).repartition(tasks, "feature").distinct(), "features")  # rows move first: nearly all differ
    n = sides.select("side", "item").distinct().count()
    df = F.count(F.lit(1)).over(Window.partitionBy("feature"))
    weighed = cut(sides.withColumn("w", F.greatest(F.log(F.lit(float(n)) / (2.0 * df)), F.lit(0.0))).where("w > 0 and feature is not null"), "features")
    release(sides)
    norms = weighed.groupBy("side", "item").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    norm = lambda side, name: norms.where(F.col("side") == side).select(F.col("item").alias(name), F.col("norm").alias(f"n{name}"))
    pairs = shared_pairs(weighed.where("side = 0"), weighed.where("side = 1"), F.col("w") * F.col("w"), tasks)
    return pairs.join(norm(0, "a"), "a").join(norm(1, "b"), "b").select("a", "b", (F.col("sum") / (F.col("na") * F.col("nb"))).alias("score"))
