"""Building a graph: node merge, edge dedup with ids, moving and retyping edges, union of graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.storage import cut

EDGE_KEY = ["src", "dst", "kind", "file", "line", "gate"]


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge per key, of the best confidence; an element doesn't call itself. Sums before it shuffles."""
    best = edges.where(~((F.col("kind") == "CALLS") & (F.col("src") == F.col("dst")))).groupBy(*EDGE_KEY).agg(F.max("conf_rank").alias("conf_rank"), *(F.max_by(c, F.struct("conf_rank", c)).alias(c) for c in edges.columns if c not in {*EDGE_KEY, "conf_rank", "confidence", "id"}))
    return best.withColumn("confidence", F.when(F.col("conf_rank") == 3, "exact").when(F.col("conf_rank") == 2, "resolved").otherwise("heuristic"))


def with_edge_ids(edges: DataFrame) -> DataFrame:
    """Dense ids in key order: the same at any number of partitions."""
    return number_rows(dedup_edges(edges), EDGE_KEY, "id")


def number_rows(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Numbers from 1 in the order of the columns, whose values are distinct.

    Rows are range-partitioned, sorted and numbered within their partition, written once (a second
    run could draw other ranges), and moved on by the rows of the partitions before, so no single
    task sees all rows.
    """
    order = [F.col(c).asc_nulls_first() for c in by]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = cut(placed, "numbered").withColumn("_part", F.shiftright("_place", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per partition
    local = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, local + F.col("_before") + 1).drop("_part", "_place", "_before")


def merge_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """One node per id: for each scalar the first writer that has one wins, attributes of later writers win."""
    scalars = [c for c in nodes.columns if c not in ("id", "attrs", order)]
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(order))).alias(c) for c in scalars]
    attrs = F.to_json(F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct(order, "attrs"))), lambda x: F.coalesce(F.from_json(x["attrs"], "map<string,string>"), F.create_map().cast("map<string,string>"))), F.create_map().cast("map<string,string>"), lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, _: ~F.map_contains_key(m, k)), m)))
    return nodes.groupBy("id").agg(*firsts, attrs.alias("attrs"))


def retype_edges(edges: DataFrame, when: Column, kind: Column) -> DataFrame:
    """Edges that fit get another kind; two that become alike are one."""
    return dedup_edges(edges.withColumn("kind", F.when(when, kind).otherwise(F.col("kind"))))


def placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A node for each end of an edge that has none; its kind is what stands before the first colon."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti").select("id", F.substring_index("id", ":", 1).alias("kind"), F.expr("substr(id, instr(id, ':') + 1)").alias("name"))


def union_graphs(graphs: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of several graphs; an id that more than one graph has gets its graph's name before it, in every graph but the first."""
    nodes = edges = None
    for rank, (name, (n, e)) in enumerate(graphs.items()):
        n, e = n.withColumn("repo", F.lit(name)).withColumn("_rank", F.lit(rank)), e.withColumn("repo", F.lit(name)).withColumn("_rank", F.lit(rank))
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    shared = nodes.groupBy("id").agg(F.count_distinct("repo").alias("n"), F.min("_rank").alias("first")).where("n > 1").select(F.col("id").alias("shared_id"), "first")

    def renamed(df: DataFrame, column: str) -> DataFrame:
        joined = df.join(shared, F.col(column) == F.col("shared_id"), "left")
        return joined.withColumn(column, F.when(F.col("shared_id").isNotNull() & (F.col("_rank") != F.col("first")), F.concat(F.col("repo"), F.lit(":"), F.col(column))).otherwise(F.col(column))).drop("shared_id", "first")

    return renamed(nodes, "id").drop("_rank"), renamed(renamed(edges, "src"), "dst").drop("_rank")
