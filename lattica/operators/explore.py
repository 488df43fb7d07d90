"""One answer to a question in words: the best symbols, who enters through them, how they hang together, what they touch, and sources within a budget.

Words are stemmed and weighed against a node's own name, its id and its kind; nodes that no word names fall away before anything is sorted. The
few best (a short answer is the feature) then walk together, each as a group of one closure upwards and one downwards, over
all edges. A symbol's path leads from its nearest entry point; symbols are joined by shortest paths between them. What the
answer says comes first in the budget, sources fill the rest in order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.model import CALL_LIKE
from lattica.operators import traverse as G
from lattica.operators.reports import budgeted
from lattica.storage import cut

# Words that say nothing of a symbol, kinds that are never the answer, weights of kinds, and of words in a name and in a path.
STOP = "how does do did what where when why which who the a an to of in on for from with and or is are be it this that work works working happen happens code function method".split()
EXCLUDED = ["module", "file", "field", "column", "constant"]
WEIGHTS = {"method": 3, "function": 3, "route": 3, "class": 2, "page": 2, "component": 2, "table": 2}
IN_NAME, IN_PATH, LEAST = 10, 4, 10
ENDINGS = ("ing", "ed", "es", "s")
DATA_KINDS = ["table", "column", "connection", "config", "env"]
WRITES, READS = ["WRITES_TABLE", "WRITES_COLUMN"], ["READS_TABLE", "READS_COLUMN"]


def stems(question: str) -> list[str]:
    """Stems of a question's words, each once, without those that say nothing."""
    out = []
    for word in re.findall(r"[a-z_][a-z0-9_]*", question.lower()):
        if word in STOP:
            continue
        for end in ENDINGS:
            if word.endswith(end) and len(word) - len(end) >= 3:
                word = word[: -len(end)]
                break
        if word not in out:
            out.append(word)
    return out


def ranked(nodes: DataFrame, words: list[str], most: int = 4) -> DataFrame:
    """id, kind, score, place: the best symbols; ties by the shorter id, then the id."""
    if not words:
        return nodes.where(F.lit(False)).select("id", "kind", F.lit(0).alias("score"), F.lit(0).alias("place"))
    name, ident = F.lower(F.coalesce("name", F.lit(""))), F.lower("id")
    total: Column = F.lit(0)
    for w in words:
        total = total + F.when(name.contains(w), IN_NAME).when(ident.contains(w), IN_PATH).otherwise(0)
    weight = F.coalesce(F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))[F.col("kind")], F.lit(0))
    test = F.coalesce(F.col("entry_kind") == "test", F.lit(False)) | F.coalesce(F.col("file").rlike(r"(?:^|/)(?:tests?|__tests__|spec)/|(?:^|/)test_[^/]*\.py$|_tests?\.py$|(?:^|/)conftest\.py$|\.(?:test|spec)\.[cm]?[jt]sx?$"), F.lit(False))
    scored = nodes.where(~F.col("kind").isin(EXCLUDED) & ~test).withColumn("score", total + weight).where(F.col("score") >= LEAST)
    best = scored.select("id", "kind", "score").orderBy(F.desc("score"), F.length("id"), "id").limit(most)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), F.length("id"), "id")))  # at most `most` rows


def explore(nodes: DataFrame, edges: DataFrame, question: str, budget: int = 3000, most: int = 4, entries: int = 6) -> DataFrame:
    """symbol, section, place, item, n, path: the answer's rows, of at most `most` symbols.

    symbol: its kind and score; callers and entries: how many; entry: the first `entries` entry points by kind and name; writes and reads: tables below;
    path: the shortest way from the nearest entry; between: shortest ways from one symbol to another; source: lines of the symbols that fit the budget.
    """
    best = cut(ranked(nodes, stems(question), most), "explored")
    calls, every = G.walkable(edges, CALL_LIKE), G.walkable(edges)
    walked = best.where(~F.col("kind").isin(DATA_KINDS))
    groups = walked.select("id", F.col("id").alias("grp"))
    up = cut(G.group_closures(calls, groups), "explored-up")
    entered = up.join(nodes.select("id", "entry_kind", "name"), "id").where("depth > 0")
    owners = walked.where("kind <> 'route'").select(F.col("id").alias("grp"))
    of_functions = entered.join(owners, "grp", "left_semi")
    known = F.col("entry_kind").isNotNull()
    counts = owners.join(of_functions.groupBy("grp").agg(F.count_if(~known).alias("callers"), F.count_if(known).alias("entries")), "grp", "left").na.fill(0, ["callers", "entries"])
    first = of_functions.where(known).withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy("entry_kind", "name", "id"))).where(F.col("place") <= entries)
    down = cut(G.group_closures(every.where(~F.col("kind").isin(WRITES + READS)), groups, reverse=False), "explored-down")
    held = down.groupBy("id").agg(F.array_sort(F.collect_set("grp")).alias("grps"))  # at most `most` of them
    touched = held.join(edges.where(F.col("kind").isin(WRITES + READS)).select(F.col("src").alias("id"), F.col("dst").alias("item"), "kind"), "id").select("grps", "item", F.when(F.col("kind").isin(WRITES), "writes").otherwise("reads").alias("section")).distinct().select(F.explode("grps").alias("grp"), "item", "section").distinct()
    nearest = of_functions.where(known).groupBy("grp").agg(F.min(F.struct("depth", "id"))["id"].alias("id"))
    between = up.join(walked.select("id"), "id", "left_semi").where("id <> grp").select("id", "grp")
    ways = G.group_paths(calls, up, nearest.withColumn("section", F.lit("path")).unionByName(between.withColumn("section", F.lit("between"))).select("id", "grp").distinct())
    told = ways.join(nearest.withColumn("is_nearest", F.lit(True)), ["id", "grp"], "left").join(walked.select("id", F.lit(True).alias("is_symbol")), "id", "left")
    sections = told.withColumn("section", F.explode(F.array_compact(F.array(F.when(F.col("is_nearest"), "path"), F.when(F.col("is_symbol"), "between")))))
    none, zero = F.lit("").alias("path"), F.lit(0).alias("place")
    says = (
        best.select(F.col("id").alias("symbol"), F.lit("symbol").alias("section"), "place", F.col("kind").alias("item"), F.col("score").cast("long").alias("n"), none)
        .unionByName(counts.select(F.col("grp").alias("symbol"), F.lit("callers").alias("section"), zero, F.lit("").alias("item"), F.col("callers").alias("n"), none))
        .unionByName(counts.select(F.col("grp").alias("symbol"), F.lit("entries").alias("section"), zero, F.lit("").alias("item"), F.col("entries").alias("n"), none))
        .unionByName(first.select(F.col("grp").alias("symbol"), F.lit("entry").alias("section"), "place", F.col("id").alias("item"), F.col("depth").cast("long").alias("n"), none))
        .unionByName(touched.select(F.col("grp").alias("symbol"), "section", zero, "item", F.lit(None).cast("long").alias("n"), none))
        .unionByName(sections.select(F.col("grp").alias("symbol"), "section", zero, F.col("id").alias("item"), F.col("depth").cast("long").alias("n"), G.path_text(F.col("path")).alias("path")))
    )
    says = cut(says, "explored-rows")
    # four signs are about a token; a line of source has about ten
    spent = says.agg(F.coalesce(F.sum(F.length("symbol") + F.length("item") + F.length("path")), F.lit(0))).first()[0] // 4
    lines = best.join(nodes.select("id", "line", "end_line"), "id").where("line is not null").withColumn("tokens", (F.coalesce("end_line", "line") - F.col("line") + 1) * 10).withColumn("answer", F.lit(1))
    fits = budgeted(lines.select("answer", "id", "tokens", F.col("place").alias("best_place")), "answer", F.col("best_place"), "tokens", max(budget - spent, 0))
    return says.unionByName(fits.select(F.col("id").alias("symbol"), F.lit("source").alias("section"), F.col("best_place").alias("place"), F.lit("").alias("item"), F.col("tokens").cast("long").alias("n"), F.lit("").alias("path")))
