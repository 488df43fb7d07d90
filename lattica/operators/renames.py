"""Rename rules learned from matched pairs of names, and applied to names that have no partner yet.

Names are cut into words. A pair that differs in one or two words at its end, or at its beginning, and agrees in the rest says that those words
were renamed. What many pairs say, and two thirds of those with these words, is a rule. A rule gives an unmatched name its wanted name;
if exactly one free name of the other side and of the same kind is called so, they match. Rounds of proposals settle who gets a name that several want, and rules
are learned anew from what was matched, until nothing is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.storage import cut

# Pairs that must say a rule, and words that it may replace.
MIN_SUPPORT, MOST_WORDS = 2, 2


def words(name: Column) -> Column:
    """A name's words in lower case: camel case, capitals, digits and separators."""
    return F.transform(F.regexp_extract_all(F.regexp_extract(F.coalesce(name, F.lit("")), r"([^.]*)$", 1), F.lit(r"([A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+)"), F.lit(1)), F.lower)


def _agree(a: str, b: str, least: Column) -> Column:
    """How many words two arrays begin with in common, `least` at most."""
    return F.aggregate(F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.get(F.col(a), i - 1) == F.get(F.col(b), i - 1)), i).otherwise(acc))


def learn(pairs: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """at (head or tail), was, now, support: rules that pairs of names (a, b) say. A pair counts once however often it is given; of rules for the same words the best supported stays."""
    w = pairs.select("a", "b").distinct().select(words(F.col("a")).alias("s"), words(F.col("b")).alias("t"))
    n = F.least(F.size("s"), F.size("t"))
    w = w.withColumn("p", _agree("s", "t", n)).withColumn("rs", F.reverse("s")).withColumn("rt", F.reverse("t")).withColumn("q", _agree("rs", "rt", n - F.col("p")))
    rest = lambda side, k: F.size(side) - F.col(k)
    few = lambda k: rest("s", k).between(1, MOST_WORDS) & rest("t", k).between(1, MOST_WORDS)
    tail = (F.col("p") > 0) & (F.col("q") == 0) & few("p")
    head = (F.col("q") > 0) & (F.col("p") == 0) & few("q")
    part = lambda side: F.when(tail, F.slice(side, F.col("p") + 1, rest(side, "p"))).otherwise(F.slice(side, F.lit(1), rest(side, "q")))
    said = w.where(tail | head).select(F.when(tail, "tail").otherwise("head").alias("at"), F.array_join(part("s"), " ").alias("was"), F.array_join(part("t"), " ").alias("now"))
    counted = said.groupBy("at", "was", "now").agg(F.count(F.lit(1)).alias("support"))
    by = Window.partitionBy("at", "was")
    kept = counted.withColumn("total", F.sum("support").over(by)).withColumn("place", F.row_number().over(by.orderBy(F.desc("support"), "now")))
    return kept.where((F.col("place") == 1) & (F.col("support") >= min_support) & (F.col("support") * 3 >= F.col("total") * 2)).select("at", "was", "now", "support")


def apply(rules: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, at, was, now, support: pairs of free names (id, name, kind) that rules match; each id in one pair at most.

    A name proposes to the one free name that its best rule wants, and to none where several are called so; a name that several want takes the one
    whose rule has most support, then the least id. Those that were refused propose again.
    """
    key = F.array_join(words(F.col("name")), " ")
    mine = left.select(F.col("id").alias("a"), "kind", words(F.col("name")).alias("s"))
    ends = F.explode(F.flatten(F.array(*(F.array(F.struct(F.lit("tail").alias("at"), F.lit(k).alias("k")), F.struct(F.lit("head").alias("at"), F.lit(k).alias("k"))) for k in range(1, MOST_WORDS + 1)))))
    cuts = mine.withColumn("e", ends).where(F.size("s") > F.col("e.k")).select("a", "kind", "e.at", F.when(F.col("e.at") == "tail", F.slice("s", F.size("s") - F.col("e.k") + 1, F.col("e.k"))).otherwise(F.slice("s", F.lit(1), F.col("e.k"))).alias("part"), F.when(F.col("e.at") == "tail", F.slice("s", F.lit(1), F.size("s") - F.col("e.k"))).otherwise(F.slice("s", F.col("e.k") + 1, F.size("s") - F.col("e.k"))).alias("rest"))
    wanted = cuts.withColumn("was", F.array_join("part", " ")).join(rules, ["at", "was"]).withColumn("words", F.array_join(F.when(F.col("at") == "tail", F.concat("rest", F.array("now"))).otherwise(F.concat(F.array("now"), "rest")), " "))
    offers = cut(wanted.select("a", "kind", "words", "at", "was", "now", "support").join(right.select(F.col("id").alias("b"), "kind", key.alias("words")), ["kind", "words"]), "rename-offers")
    out = None
    while True:
        alone = offers.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("a", "at", "was"))).where("n = 1")
        best = alone.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("support"), "at", "was"))).where("place = 1")
        taken = cut(best.withColumn("place", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("support"), "a"))).where("place = 1").select("a", "b", "at", "was", "now", "support"), "renamed")
        if taken.isEmpty():
            return taken if out is None else out
        out = taken if out is None else out.unionByName(taken)
        offers = cut(offers.join(taken.select("a"), "a", "left_anti").join(taken.select("b"), "b", "left_anti"), "rename-offers")


def matched(pairs: DataFrame, left: DataFrame, right: DataFrame, min_support: int = MIN_SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, how) and rules: those given (a, b: ids) and all that learned rules add, over both sides' names (id, name, kind)."""
    names = lambda p: p.join(left.select(F.col("id").alias("a"), F.col("name").alias("na"), F.col("kind").alias("ka")), "a").join(right.select(F.col("id").alias("b"), F.col("name").alias("nb"), F.col("kind").alias("kb")), "b").where("ka = kb").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    found = cut(pairs.select("a", "b", F.lit("given").alias("how")).distinct(), "rename-pairs")
    while True:
        rules = cut(learn(names(found), min_support), "rename-rules")
        free = lambda side, c: side.join(found.select(F.col(c).alias("id")).distinct(), "id", "left_anti")
        new = apply(rules, free(left, "a"), free(right, "b"))
        if new.isEmpty():
            return found, rules
        found = cut(found.unionByName(new.select("a", "b", F.lit("learned").alias("how"))), "rename-pairs")


def rename_map(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """was, now: names of matched pairs (a, b) that differ."""
    met = pairs.join(left.select(F.col("id").alias("a"), F.col("name").alias("was")), "a").join(right.select(F.col("id").alias("b"), F.col("name").alias("now")), "b")
    return met.where("was <> now").select("was", "now").distinct()
