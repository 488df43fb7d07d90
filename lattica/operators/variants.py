"""Platform conditions out of source text, variants of one symbol, and where variants diverge.

A file's text gives ranges of lines with a condition: branches of `#if` / `#elif` / `#else` (C and Swift; a branch holds where its own condition does and
those of its chain before it don't), items behind Rust's `#[cfg(...)]`, and whole files by their name (`x.ios.ts`, `x_windows.c`). Each distinct
condition is evaluated once for each target, to true, false or unknown; a definition has what all ranges around it say, by an interval join. Only
what is certainly false leaves a target out.

Definitions of one name in one place whose targets differ are variants. A group diverges where a target has none of them while others have, and where
one calls what no other does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions import platforms as P
from lattica.operators import joins as J
from lattica.operators.languages import KEYWORDS
from lattica.operators.routing import Tree
from lattica.storage import cut

TARGETS = list(P.MACROS)
#: Ends of file names that say a target, behind a dot or a low line.
SUFFIXES = {"ios": ["ios"], "android": ["android"], "web": ["web"], "native": ["ios", "android"], "windows": ["windows"], "win": ["windows"], "win32": ["windows"], "linux": ["linux"], "macos": ["macos"], "darwin": ["macos", "ios"]}
_SUFFIX = rf"[._]({'|'.join(SUFFIXES)})(\.[A-Za-z]+)$"


def branches(sources: DataFrame) -> DataFrame:
    """path, start, end, terms of the branches of preprocessor conditions; terms are (condition, negated), all of which must hold."""
    lines = sources.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n", -1)).alias("at", "l"))
    p = r"^\s*#\s*(ifdef|ifndef|if|elif|elseif|else|endif)\b\s*(.*?)\s*(?://.*|/\*.*)?$"
    found = lines.where(F.col("l").rlike(p) & F.col("path").rlike(r"\.(?:c|h|cc|cpp|hpp|m|mm|swift)$")).select("path", (F.col("at") + 1).alias("line"), F.regexp_extract("l", p, 1).alias("word"), F.regexp_extract("l", p, 2).alias("said"))
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens, ends = F.col("word").startswith("if"), F.col("word") == "endif"
    deep = found.withColumn("sum", F.sum(F.when(opens, 1).when(ends, -1).otherwise(0)).over(order)).withColumn("depth", F.when(ends, F.col("sum") + 1).otherwise(F.col("sum")))
    level = Window.partitionBy("path", "depth").orderBy("line")
    chained = deep.withColumn("chain", F.last(F.when(opens, F.col("line")), ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("next", F.lead("line").over(level))
    text = F.when(F.col("word") == "ifdef", F.concat(F.lit("defined("), "said", F.lit(")"))).when(F.col("word") == "ifndef", F.concat(F.lit("!defined("), "said", F.lit(")"))).when(~F.col("word").isin("else", "endif"), F.col("said"))
    in_chain = Window.partitionBy("path", "depth", "chain").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    terms = chained.withColumn("condition", text).withColumn("before", F.collect_list("condition").over(in_chain))
    every = F.concat(F.transform("before", lambda c: F.struct(c.alias("condition"), F.lit(True).alias("negated"))), F.when(F.col("condition").isNotNull(), F.array(F.struct("condition", F.lit(False).alias("negated")))).otherwise(F.array().cast("array<struct<condition:string,negated:boolean>>")))
    return terms.where("word <> 'endif' and next is not null").select("path", (F.col("line") + 1).alias("start"), (F.col("next") - 1).alias("end"), every.alias("terms"))


def items(tree: Tree) -> DataFrame:
    """path, start, end, terms of Rust's items behind an attribute."""
    p = r"^\s*#\[cfg\((.*)\)\]\s*$"
    lines = tree.sources.where(F.col("path").endswith(".rs")).select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n", -1)).alias("at", "l"))
    found = lines.where(F.col("l").rlike(p)).select("path", (F.col("at") + 1).alias("line"), F.regexp_extract("l", p, 1).alias("condition"))
    met = J.as_of(found, tree.defs.select("path", "start", F.col("start").alias("item")), "path", "line", "start", ["item"], direction="forward").where("item is not null")
    return met.select("path", F.col("item").alias("start"), F.col("item").alias("end"), F.array(F.struct("condition", F.lit(False).alias("negated"))).alias("terms"))


def named_files(sources: DataFrame) -> DataFrame:
    """path, start, end, terms of files whose name says a target."""
    word = F.regexp_extract("path", _SUFFIX, 1)
    whole = sources.where(F.col("path").rlike(_SUFFIX))
    return whole.select("path", F.lit(1).alias("start"), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("end"), F.array(F.struct(F.concat(F.lit("file:"), word).alias("condition"), F.lit(False).alias("negated"))).alias("terms"))


def _value(target: str) -> Column:
    """Whether a condition holds on a target: preprocessor, `os(..)`, `cfg` and file names."""
    c = F.col("condition")
    os = lambda name: P.atom(F.lit("os"), name, target)
    swift, plain, quoted = r"^(!?)\s*os\((\w+)\)$", r"^(?:not\()?\s*(windows|unix)\s*\)?$", r"^(?:not\()?\s*target_os\s*=\s*\"(\w+)\"\s*\)?$"
    no = c.startswith("not(")
    flip = lambda negated, value: F.when(negated, ~value).otherwise(value)
    files = F.lit(None).cast("boolean")
    for word, where in SUFFIXES.items():
        files = F.when(c == f"file:{word}", F.lit(target in where)).otherwise(files)
    return (
        F.when(c.startswith("file:"), files)
        .when(c.rlike(swift), flip(F.regexp_extract("condition", swift, 1) == "!", os(F.lower(F.regexp_extract("condition", swift, 2)))))
        .when(c.rlike(plain), flip(no, os(F.regexp_extract("condition", plain, 1))))
        .when(c.rlike(quoted), flip(no, os(F.regexp_extract("condition", quoted, 1))))
        .otherwise(F.col(f"c_{target}"))
    )


def placed(sources: DataFrame, tree: Tree | None = None) -> DataFrame:
    """Definitions with targets (those not certainly left out), unknown (targets on which a condition isn't known) and conditions."""
    tree = tree or Tree.of(sources)
    ranges = cut(branches(sources).unionByName(items(tree)).unionByName(named_files(sources)).withColumn("range", F.xxhash64("path", "start", "end", F.to_json("terms"))), "platform-ranges")
    terms = ranges.select("range", F.explode("terms").alias("t")).select("range", "t.condition", "t.negated").distinct()
    distinct = cut(terms.select("condition").distinct(), "platform-conditions")
    for target in TARGETS:
        distinct = distinct.withColumn(f"c_{target}", P.condition(F.col("condition"), target))
    values = cut(cut(distinct, "platform-macros").select("condition", *(_value(t).alias(t) for t in TARGETS)), "platform-values")
    held = terms.join(values, "condition").select("range", *(F.when(F.col("negated"), ~F.col(t)).otherwise(F.col(t)).alias(t) for t in TARGETS))
    of_range = held.groupBy("range").agg(*(P.all_of(F.collect_list(F.struct(F.col(t).alias("v"))).getField("v")).alias(t) for t in TARGETS))
    where = tree.defs.withColumn("lo", F.col("start")).withColumn("hi", F.col("start")).withColumnRenamed("start", "at")
    met = J.overlapping(where.select("path", "at", "lo", "hi"), ranges.select("path", "start", "end", "range", "terms"), ["path"])
    around = met.join(of_range, "range").groupBy("path", F.col("at").alias("def_line")).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.transform("terms", lambda t: F.concat(F.when(t["negated"], "!").otherwise(""), t["condition"])))))).alias("conditions"), *(P.all_of(F.collect_list(F.struct(F.col(t).alias("v"))).getField("v")).alias(t) for t in TARGETS))
    full = tree.defs.join(around.withColumnRenamed("def_line", "start"), ["path", "start"], "left")  # variants of a file share their id
    live = F.array_compact(F.array(*(F.when(F.col("conditions").isNull() | F.coalesce(F.col(t), F.lit(True)), t) for t in TARGETS)))
    unknown = F.array_compact(F.array(*(F.when(F.col("conditions").isNotNull() & F.col(t).isNull(), t) for t in TARGETS)))
    return full.select("id", "path", "kind", "qualified", "start", live.alias("targets"), unknown.alias("unknown"), F.coalesce("conditions", F.array().cast("array<string>")).alias("conditions"))


def variants(defs: DataFrame) -> DataFrame:
    """grp, id, path, start, targets: definitions (as `placed` gives them) of one kind and name in one place whose targets differ. A file's place is its path without a target's suffix."""
    place = F.regexp_replace("path", _SUFFIX, "$2")
    own = defs.withColumn("grp", F.concat("kind", F.lit(":"), place, F.lit("#"), "qualified"))
    several = own.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("targets").alias("kinds")).where("n > 1 and kinds > 1")
    return own.join(several.select("grp"), "grp", "left_semi").select("grp", "id", "path", "start", "targets")


def divergences(sources: DataFrame, tree: Tree | None = None) -> DataFrame:
    """grp, kind, path, start, what: a target without a variant (kind missing-target), and calls that one variant alone makes (kind own-calls)."""
    tree = tree or Tree.of(sources)
    found = cut(variants(placed(sources, tree)), "variants")
    declared = found.select(F.explode("targets").alias("target")).distinct()
    have = found.select("grp", F.explode("targets").alias("target")).distinct()
    # only targets that the variants of some group name by themselves are looked for
    named = found.where(F.size("targets") < len(TARGETS)).select(F.explode("targets").alias("target")).distinct().join(declared, "target", "left_semi")
    lacking = found.select("grp").distinct().join(F.broadcast(named)).join(have, ["grp", "target"], "left_anti")  # a row for each of at most six targets
    none = F.lit(None)
    missing = lacking.select("grp", F.lit("missing-target").alias("kind"), none.cast("string").alias("path"), none.cast("int").alias("start"), F.col("target").alias("what"))
    # what a variant calls: names in the lines up to the next definition
    spots = tree.lines.join(found.select("path").distinct(), "path", "left_semi").select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1)))).alias("name")).where(~F.col("name").isin(KEYWORDS))
    heads = tree.defs.select("path", "start", F.col("start").alias("of"), F.col("name").alias("own"))
    inside = J.as_of(spots, heads, "path", "line", "start", ["of", "own"]).where("of is not null and name <> own")
    calls = found.join(inside.select("path", F.col("of").alias("start"), "name").distinct(), ["path", "start"])
    alone = calls.groupBy("grp", "name").agg(F.count_distinct("path", "start").alias("n"), F.min("path").alias("path"), F.min("start").alias("start")).where("n = 1")
    return missing.unionByName(alone.select("grp", F.lit("own-calls").alias("kind"), "path", "start", F.col("name").alias("what")))
