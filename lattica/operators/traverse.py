"""Traversals: closures, shortest evidence paths, group closures and state walks as frontier loops.

Each level is a join of the frontier with the edges, cut down to what wasn't seen before and written
to the shared folder, so a level's cost follows its new rows. Edges are filtered by kind, confidence
and gate once, before the loop. A loop ends when a level is empty or at the depth asked for.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from lattica.model import CALL_LIKE, CONFIDENCE, DATA_USE, ENTRY_CLASSES, PROPAGATING
from lattica.operators.build import number_rows
from lattica.storage import cut, release

MAX_DEPTH = 30
#: Nodes up to which their hashes go to every task.
FEW = 1_000_000
#: Groups in one row of a group walk: bits of a word, of which the sign stays free.
GROUPS_A_ROW = 63


def nearby(rows: DataFrame, column: str, ids: DataFrame, count: int) -> DataFrame:
    """The rows whose column may be one of so many ids (one column), for an exact join to follow: a number is looked up for each row, not text. All rows where ids are many."""
    if count > FEW:
        return rows
    mark = F.col if rows.schema[column].dataType == ids.schema[0].dataType == LongType() else lambda c: F.xxhash64(F.col(c).cast("string"))
    marks = ids.select(mark(ids.columns[0]).alias("_mark")).distinct()
    return rows.withColumn("_mark", mark(column)).join(F.broadcast(marks), "_mark", "left_semi").drop("_mark")


def walkable(edges: DataFrame, kinds: Iterable[str] | None = None, min_conf: str = "heuristic", exclude_gate: str | None = None, skip_default_args: bool = True) -> DataFrame:
    """Edges of the kinds (the propagating ones), of a confidence at least, and not dead under the gate; no gate is alive."""
    keep = F.col("kind").isin(list(kinds or PROPAGATING)) & (F.col("conf_rank") >= CONFIDENCE[min_conf])
    if exclude_gate:
        keep &= ~F.col("gate").eqNullSafe(F.lit(exclude_gate))
    if skip_default_args and "is_default_arg" in edges.columns:
        keep &= ~F.coalesce("is_default_arg", F.lit(False))
    return edges.where(keep)


def _closure(steps: DataFrame, seeds: DataFrame, max_depth: int, first_steps: DataFrame | None = None) -> DataFrame:
    """node and depth from seeds (node) by steps (`at` to `to`, repeated or not)."""

    def moved(frontier: DataFrame, steps: DataFrame, levels: list[DataFrame]) -> DataFrame:
        seen = _all([t.select("node") for t in levels])
        return frontier.join(steps, F.col("node") == F.col("at")).select(F.col("to").alias("node")).distinct().join(seen, "node", "left_anti")

    return _levels(steps, seeds.select("node").distinct(), moved, max_depth, first_steps)


def _group_closure(steps: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """node, grp, depth of many groups of seeds (node, grp) in one walk.

    Groups are numbered and walk as bits, 63 in a row of (node, block): groups that reach a node together move in one row.
    """
    numbers = cut(number_rows(seeds.select("grp").distinct(), ["grp"], "n"), "groups")
    place = F.col("n") - 1
    own = seeds.join(numbers.withColumnRenamed("grp", "_grp"), F.col("grp").eqNullSafe(F.col("_grp")))
    start = own.withColumn("block", F.floor(place / GROUPS_A_ROW)).withColumn("bits", F.expr(f"shiftleft(1L, cast((n - 1) % {GROUPS_A_ROW} as int))"))
    either = F.bit_or("bits").alias("bits")

    def moved(frontier: DataFrame, steps: DataFrame, levels: list[DataFrame]) -> DataFrame:
        known = _all([t.select("node", "block", "bits") for t in levels]).groupBy("node", "block").agg(F.bit_or("bits").alias("known"))
        arrived = frontier.join(steps, F.col("node") == F.col("at")).groupBy(F.col("to").alias("node"), "block").agg(either)
        return arrived.join(known, ["node", "block"], "left").select("node", "block", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long")))).alias("bits")).where("bits <> 0")

    found = _levels(steps, start.groupBy("node", "block").agg(either), moved, max_depth)
    each = found.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(GROUPS_A_ROW - 1)))).where("shiftright(bits, bit) & 1 = 1")
    return each.select("node", "depth", (F.col("block") * GROUPS_A_ROW + F.col("bit") + 1).alias("n")).join(numbers, "n").select("node", "grp", "depth")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _levels(steps: DataFrame, first: DataFrame, moved: Callable[[DataFrame, DataFrame, list[DataFrame]], DataFrame], max_depth: int, first_steps: DataFrame | None = None) -> DataFrame:
    """All levels of a walk with their depth; `moved` makes the new rows of a level from the last, the steps near it and the levels so far."""
    frontier = cut(first.withColumn("depth", F.lit(0)), "level")
    levels = [frontier]
    steps = cut(steps, "steps")  # derived once, read at every level
    count = frontier.count()
    for depth in range(1, max_depth + 1):
        use = steps if first_steps is None or depth > 1 else steps.unionByName(first_steps)
        new = cut(moved(frontier, nearby(use, "at", frontier.select("node"), count), levels).withColumn("depth", F.lit(depth)), "level")
        count = new.count()
        if not count:
            release(new)
            break
        levels.append(new)
        frontier = new
        if len(levels) > 8:  # few tables to look into, however deep the graph
            merged = cut(_all(levels[:-1]), "levels")
            for t in levels[:-1]:
                release(t)
            levels = [merged, new]
    release(steps)
    return _all(levels)


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("at"), F.col("src").alias("to"))


def _forward(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("at"), F.col("dst").alias("to"))


def reverse_closure(edges: DataFrame, targets: DataFrame, max_depth: int = MAX_DEPTH, instantiates: DataFrame | None = None) -> DataFrame:
    """id, depth of all that depends on the targets (id). `instantiates`: edges followed from the targets alone."""
    first = None if instantiates is None else _reversed(instantiates)
    return _closure(_reversed(edges), targets.select(F.col("id").alias("node")), max_depth, first).withColumnRenamed("node", "id")


def forward_closure(edges: DataFrame, sources: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    return _closure(_forward(edges), sources.select(F.col("id").alias("node")), max_depth).withColumnRenamed("node", "id")


def group_closures(edges: DataFrame, targets: DataFrame, max_depth: int = MAX_DEPTH, reverse: bool = True, scope: DataFrame | None = None) -> DataFrame:
    """id, grp, depth for many groups of targets (id, grp) in one walk; `scope` (id): nodes that may be walked."""
    steps = _reversed(edges) if reverse else _forward(edges)
    if scope is not None:
        steps = steps.join(scope.select(F.col("id").alias("to")).distinct(), "to", "left_semi")
    return _group_closure(steps, targets.select(F.col("id").alias("node"), "grp"), max_depth).withColumnRenamed("node", "id")


def next_hops(edges: DataFrame, depth: DataFrame) -> DataFrame:
    """For each node below the targets the best edge one step nearer: certain first, then ungated, then kind, target, place."""
    near = depth.select(F.col("id").alias("dst"), (F.col("depth") + 1).alias("depth"))
    ids, count = depth.select("id"), depth.count()
    inside = nearby(nearby(edges, "src", ids, count), "dst", ids, count)
    steps = inside.join(depth.withColumnRenamed("id", "src"), "src").join(near, ["dst", "depth"])
    best = F.min(F.struct((-F.col("conf_rank")).alias("r"), F.col("gate").isNotNull().alias("g"), "kind", "dst", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(-1)).alias("line"), F.coalesce("gate", F.lit("")).alias("gate"), "confidence"))
    return steps.groupBy("src", "depth").agg(best.alias("hop")).select("src", "depth", F.col("hop.dst").alias("dst"), "hop.kind", F.nullif("hop.file", F.lit("")).alias("file"), F.when(F.col("hop.line") >= 0, F.col("hop.line")).alias("line"), F.nullif("hop.gate", F.lit("")).alias("gate"), "hop.confidence", (-F.col("hop.r")).alias("conf_rank"))


def shortest_paths(edges: DataFrame, depth: DataFrame, hop_limit: int = 60) -> DataFrame:
    """id, depth, path (hops to a target), conf_rank of the weakest hop (3 at a target), hops that are gated."""
    hops = cut(next_hops(edges, depth), "hops")
    hop = F.struct(F.col("src").alias("from"), "kind", F.col("dst").alias("to"), F.when(F.col("file").isNotNull(), F.concat_ws(":", "file", F.col("line").cast("string"))).alias("at"), "confidence", F.col("gate").alias("gated"))
    done = depth.where("depth = 0").select("id", "depth", F.array().cast("array<struct<from:string,kind:string,to:string,at:string,confidence:string,gated:string>>").alias("path"), F.lit(3).alias("conf_rank"))
    level, out = done, done
    deepest = hops.agg(F.max("depth")).first()[0] or 0
    for d in range(1, min(deepest, hop_limit) + 1):
        here = hops.where(F.col("depth") == d).select(F.col("src").alias("id"), "depth", F.col("dst").alias("next"), hop.alias("hop"), F.col("conf_rank").alias("own"))
        below = level.select(F.col("id").alias("next"), F.col("path").alias("rest"), F.col("conf_rank").alias("weakest"))
        level = cut(here.join(below, "next").select("id", "depth", F.concat(F.array("hop"), "rest").alias("path"), F.least("own", "weakest").alias("conf_rank")), "paths")
        out = out.unionByName(level)
    return out


def group_paths(edges: DataFrame, closure: DataFrame, wanted: DataFrame, hop_limit: int = 60) -> DataFrame:
    """id, grp, depth, path of wanted (id, grp) pairs of a group closure (id, grp, depth): one best path to the group each.

    A step goes to a node that the group's closure holds one step nearer, by the edge that shortest_paths
    would take: certain first, then ungated, then kind, target, place.
    """
    at = wanted.join(closure, ["id", "grp"]).select("id", "grp", "depth", F.col("id").alias("here"), F.col("depth").alias("left"))
    order = F.struct((-F.col("conf_rank")).alias("r"), F.col("gate").isNotNull().alias("g"), "kind", "dst", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(-1)).alias("line"), F.coalesce("gate", F.lit("")).alias("gate"), "confidence")
    steps = edges.select("src", "dst", "kind", "file", "line", "gate", "conf_rank", "confidence")
    near = closure.select(F.col("id").alias("dst"), "grp", F.col("depth").alias("near"))
    empty = F.array().cast("array<struct<from:string,kind:string,to:string,at:string,confidence:string,gated:string>>")
    level = cut(at.withColumn("path", empty), "group-paths")
    done = level.where("left = 0")
    for _ in range(hop_limit):
        open_rows = level.where("left > 0")
        count = open_rows.count()
        if not count:
            break
        out = cut(open_rows.join(nearby(steps, "src", open_rows.select("here"), count), F.col("here") == F.col("src")), "group-hops")  # few, so the closure stays where it is
        found = out.join(near, ["dst", "grp"]).where("near = left - 1")
        best = found.groupBy("id", "grp", "depth", "here", "left", "path").agg(F.min(order).alias("hop"))
        place = F.when(F.col("hop.file") != "", F.concat_ws(":", "hop.file", F.when(F.col("hop.line") >= 0, F.col("hop.line").cast("string"))))
        hop = F.struct(F.col("here").alias("from"), F.col("hop.kind").alias("kind"), F.col("hop.dst").alias("to"), place.alias("at"), F.col("hop.confidence").alias("confidence"), F.nullif("hop.gate", F.lit("")).alias("gated"))
        level = cut(best.select("id", "grp", "depth", F.col("hop.dst").alias("here"), (F.col("left") - 1).alias("left"), F.concat("path", F.array(hop)).alias("path")), "group-paths")
        done = done.unionByName(level.where("left = 0"))
    return done.select("id", "grp", "depth", "path")


def routes_reaching(edges: DataFrame, functions: DataFrame, max_depth: int = 12) -> DataFrame:
    """id, grp, depth: routes that call their way to each function (id) within so many hops."""
    found = group_closures(walkable(edges, CALL_LIKE), functions.select("id", F.col("id").alias("grp")), max_depth)
    return found.where(F.col("id").startswith("route:"))


def path_text(path: Column) -> Column:
    """A path as text: nodes with the kind of each hop between them."""
    hops = F.transform(path, lambda h: F.concat(h["from"], F.lit(" -"), h["kind"], F.lit("-> ")))
    return F.when(F.size(path) > 0, F.concat(F.array_join(hops, ""), F.element_at(path, -1)["to"])).otherwise("")


def path_between(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One shortest path from any source to any target: depth and path; no row if there is none.

    Walks forward until a level holds a target, then back along the best hops of those levels.
    """
    steps = cut(_forward(edges), "steps")
    seen = frontier = cut(sources.select("id").distinct().withColumn("depth", F.lit(0)), "level")
    goal = frontier.join(targets, "id", "left_semi")
    depth = 0
    while goal.isEmpty() and depth < max_depth:
        depth += 1
        moved = frontier.join(steps, F.col("id") == F.col("at")).select(F.col("to").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        frontier = cut(moved.withColumn("depth", F.lit(depth)), "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        goal = frontier.join(targets, "id", "left_semi")
    end = goal.agg(F.min("id").alias("id")).where("id is not null")
    back = _closure(_reversed(edges.join(seen.select(F.col("id").alias("src")), "src", "left_semi")), end.withColumnRenamed("id", "node"), depth).withColumnRenamed("node", "id")
    start = back.join(sources.select("id").distinct(), "id", "left_semi").where(F.col("depth") == depth).agg(F.min("id").alias("id"))
    return shortest_paths(edges, back).join(start, "id").select("depth", "path", "conf_rank")


def classify(kinds: Column) -> Column:
    """Class of an array of entry kinds: the first of runtime, library, operator, ui, dev and other that has one; none."""
    out = F.when(F.lit(False), F.lit(""))
    for name in ("runtime", "library", "operator", "ui", "dev", "other"):
        out = out.when(F.arrays_overlap(kinds, F.array(*(F.lit(k) for k in ENTRY_CLASSES[name]))), name)
    return out.otherwise("none")


#: Steps up to which a condensed graph is squared, and beyond which its cycles are sought over a few steps of each node first.
DENSE = 1_000_000
#: Levels that colours walk before what they found is contracted; more where nothing was found.
COLOUR_LEVELS = 12


def _renamed(steps: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct steps between what their ends are now called (names: node, knot); those within one node go."""
    for end in ("at", "to"):
        steps = steps.join(names.select(F.col("node").alias(end), "knot"), end, "left").withColumn(end, F.coalesce("knot", end)).drop("knot")
    return steps.where("at <> to").select("at", "to").distinct()


def _few_of_each(steps: DataFrame) -> DataFrame:
    """Of each node the steps to and from its least and greatest neighbours: what is one part by these is one part by all."""
    out = steps.groupBy("at").agg(F.array_distinct(F.array(F.min("to"), F.max("to"))).alias("ends")).select("at", F.explode("ends").alias("to"))
    into = steps.groupBy("to").agg(F.array_distinct(F.array(F.min("at"), F.max("at"))).alias("ends")).select(F.explode("ends").alias("at"), "to")
    return out.unionByName(into).distinct()


def _trimmed(steps: DataFrame, count: int) -> tuple[DataFrame, int]:
    """Steps without the nodes that none enters or none leaves: they lie on no cycle."""
    for _ in range(COLOUR_LEVELS):
        inside = steps.join(steps.select(F.col("to").alias("at")).distinct(), "at", "left_semi").join(steps.select(F.col("at").alias("to")).distinct(), "to", "left_semi")
        kept = cut(inside.select("at", "to"), "trimmed")
        left = kept.count()
        if left == count:
            release(kept)
            break
        release(steps)
        steps, count = kept, left
        if not left:
            break
    return steps, count


def _same_part(steps: DataFrame, levels: int) -> DataFrame:
    """node, knot: nodes that are strongly connected with another by walks of so many levels at most, and the one they are called by.

    Each node takes the greatest number that reaches it as its colour; those that reach their colour's own
    node over nodes of the colour are one part with it. Walks that end early find less, nothing wrong.
    """
    ends = steps.select(F.explode(F.array("at", "to")).alias("node")).distinct()
    colours = cut(ends.withColumn("colour", F.col("node")).withColumn("own", F.col("node") - 1), "colours")
    for _ in range(levels):
        moved = colours.where("colour > own").join(steps, F.col("node") == F.col("at")).select(F.col("to").alias("node"), "colour", F.lit(None).cast("long").alias("own"))
        new = cut(colours.select("node", "colour", F.col("colour").alias("own")).unionByName(moved).groupBy("node").agg(F.max("colour").alias("colour"), F.max("own").alias("own")), "colours")
        release(colours)
        colours = new
        if colours.where("colour > own").isEmpty():
            break
    here, there = colours.select(F.col("node").alias("at"), "colour"), colours.select(F.col("node").alias("to"), "colour")
    back = steps.join(here, "at").join(there, ["to", "colour"]).select(F.col("to").alias("at"), F.col("at").alias("to"))
    found = _closure(back, colours.where("node = colour").select("node"), levels)
    out = cut(found.join(colours, "node").where("node <> colour").select("node", F.col("colour").alias("knot")), "parts")
    release(colours)
    return out


def _condensed(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct steps (numbers) in which each strongly connected part is one of its nodes, and the parts: node, knot.

    Rounds of colours, forwards and backwards in turn, over a few steps of each node while there are many; what
    they find is contracted, and what lies on no cycle goes, until nothing is left that could lie on one.
    """
    whole, parts, left = steps, None, steps
    count, levels, backwards = steps.count(), COLOUR_LEVELS, False
    while count:
        near = cut(_few_of_each(left), "few") if count > DENSE else left
        turned = near.select(F.col("to").alias("at"), F.col("at").alias("to")) if backwards else near
        found = _same_part(turned, levels)
        backwards = not backwards
        if found.isEmpty():
            levels *= 2
        else:
            parts_before, alone = parts, left is whole
            if parts is None:
                parts = found
            else:
                moved = parts.join(found.select(F.col("node").alias("knot"), F.col("knot").alias("to")), "knot", "left").select("node", F.coalesce("to", "knot").alias("knot"))
                parts = cut(moved.unionByName(found), "parts")
                release(parts_before)
            contracted = cut(_renamed(whole, found), "condensed")
            rest = contracted if alone else cut(_renamed(left, found), "left")
            if whole is not steps:
                release(whole)
            if not alone:
                release(left)
            whole, left = contracted, rest
            if parts is not found:
                release(found)
        if near is not left:
            release(near)
        count = left.count()
        kept, count = _trimmed(left.select("at", "to"), count)
        left = kept
    none = steps.select(F.col("at").alias("node"), F.col("to").alias("knot")).limit(0)
    return (whole.distinct() if whole is steps else whole), none if parts is None else parts


def _merged(steps: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps without the nodes that just one other enters and that have no mark (node) of their own, and these with the node whose marks are theirs: node, knot."""
    entered = steps.groupBy("to").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("knot")).where("n = 1")
    plain = cut(entered.select(F.col("to").alias("node"), "knot").join(marked, "node", "left_anti"), "plain")
    while True:  # half as many steps to the first that isn't plain
        above = plain.select(F.col("node").alias("knot"), F.col("knot").alias("above"))
        new = cut(plain.join(above, "knot", "left").select("node", F.coalesce("above", "knot").alias("knot"), F.col("above").isNotNull().alias("moved")), "plain")
        release(plain)
        plain = new
        if plain.where("moved").isEmpty():
            break
    plain = plain.drop("moved")
    kept = steps.join(plain.select(F.col("node").alias("to")), "to", "left_anti")
    return cut(_renamed(kept, plain), "merged"), plain


def _squared(steps: DataFrame) -> DataFrame:
    """Steps with those over two, four ... of them, while all stay few: a walk over them has fewer levels."""
    steps = cut(steps, "squared")
    count = steps.count()
    while count:
        through = steps.groupBy(F.col("to").alias("node")).agg(F.count(F.lit(1)).alias("i")).join(steps.groupBy(F.col("at").alias("node")).agg(F.count(F.lit(1)).alias("o")), "node")
        if (through.agg(F.sum(F.col("i") * F.col("o"))).first()[0] or 0) > DENSE:
            break
        two = steps.select("at", F.col("to").alias("via")).join(steps.select(F.col("at").alias("via"), "to"), "via").select("at", "to")
        new = cut(steps.unionByName(two).distinct(), "squared")
        release(steps)
        steps, before = new, count
        count = steps.count()
        if count == before:
            break
    return steps


#: Entries in one row of marks: so many words of 63 bits (the sign stays free, so that no mark overflows).
WORDS, BITS = 16, 63


def _marks(pairs: DataFrame, steps: DataFrame) -> DataFrame:
    """node, k, count, n: how many numbers n of each k reach a node, and the least, from pairs (node, k, n) over steps without cycles.

    Numbers walk as bits, about a thousand in a row of (node, k, block); a level passes on the bits that are new.
    """
    words, keys = [f"w{i}" for i in range(WORDS)], ["node", "k", "block"]
    either = [F.bit_or(w).alias(w) for w in words]
    bit, word = F.expr(f"shiftleft(1L, cast(n % {BITS} as int))"), F.expr(f"n div {BITS} % {WORDS}")
    placed = pairs.select("node", "k", F.expr(f"n div {BITS * WORDS}").alias("block"), *(F.when(word == i, bit).otherwise(F.lit(0).cast("long")).alias(w) for i, w in enumerate(words)))
    steps = _squared(steps)
    new = cut(placed.groupBy(*keys).agg(*either), "marks")
    levels = [new]
    while not new.isEmpty():
        arrived = new.join(steps, F.col("node") == F.col("at")).groupBy(F.col("to").alias("node"), "k", "block").agg(*either)
        known = _all(levels).groupBy(*keys).agg(*(F.bit_or(w).alias(f"s{w}") for w in words))
        fresh = arrived.join(known, keys, "left").select(*keys, *(F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"s{w}", F.lit(0).cast("long")))).alias(w) for w in words))
        new = cut(fresh.where(F.greatest(*words) > 0), "marks")
        levels.append(new)
        if len(levels) > 8:
            merged = cut(_all(levels[:-1]).groupBy(*keys).agg(*either), "marks")
            for t in levels[:-1]:
                release(t)
            levels = [merged, new]
    release(steps)
    least = F.coalesce(*(F.when(F.col(w) > 0, F.lit(i * BITS) + F.bit_count(F.col(w).bitwiseAND(-F.col(w)) - 1)) for i, w in enumerate(words)))
    seen = _all(levels).groupBy(*keys).agg(*either)
    return seen.groupBy("node", "k").agg(F.sum(sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0]))).alias("count"), F.min(F.col("block") * (BITS * WORDS) + least).alias("n"))


def _numbered_ends(links: DataFrame, entries: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
    """id, node, entered of all ends of links and entries, and the number (node) of an id as a column.

    A number is the one that the id ends in, before bits of a hash: later parts have greater numbers, and edges
    mostly lead one way, so a colour seldom leaves its part. Two ids of one number are looked for; then another seed is taken.
    """
    ends = links.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(False).alias("entered")), F.struct(F.col("dst").alias("id"), F.lit(True).alias("entered")))).alias("e")).select("e.*")
    ends = cut(ends.unionByName(entries.select("id", F.lit(False).alias("entered"))).groupBy("id").agg(F.max("entered").alias("entered")), "ends")
    seed = 0
    while True:
        number = lambda c, seed=seed: F.expr(f"shiftleft(coalesce(try_cast(substring_index({c}, ':', -1) as bigint), 0L) & {(1 << 22) - 1}L, 41) | (xxhash64({c}, {seed}) & {(1 << 41) - 1}L)")
        named = ends.withColumn("node", number("id"))
        if named.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return named, number
        seed += 1


def tag_entries(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, entry_kind, entry_count, sample_entry: the entries that reach each node at any distance, by kind.

    Nodes that the same entries reach are one: each strongly connected part, and what only one other node enters.
    Entries that nothing enters reach themselves; nodes that only they enter, and that lead to one other at most,
    are counted by their pairs. Only the rest walks, as bits.
    """
    links = edges.where("src <> dst").select("src", "dst")
    numbered = number_rows(nodes.where("entry_kind is not null").select("entry_kind", "id").distinct(), ["entry_kind", "id"], "n")
    first = numbered.groupBy("entry_kind").agg(F.min("n").alias("first")).withColumn("k", F.row_number().over(Window.orderBy("entry_kind")))  # a row per kind
    entries = cut(numbered.join(F.broadcast(first), "entry_kind").select("entry_kind", "id", "k", (F.col("n") - F.col("first")).alias("n")), "entries")
    ends, number = _numbered_ends(links, entries)
    entered = ends.where("entered").select("node")
    steps = links.select(number("src").alias("at"), number("dst").alias("to"))
    own = entries.select(number("id").alias("node"), "k", "n")

    inside = cut(steps.join(entered.withColumnRenamed("node", "at"), "at", "left_semi").select("at", "to"), "steps")
    short, parts = _condensed(inside)
    outer = steps.join(own.join(entered, "node", "left_anti").withColumnRenamed("node", "at"), "at").select(F.col("to").alias("node"), "k", "n")
    pairs = outer.unionByName(own.join(entered, "node", "left_semi")).join(parts, "node", "left").select(F.coalesce("knot", "node").alias("node"), "k", "n")
    pairs = cut(pairs.distinct(), "pairs")
    short, plain = _merged(short, pairs.select("node").distinct())
    release(inside)

    out = short.groupBy(F.col("at").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    walked = cut(short.select(F.col("to").alias("node")).unionByName(out).distinct(), "walked")
    light = pairs.join(walked, "node", "left_anti")
    passed = light.join(short, F.col("node") == F.col("at")).select(F.col("to").alias("node"), "k", "n")
    heavy = _marks(pairs.join(walked, "node", "left_semi").unionByName(passed), short.join(walked.withColumnRenamed("node", "at"), "at", "left_semi").select("at", "to"))
    tags = heavy.unionByName(light.groupBy("node", "k").agg(F.count(F.lit(1)).alias("count"), F.min("n").alias("n")))
    tags = tags.join(entries.select("k", "n", "entry_kind", F.col("id").alias("sample_entry")), ["k", "n"]).select(F.col("node").alias("whose"), "entry_kind", F.col("count").alias("entry_count"), "sample_entry")

    of = ends.where("entered").select("id", "node").join(parts, "node", "left").select("id", F.coalesce("knot", "node").alias("node"))
    of = of.join(plain, "node", "left").select(F.col("id").alias("node_id"), F.coalesce("knot", "node").alias("whose"))
    alone = entries.join(ends.where("entered").select("id"), "id", "left_anti").select(F.col("id").alias("node_id"), "entry_kind", F.lit(1).cast("long").alias("entry_count"), F.col("id").alias("sample_entry"))
    return of.join(tags, "whose").select("node_id", "entry_kind", "entry_count", "sample_entry").unionByName(alone)


def entries_of(edges: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """tag_entries' rows of the wanted nodes (id) alone: one walk upwards with a group for each, whatever the rest of the graph holds."""
    above = group_closures(edges, wanted.select("id", F.col("id").alias("grp")), sys.maxsize)
    entries = nodes.where("entry_kind is not null").select("id", "entry_kind").distinct()
    return above.join(entries, "id").groupBy(F.col("grp").alias("node_id"), "entry_kind").agg(F.count(F.lit(1)).alias("entry_count"), F.min("id").alias("sample_entry"))


def _number(column: str, seed: int) -> Column:
    """The number that a walk over numbers takes for an id; another seed, other numbers."""
    return F.xxhash64(F.col(column).cast("string"), F.lit(seed))


def _live_closure(edges: DataFrame, targets: DataFrame, alive: Column, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """id, depth, live of all that depends on the targets, live if over edges that are alive alone, and the edges to choose its paths from.

    One walk over numbers, with a bit for all edges and one for those alive; names are read once, after it. Where
    two ids near it have one number, another seed is taken. Edges that don't lead into a closure of few nodes go.
    """
    every, live = 1, 2
    seed = 0

    def moved(frontier: DataFrame, steps: DataFrame, levels: list[DataFrame]) -> DataFrame:
        known = _all([t.select("node", "bits") for t in levels]).groupBy("node").agg(F.bit_or("bits").alias("known"))
        arrived = frontier.join(steps, F.col("node") == F.col("at")).groupBy(F.col("to").alias("node")).agg(F.bit_or(F.col("bits").bitwiseAND(F.col("over"))).alias("bits"))
        return arrived.join(known, "node", "left").select("node", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0)))).alias("bits")).where("bits <> 0")

    while True:
        steps = edges.select(_number("dst", seed).alias("at"), _number("src", seed).alias("to"), F.when(alive, every | live).otherwise(every).alias("over"))
        first = targets.select(_number("id", seed).alias("node"), F.lit(every | live).alias("bits")).distinct()
        walk = _levels(steps, first, moved, max_depth)
        found = cut(walk.groupBy("node").agg(F.min("depth").alias("depth"), F.bit_or("bits").alias("bits")), "closure")
        count, near = found.count(), edges
        if count <= FEW:
            near = cut(nearby(edges.withColumn("_n", _number("dst", seed)), "_n", found.select("node"), count).drop("_n"), "near")
        ends = near.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(targets.select("id"))
        names = ends.groupBy(_number("id", seed).alias("node")).agg(F.min("id").alias("id"), F.max("id").alias("other"))
        named = cut(found.join(names, "node"), "closure")
        release(found)
        if named.where("id <> other").isEmpty():
            return named.select("id", "depth", (F.col("bits") >= live).alias("live")), near
        seed += 1


def reaches(nodes: DataFrame, edges: DataFrame, targets: DataFrame, gate: str | None = None, min_conf: str = "heuristic", max_depth: int = MAX_DEPTH) -> DataFrame:
    """Entries that reach the targets: id, entry_kind, class, depth, status (live, gated), path, confidence of the path."""
    alive = ~F.col("gate").eqNullSafe(F.lit(gate)) if gate else F.lit(True)
    closure, near = _live_closure(walkable(edges, None, min_conf), targets, alive, max_depth)
    paths = shortest_paths(near, closure.select("id", "depth"))
    entries = nearby(nodes.where("entry_kind is not null").select("id", "entry_kind"), "id", closure.select("id"), closure.count())
    found = entries.join(paths, "id").join(closure.select("id", "live"), "id")
    return found.select("id", "entry_kind", classify(F.array("entry_kind")).alias("class"), "depth", F.when(F.col("live"), "live").otherwise("gated").alias("status"), "path", "conf_rank")


def impact(nodes: DataFrame, edges: DataFrame, targets: DataFrame, target_kind: str = "function", min_conf: str = "heuristic") -> DataFrame:
    """Callers up to the entry points: id, kind, depth, is_entry, candidate (reached by heuristic edges alone)."""
    kinds = CALL_LIKE + (DATA_USE if target_kind in ("table", "column", "connection", "external") else ["USES_I18N"] if target_kind == "i18n" else [])
    closure = reverse_closure(walkable(edges, kinds, min_conf), targets)
    sure = reverse_closure(walkable(edges, kinds, "resolved"), targets).select("id", F.lit(True).alias("sure"))
    return closure.where("depth > 0").join(nodes.select("id", "kind", "entry_kind"), "id").join(sure, "id", "left").select("id", "kind", "depth", F.col("entry_kind").isNotNull().alias("is_entry"), F.col("sure").isNull().alias("candidate"))


def downstream(edges: DataFrame, sources: DataFrame, sinks: Iterable[str], gate: str | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """id, sink kind, flags, depth, live of what the sources reach through a sink edge.

    The walk's state is (node, flags): `override` once a dispatch hop was taken, `event` after an
    event hop, `gated` after a hop that is dead under the gate. Each state is visited once.
    """
    dispatch, event = ["OVERRIDDEN_BY", "IMPLEMENTED_BY"], ["DISPATCHES", "LISTENED_BY", "SENDS_TO", "RECEIVED_BY"]
    flag = F.when(F.col("kind").isin(dispatch), 1).otherwise(0) + F.when(F.col("kind").isin(event), 2).otherwise(0)
    if gate:
        flag = flag + F.when(F.col("gate").eqNullSafe(F.lit(gate)), 4).otherwise(0)
    steps = cut(edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "kind", flag.alias("adds")).distinct(), "steps")
    frontier = cut(sources.select(F.col("id").alias("node"), F.lit(0).alias("flags"), F.lit(0).alias("depth")), "level")
    states = frontier
    calls = steps.where(~F.col("kind").isin(list(sinks))).select("at", "to", "adds").distinct()
    for depth in range(1, max_depth + 1):
        moved = frontier.join(calls, F.col("node") == F.col("at")).select(F.col("to").alias("node"), F.col("flags").bitwiseOR(F.col("adds")).alias("flags")).distinct()
        frontier = cut(moved.join(states.select("node", "flags"), ["node", "flags"], "left_anti").withColumn("depth", F.lit(depth)), "level")
        if frontier.isEmpty():
            break
        states = states.unionByName(frontier)
    hit = states.join(steps.where(F.col("kind").isin(list(sinks))), F.col("node") == F.col("at")).select(F.col("to").alias("id"), "kind", F.col("flags").bitwiseOR(F.col("adds")).alias("flags"), (F.col("depth") + 1).alias("depth"))
    return hit.groupBy("id", "kind", "flags").agg(F.min("depth").alias("depth")).withColumn("live", F.col("flags").bitwiseAND(4) == 0)


def affected(nodes: DataFrame, edges: DataFrame, touched: DataFrame, min_conf: str = "heuristic") -> DataFrame:
    """id, entry_kind of the tests that cover the touched nodes (id), by calls, and of the other entries that reach them, at any distance."""
    test = F.col("entry_kind") == "test"
    tests = reverse_closure(walkable(edges, CALL_LIKE + ["TEST_CALLS", "TEST_USES", "TEST_HTTP", "TEST_VISITS"], min_conf), touched)
    others = reverse_closure(walkable(edges, None, min_conf), touched)
    entries = nodes.where("entry_kind is not null").select("id", "entry_kind")
    return entries.where(test).join(tests, "id", "left_semi").unionByName(entries.where(~test).join(others, "id", "left_semi"))


def nearest_gated(edges: DataFrame, targets: DataFrame, gate: str, max_depth: int = 6) -> DataFrame:
    """The gated edge nearest above the targets: src, dst, kind, depth of its lower end."""
    closure = reverse_closure(walkable(edges), targets, max_depth).select(F.col("id").alias("dst"), "depth")
    gated = walkable(edges).where(F.col("gate").eqNullSafe(F.lit(gate))).join(closure, "dst")
    return gated.agg(F.min(F.struct("depth", "dst", "src", "kind")).alias("e")).where("e is not null").select("e.src", "e.dst", "e.kind", "e.depth")


def descendants(edges: DataFrame, classes: DataFrame) -> DataFrame:
    return reverse_closure(walkable(edges, ["EXTENDS", "IMPLEMENTS", "USES_TRAIT"]), classes)


def ancestors(edges: DataFrame, classes: DataFrame) -> DataFrame:
    return forward_closure(walkable(edges, ["EXTENDS", "IMPLEMENTS", "USES_TRAIT"]), classes)


def overrides_below(edges: DataFrame, methods: DataFrame) -> DataFrame:
    return forward_closure(walkable(edges, ["OVERRIDDEN_BY", "IMPLEMENTED_BY"]), methods).where("depth > 0")


def nearest_definer(edges: DataFrame, classes: DataFrame, definers: DataFrame) -> DataFrame:
    """For each class (id) the nearest ancestor among definers (id), itself included: id, definer, depth."""
    up = group_closures(walkable(edges, ["EXTENDS", "IMPLEMENTS", "USES_TRAIT"]), classes.select("id", F.col("id").alias("grp")), reverse=False)
    return up.join(definers.select("id").distinct(), "id", "left_semi").groupBy(F.col("grp").alias("id")).agg(F.min(F.struct("depth", F.col("id").alias("definer"))).alias("best")).select("id", "best.definer", "best.depth")


def only_by_dispatch(edges: DataFrame, targets: DataFrame, min_conf: str = "heuristic") -> DataFrame:
    """Nodes that depend on the targets through override hops alone: id, depth."""
    every = reverse_closure(walkable(edges, CALL_LIKE, min_conf), targets)
    direct = reverse_closure(walkable(edges, [k for k in CALL_LIKE if k not in ("OVERRIDDEN_BY", "IMPLEMENTED_BY")], min_conf), targets)
    return every.join(direct.select("id"), "id", "left_anti")


def every_step_dispatch(edges: DataFrame, targets: DataFrame, min_conf: str = "heuristic") -> DataFrame:
    """Nodes above the targets whose every step nearer to them is an override hop: id, depth. They don't call; their callers do."""
    used = walkable(edges, CALL_LIKE, min_conf)
    every = cut(reverse_closure(used, targets), "closure")
    steps = used.where(~F.col("kind").isin("OVERRIDDEN_BY", "IMPLEMENTED_BY")).select(F.col("src").alias("id"), "dst").distinct()
    near = every.select(F.col("id").alias("dst"), (F.col("depth") + 1).alias("depth"))
    calls = steps.join(near, "dst").select("id", "depth")
    return every.where("depth > 0").join(calls, ["id", "depth"], "left_anti")


def class_pairs(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, sub: each class (id) with all classes below it, itself included."""
    up = group_closures(walkable(edges, ["EXTENDS", "IMPLEMENTS", "USES_TRAIT"]), classes.select("id", F.col("id").alias("grp")))
    return up.select(F.col("grp").alias("cls"), F.col("id").alias("sub"))


def receiver_walk(edges: DataFrame, starts: DataFrame, node_class: DataFrame, pairs: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """id, depth of what the starts reach when calls keep what is known of their receiver.

    A state is a node and the class its receiver must be of, or none. A call on `this` keeps the class,
    a call with one type in `recv` sets it, any other frees it. An override is entered only if its
    class (node_class: id, cls) is at or below the required one (pairs: cls, sub), or if either is unknown.
    """
    dispatch = F.col("kind").isin("OVERRIDDEN_BY", "IMPLEMENTED_BY")
    one = F.when(F.size("recv") == 1, F.element_at("recv", 1))
    steps = cut(edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), dispatch.alias("dispatch"), F.coalesce("on_this", F.lit(False)).alias("keeps"), one.alias("sets")).distinct(), "steps")
    owned = node_class.select(F.col("id").alias("to"), F.col("cls").alias("own"))
    below = pairs.select(F.col("cls").alias("need"), F.col("sub").alias("own"), F.lit(True).alias("fits"))
    frontier = cut(starts.select(F.col("id").alias("node"), F.lit("").alias("need"), F.lit(0).alias("depth")), "level")
    states = frontier
    for depth in range(1, max_depth + 1):
        moved = frontier.join(steps, F.col("node") == F.col("at")).join(owned, "to", "left").join(below, ["need", "own"], "left")
        allowed = ~F.col("dispatch") | (F.col("need") == "") | F.col("own").isNull() | F.coalesce("fits", F.lit(False))
        need = F.when(F.col("dispatch") | F.col("keeps"), F.col("need")).otherwise(F.coalesce("sets", F.lit("")))
        new = moved.where(allowed).select(F.col("to").alias("node"), need.alias("need")).distinct().join(states.select("node", "need"), ["node", "need"], "left_anti")
        frontier = cut(new.withColumn("depth", F.lit(depth)), "level")
        if frontier.isEmpty():
            break
        states = states.unionByName(frontier)
    return states.groupBy(F.col("node").alias("id")).agg(F.min("depth").alias("depth"))


def platform_entries(edges: DataFrame, nodes: DataFrame, depth: DataFrame) -> DataFrame:
    """node_id, entry_kind, entry_count, sample_entry within the nodes of a closure (id): entries walk inside it alone."""
    inside = depth.select("id").distinct()
    entries = nodes.where("entry_kind is not null").join(inside, "id", "left_semi").select("id", F.struct("entry_kind", F.col("id").alias("entry")).alias("grp"))
    reach = group_closures(edges, entries, reverse=False, scope=inside)
    return reach.groupBy(F.col("id").alias("node_id"), F.col("grp.entry_kind").alias("entry_kind")).agg(F.count(F.lit(1)).alias("entry_count"), F.min("grp.entry").alias("sample_entry"))


def deepest(edges: DataFrame, starts: DataFrame, sinks: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """id, sinks: the start that reaches most sinks, ties by id: a top-1 report."""
    reach = group_closures(edges, starts.select("id", F.col("id").alias("grp")), max_depth, reverse=False)
    hit = reach.join(sinks.select("id").distinct(), "id", "left_semi").groupBy(F.col("grp").alias("id")).agg(F.count(F.lit(1)).alias("sinks"))
    return hit.orderBy(F.desc("sinks"), "id").limit(1)


def within(spark, seconds: float, work):
    """Run `work()` under a job group that is cancelled after so many seconds; its result, or None if it was cut off."""
    import threading
    import uuid

    group = f"lattica-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(group, "within a deadline", True)
    timer.start()
    try:
        return work()
    except Exception:
        if late.is_set():
            return None
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
