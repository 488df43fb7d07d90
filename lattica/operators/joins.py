"""Joins that need more than equal keys: ranges, nearest rows, templates and patterns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions import matchers as M
from lattica.functions.text import method_ok

#: Width of the buckets by which ranges are blocked.
BUCKET = 64


def _buckets(low: str, high: str, width: int) -> Column:
    return F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int = BUCKET) -> DataFrame:
    """Pairs whose ranges (lo, hi of left; start, end of right) overlap within equal keys, each once.

    Both sides go to the buckets their ranges touch; a pair counts in the first bucket that both
    touch, so no distinct is needed after it.
    """
    a = left.withColumn("_b", _buckets("lo", "hi", width))
    b = right.withColumn("_b", _buckets("start", "end", width))
    first = F.greatest(F.floor(F.col("lo") / width), F.floor(F.col("start") / width))
    return a.join(b, [*keys, "_b"]).where((F.col("lo") <= F.col("end")) & (F.col("start") <= F.col("hi")) & (F.col("_b") == first)).drop("_b")


#: Rows of the right side for which a range's list of ids gets one more part.
IDS_A_LIST = 100_000
#: Pairs that one task makes, up to so many tasks; beyond these each makes more.
PAIRS_A_TASK, MOST_TASKS = 2_000_000, 1_000
#: Pairs that a task holds at once, and the most items in one row.
PAIRS_AT_ONCE, ITEMS_A_ROW = 200_000, 500


def overlapping_each(left: DataFrame, right: DataFrame, item: list[str], keys: list[str], width: int = BUCKET) -> DataFrame:
    """The left rows' items with the id of each right row whose range overlaps theirs: all pairs, as `overlapping` has them.

    Equal left ranges meet the right side once; their items then take the list of what was found, some items at a
    time and the list in parts of bounded length, so no pair is compared or moved. Pairs are counted first: tasks follow
    their number, not the rows moved, and a range with more pairs than a task should make goes to several. A
    part stays while some items pass by: equal ids come in short rounds, which files hold in little space.
    """
    whole = [*keys, "lo", "hi"]
    parts = right.count() // IDS_A_LIST + 1
    alike = left.groupBy(*whole).agg(F.count(F.lit(1)).alias("_n"))
    found = overlapping(alike.select(*whole), right, keys, width)
    pairs = alike.join(found.groupBy(*whole).agg(F.count(F.lit(1)).alias("_m")), whole).select(*whole, "_m", (F.col("_n") * F.col("_m").cast("double")).alias("_pairs"))
    total, most = pairs.agg(F.coalesce(F.sum("_pairs"), F.lit(0.0)), F.coalesce(F.max("_m"), F.lit(1))).first()
    share = max(PAIRS_A_TASK, total / MOST_TASKS)
    tasks = int(total // share) + 1
    hot = F.broadcast(pairs.where(F.col("_pairs") > share).select(*whole, F.ceil(F.col("_pairs") / share).alias("_tasks")))  # fewer than MOST_TASKS
    several, salt = F.coalesce("_tasks", F.lit(1).cast("long")), [*whole, "_salt"]

    lists = found.groupBy(*whole, F.pmod(F.xxhash64("id"), F.lit(parts)).alias("_part")).agg(F.collect_list("id").alias("_ids"))
    held = lists.join(hot, whole, "left").select(*whole, F.explode(F.sequence(F.lit(0).cast("long"), several - 1)).alias("_salt"), "_ids").repartition(tasks, *salt)
    asked = left.select(*item, *whole).join(hot, whole, "left").select(*item, *whole, F.pmod(F.xxhash64(*item), several).alias("_salt")).repartition(tasks, *salt)
    turn = F.floor((F.row_number().over(Window.partitionBy(*salt).orderBy(*item)) - 1) / min(max(PAIRS_AT_ONCE // most, 1), ITEMS_A_ROW))
    items = asked.withColumn("_turn", turn).groupBy(*salt, "_turn").agg(F.collect_list(F.struct(*item)).alias("_items"))
    met = items.hint("merge").join(held, salt).select(F.explode("_items").alias("_item"), "_ids")
    return met.select(*(F.col(f"_item.{c}").alias(c) for c in item), F.explode("_ids").alias("id"))


def innermost(pairs: DataFrame, item: list[str], lo: str = "start", hi: str = "end", tie: str = "id") -> DataFrame:
    """For each item the narrowest of its ranges."""
    best = pairs.groupBy(*item).agg(F.min_by(F.struct(*(c for c in pairs.columns if c not in item)), F.struct(F.col(hi) - F.col(lo), F.col(tie))).alias("best"))
    return best.select(*item, "best.*")


def touched(left: DataFrame, right: DataFrame, keys: list[str], width: int = BUCKET) -> DataFrame:
    """id of the right rows that any range of left overlaps: equal ranges of either side meet once, no pair of rows is made."""
    asked, held = left.select(*keys, "lo", "hi").distinct(), right.select(*keys, "start", "end").distinct()
    met = overlapping(asked, held, keys, width).select(*keys, "start", "end").distinct()
    return right.join(met, [*keys, "start", "end"], "left_semi").select("id").distinct()


def innermost_each(left: DataFrame, right: DataFrame, item: list[str], keys: list[str], width: int = BUCKET) -> DataFrame:
    """The left rows' items with id, start, end of the narrowest right range that overlaps them, ties by id.

    Of equal right ranges only the least id can win, and equal left ranges have one answer: both are joined once.
    """
    asked = left.select(*keys, "lo", "hi").distinct()
    held = right.groupBy(*keys, "start", "end").agg(F.min("id").alias("id"))
    best = innermost(overlapping(asked, held, keys, width), [*keys, "lo", "hi"])
    return innermost(left.select(*item, *keys, "lo", "hi").join(best, [*keys, "lo", "hi"]).select(*item, "id", "start", "end"), item)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, columns: list[str], direction: str = "backward") -> DataFrame:
    """Each left row with the columns of the last right row of its key whose `since` isn't later; ties by the columns.

    Both sides are merged by key and time in one window pass: no pair of them is made.
    """
    value = F.struct(*(F.col(c) for c in columns))
    tagged = left.select(F.struct("*").alias("row"), F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v"))
    offered = right.select(F.lit(None).cast(tagged.schema["row"].dataType).alias("row"), F.col(key).alias("_k"), F.col(since).alias("_t"), F.lit(0).alias("_side"), value.alias("_v"))
    if direction == "forward":
        order = Window.partitionBy("_k").orderBy(F.desc("_t"), "_side", F.desc("_v"))
    else:
        order = Window.partitionBy("_k").orderBy("_t", "_side", "_v")
    last = F.last("_v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return tagged.unionByName(offered).withColumn("_v", last).where("_side = 1").select("row.*", *(F.col(f"_v.{c}").alias(c) for c in columns))


def match_endpoints(senders: DataFrame, receivers: DataFrame, matcher: str | Callable = "path", fan_out: bool = False, extra: Column | None = None) -> DataFrame:
    """sender, receiver, ok info, confidence: who may receive what each sender sends.

    Without fan-out only the receivers of the best rank stay, all of them if they tie, which makes the
    match heuristic. Exact protocols join on equal names, paths on their first literal and length,
    other patterns on the text before their first wildcard: each an equi-join.
    """
    f = M.MATCHERS[matcher] if isinstance(matcher, str) else matcher
    s, r = senders.select(F.col("id").alias("sender"), F.col("name").alias("s_name"), *[c for c in senders.columns if c not in ("id", "name")]), receivers.select(F.col("id").alias("receiver"), F.col("name").alias("r_name"), *[c for c in receivers.columns if c not in ("id", "name")])
    if matcher == "exact":
        pairs = s.join(r, F.col("s_name") == F.col("r_name"))
    elif matcher == "path":
        pairs = _path_blocks(s, r)
    else:
        pairs = _prefix_blocks(s, r)
    info = f(F.col("s_name"), F.col("r_name"))
    found = pairs.withColumn("info", info).where(F.col("info.ok") & (extra if extra is not None else F.lit(True)))
    found = found.withColumn("rank", M.rank(F.col("info")))
    if fan_out:
        return found.withColumn("confidence", M.confidence(F.col("info"), F.lit(False)))
    by = Window.partitionBy("sender")
    best = found.withColumn("_top", F.max("rank").over(by)).where("rank = _top").withColumn("ties", F.count(F.lit(1)).over(by))
    return best.withColumn("confidence", M.confidence(F.col("info"), F.col("ties") > 1)).drop("_top")


def _prefix_blocks(s: DataFrame, r: DataFrame) -> DataFrame:
    """Pairs of names that can match by a pattern: one's text before its first wildcard begins the other's."""
    literal = lambda c: F.regexp_extract(c, r"(?s)^([^*?#+>\[{]*)", 1)
    left, right = s.withColumn("_p", literal(F.col("s_name"))).withColumn("_h", F.col("s_name").contains("{")), r.withColumn("_p", literal(F.col("r_name")))
    plain = right.select(F.collect_set(F.length("_p")).alias("_ls"))  # lengths of names: few
    lengths = plain.first()["_ls"]
    whole = F.when(F.col("_h"), F.col("_p")).otherwise(F.col("s_name"))
    keyed = left.withColumn("_w", whole).withColumn("_l", F.explode(F.filter(F.array(*(F.lit(n) for n in sorted(lengths))) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("_w"))))
    down = keyed.withColumn("_k", F.expr("substring(_w, 1, _l)")).join(right.withColumn("_l", F.length("_p")).withColumnRenamed("_p", "_k"), ["_l", "_k"]).drop("_p", "_h", "_w", "_l", "_k")
    holes = left.where("_h").withColumn("_l", F.length("_p"))
    shorter = holes.select(F.collect_set("_l").alias("_ls")).first()["_ls"]
    if not shorter:
        return down
    longer = right.withColumn("_l", F.explode(F.filter(F.array(*(F.lit(n) for n in sorted(shorter))), lambda n: n < F.length("_p")))).withColumn("_k", F.expr("substring(_p, 1, _l)")).drop("_p")
    return down.unionByName(holes.withColumnRenamed("_p", "_k").join(longer, ["_l", "_k"]).drop("_l", "_k", "_h"))


def _path_blocks(s: DataFrame, r: DataFrame) -> DataFrame:
    """Pairs of paths that can match: equal first literals where both have one, and lengths that fit."""
    held = lambda x: x.rlike(r"\{[^{}]*\}")
    first = lambda c: F.try_element_at(M.segments(F.col(c)), F.lit(1))
    key = lambda c: F.when(first(c).isNull() | held(first(c)), F.lit("*")).otherwise(first(c))
    n = lambda c: F.size(M.segments(F.col(c)))
    open_end = F.coalesce(F.try_element_at(M.segments(F.col("r_name")), F.lit(-1)).rlike(r"\*\??\}$|\?\}$"), F.lit(False))
    left, right = s.withColumn("_n", n("s_name")).withColumn("_k", key("s_name")), r.withColumn("_m", n("r_name")).withColumn("_open", open_end).withColumn("_rk", key("r_name"))
    fits = (F.col("_n") == F.col("_m")) | F.col("_open")
    either = F.explode(F.array(F.col("_k"), F.lit("*")))
    literal = left.where("_k <> '*'").withColumn("_k", either).join(right, F.col("_k") == F.col("_rk")).where(fits)
    loose = left.where("_k = '*'")
    longest = loose.agg(F.max("_n")).first()[0]  # one number: how far an open end can reach
    if longest is None:
        return literal.drop("_n", "_k", "_m", "_open", "_rk")
    lengths = F.when(F.col("_open"), F.sequence(F.greatest(F.col("_m") - 1, F.lit(0)), F.greatest(F.col("_m"), F.lit(longest)))).otherwise(F.array("_m"))
    by_length = loose.join(right.withColumn("_l", F.explode(lengths)), F.col("_n") == F.col("_l")).drop("_l")
    return literal.unionByName(by_length).drop("_n", "_k", "_m", "_open", "_rk")


def match_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """HTTP calls (id, method, name) with the routes (id, verb, name) of equal verb and best specificity."""
    found = match_endpoints(calls, routes, "path", extra=method_ok(F.col("method"), F.col("verb")))
    return found.select("sender", "receiver", "s_name", "r_name", "confidence")


def siblings(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """a, b, parent: pairs of sources with a parent in common by the same kind, a before b."""
    up = edges.where(F.col("kind").isin(kinds)).select("src", "dst", "kind").distinct()
    return up.select(F.col("src").alias("a"), F.col("dst").alias("parent"), "kind").join(up.select(F.col("src").alias("b"), F.col("dst").alias("parent"), "kind"), ["parent", "kind"]).where("a < b").select("a", "b", "parent")


def tiered_match(left: DataFrame, right: DataFrame, tiers: list[tuple[str, Column]]) -> DataFrame:
    """a, b, tier: unique matches tier by tier; what one tier matched isn't offered to the next.

    Each tier is a key computed alike on both sides (columns id and name); a key that more than one
    row has on a side is ambiguous and matches nothing.
    """
    out = None
    for tier, key in tiers:
        one = lambda df, name, key=key: df.withColumn("_key", key).groupBy("_key").agg(F.min("id").alias(name), F.count(F.lit(1)).alias("_n")).where("_n = 1 and _key is not null").select("_key", name)
        found = one(left, "a").join(one(right, "b"), "_key").select("a", "b", F.lit(tier).alias("tier"))
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select(F.col("a").alias("id")), "id", "left_anti")
        right = right.join(found.select(F.col("b").alias("id")), "id", "left_anti")
    return out


def visited_pages(visits: DataFrame, pages: DataFrame) -> DataFrame:
    """src, page, confidence: pages (id, name: the pattern) that a test's visit (src, url) opens, the most literal of them; ties are guesses."""
    url = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*|^\{[^{}/]*\}(?=/)", ""), r"[?#].*$", "")
    path = F.when(url == "", "/").when(url.startswith("/"), url).otherwise(F.concat(F.lit("/"), url))
    asked = visits.select("src", path.alias("path")).distinct()
    calls = asked.select(F.struct("src", "path").alias("id"), F.col("path").alias("name"))
    found = match_endpoints(calls.where("name <> '/'"), pages, "path").select("sender.src", F.col("receiver").alias("page"), "confidence")
    roots = pages.where("name = '/'").select(F.col("id").alias("page"), F.col("name").alias("path"))
    ties = roots.agg(F.count(F.lit(1)).alias("n"))  # one row
    home = asked.where("path = '/'").join(roots, "path").join(F.broadcast(ties)).select("src", "page", F.when(F.col("n") == 1, "exact").otherwise("heuristic").alias("confidence"))
    exact = F.when(F.col("confidence") == "heuristic", "heuristic").otherwise("exact")
    return found.withColumn("confidence", exact).unionByName(home).distinct()


def by_import_path(jobs: DataFrame, functions: DataFrame) -> DataFrame:
    """job, function: jobs (id, name: a dotted path, with `{x}` for one part) that nothing receives, and the functions (id, name: its dotted path) of that path.

    Templates meet functions of the module before their first hole; private functions don't count.
    """
    plain = jobs.where(~F.col("name").contains("{")).select(F.col("id").alias("job"), "name").join(functions.select(F.col("id").alias("function"), "name"), "name").select("job", "function")
    module = lambda x: F.regexp_replace(x, r"\.[^.]*$", "")
    holed = jobs.where(F.col("name").contains("{") & ~module(F.col("name")).contains("{")).select(F.col("id").alias("job"), F.col("name").alias("template"), module(F.col("name")).alias("m"))
    own = functions.select(F.col("id").alias("function"), "name", module(F.col("name")).alias("m"), F.element_at(F.split("name", r"\."), -1).alias("last")).where(~F.col("last").startswith("_"))
    hole = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.element_at(F.split("template", r"\."), -1), r"([\[\]()+*?^$|\\])", r"\\$1"), r"\{[^{}]*\}", "[^.]+"), F.lit("$"))
    fits = holed.join(own, "m").where(F.regexp_like("last", hole)).select("job", "function")
    return plain.unionByName(fits)
