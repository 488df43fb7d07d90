"""Reports over attributed facts: access, channels, bridges, round trips, competing writers, plans and empty answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.model import CONFIDENCE, PROPAGATING
from lattica.operators.rules import is_auth_guard, public_reason
from lattica.operators.traverse import forward_closure, group_closures, walkable
from lattica.storage import cut


def access(edges: DataFrame, targets: DataFrame, writers: bool = False) -> DataFrame:
    """target, grp, src, at_column, file, line: who reads or writes target tables, columns and properties (id).

    Groups: `table` sites of the table itself, `column` sites of a column, `mentions` texts that name a column, and,
    for a written column, `table_level` writes of its table by functions that record no column of it.
    """
    kind = F.substring_index("id", ":", 1)
    wanted = targets.select("id", kind.alias("k")).distinct()
    sites = edges.select("src", "dst", "kind", "file", "line")
    table_of = F.concat(F.lit("table:"), F.regexp_extract("dst", r"^column:(.*)\.[^.]*$", 1))
    column = wanted.where("k = 'column'").select(F.col("id").alias("dst"))
    table = wanted.where("k = 'table'").select(F.col("id").alias("target"))
    prop = wanted.where("k IN ('property', 'field')").select(F.col("id").alias("dst"))
    shaped = lambda df, target, grp: df.select(target.alias("target"), F.lit(grp).alias("grp"), "src", F.when(F.col("dst").startswith("column:"), F.col("dst")).alias("at_column"), "file", "line")
    of = lambda *kinds: sites.where(F.col("kind").isin(*kinds))
    by_column = of("WRITES_COLUMN" if writers else "READS_COLUMN")
    out = shaped(by_column.join(column, "dst", "left_semi"), F.col("dst"), "column")
    out = out.unionByName(shaped(of("WRITES_PROP" if writers else "READS_PROP").join(prop, "dst", "left_semi"), F.col("dst"), "property"))
    out = out.unionByName(shaped(of("WRITES_TABLE" if writers else "READS_TABLE").join(table.withColumnRenamed("target", "dst"), "dst", "left_semi"), F.col("dst"), "table"))
    inside = by_column.withColumn("target", table_of).join(table, "target", "left_semi")
    out = out.unionByName(shaped(inside, F.col("target"), "table" if writers else "column"))
    if writers:
        named = by_column.select("src", table_of.alias("t")).distinct()
        whole = of("WRITES_TABLE").withColumn("t", F.col("dst")).join(named, ["src", "t"], "left_anti")
        asked = column.select(F.col("dst").alias("target"), F.concat(F.lit("table:"), F.regexp_extract("dst", r"^column:(.*)\.[^.]*$", 1)).alias("t"))
        return out.unionByName(shaped(whole.join(asked, "t"), F.col("target"), "table_level"))
    said = of("MENTIONS_COLUMN")
    return out.unionByName(shaped(said.join(column, "dst", "left_semi"), F.col("dst"), "mentions")).unionByName(shaped(said.withColumn("target", table_of).join(table, "target", "left_semi"), F.col("target"), "mentions"))


def default_argument_callers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """src, dst, file, line, param: calls out of default arguments, which no walk follows."""
    param = F.get_json_object("attrs", "$.default_arg")
    return edges.where((F.col("kind") == "CALLS") & param.isNotNull()).join(targets.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", "file", "line", param.alias("param"))


def channels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, declared, routes, publishers, subscribers, flags of every channel (nodes of kind channel with declared, visibility)."""
    count = lambda kind, by, name, extra=(): edges.where(F.col("kind") == kind).groupBy(F.col(by).alias("id")).agg(F.count_distinct("src").alias(name), *extra)
    public = F.count_distinct(F.when(F.get_json_object("attrs", "$.visibility") == "public", F.col("src"))).alias("public")
    own = nodes.where("kind = 'channel'").select("id", "declared", "visibility")
    any_sub = nodes.agg(F.coalesce(F.bool_or(F.col("kind") == "channel_sub"), F.lit(False)).alias("_client"))  # one row
    found = own.join(count("AUTHORIZES_CHANNEL", "dst", "routes"), "id", "left").join(count("BROADCASTS_ON", "dst", "publishers", (public,)), "id", "left").join(count("MATCHES_CHANNEL", "dst", "subscribers"), "id", "left").join(F.broadcast(any_sub))
    numbers = {c: F.coalesce(c, F.lit(0)) for c in ("routes", "publishers", "public", "subscribers")}
    found = found.withColumns(numbers)
    flags = F.array_compact(F.array(
        F.when(~F.col("declared") & (F.coalesce("visibility", F.lit("private")) != "public"), "undeclared"),
        F.when(F.col("declared") & (F.col("public") > 0), "public publish"),
        F.when(F.col("declared") & (F.col("routes") == 0), "no auth route"),
        F.when(F.col("publishers") == 0, "no publisher"),
        F.when(F.col("_client") & (F.col("subscribers") == 0), "no subscriber"),
    ))
    return found.select("id", "declared", "routes", "publishers", "subscribers", flags.alias("flags"))


def orphan_subscriptions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id of client subscriptions that no channel matches."""
    return nodes.where("kind = 'channel_sub'").select("id").join(edges.where("kind = 'MATCHES_CHANNEL'").select(F.col("src").alias("id")), "id", "left_anti")


def bridges(nodes: DataFrame, edges: DataFrame, platforms: list[str]) -> DataFrame:
    """id, protocol, senders, test_senders, receivers, received_on, missing_on, checks of every bridge endpoint.

    A side is missed only where the other one is there; a platform only where another one has a receiver.
    """
    own = nodes.where("kind = 'endpoint'").select("id", "protocol")
    sent = edges.where(F.col("kind").isin("SENDS_TO", "TEST_CALLS")).groupBy(F.col("dst").alias("id")).agg(F.count_distinct(F.when(F.col("kind") == "SENDS_TO", F.col("src"))).alias("senders"), F.count_distinct(F.when(F.col("kind") == "TEST_CALLS", F.col("src"))).alias("test_senders"))
    got = edges.where("kind = 'RECEIVED_BY'").groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("receivers"), F.array_sort(F.collect_set(F.get_json_object("attrs", "$.platform"))).alias("received_on"))
    found = own.join(sent, "id", "left").join(got, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("senders", "test_senders", "receivers")}).withColumn("received_on", F.coalesce("received_on", F.array().cast("array<string>")))
    missing = F.when(F.size("received_on") > 0, F.array_sort(F.array_except(F.array(*(F.lit(p) for p in platforms)), "received_on"))).otherwise(F.array().cast("array<string>"))
    found = found.withColumn("missing_on", missing)
    checks = F.array_compact(F.array(F.when((F.col("senders") > 0) & (F.col("receivers") == 0), "no_receiver"), F.when((F.col("receivers") > 0) & (F.col("senders") == 0), F.when(F.col("test_senders") > 0, "test_sender_only").otherwise("no_sender")), F.when(F.size("missing_on") > 0, "missing_on")))
    return found.withColumn("checks", checks)


def round_trips(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """state, write_at, lossy, read_at, seeds: a lossy write of a property and a read elsewhere that fills the interface from it.

    writes: state, file, line, end_line, lossy; reads: state, file, line, seeds. A read within the write's own lines is no read back.
    Sites that are alike in the result meet once, with the places behind them (of one place the shortest write says most), so no pair comes twice.
    """
    at = F.concat_ws(":", "file", F.col("line").cast("string"))
    ends = writes.where("lossy is not null").groupBy("state", "file", "line", "lossy").agg(F.min(F.coalesce("end_line", "line")).alias("end"))
    lossy = ends.groupBy("state", at.alias("write_at"), "lossy").agg(F.collect_list(F.struct("file", "line", "end")).alias("ws"))
    seeds = reads.where("seeds is not null").groupBy("state", at.alias("read_at"), "seeds").agg(F.collect_set(F.struct("file", "line")).alias("rs"))
    apart = lambda w, r: ~(w["file"].eqNullSafe(r["file"]) & r["line"].between(w["line"], w["end"]))
    any_apart = F.exists("ws", lambda w: F.exists("rs", lambda r: apart(w, r)))
    one = (F.size("ws") == 1) & (F.size("rs") == 1)
    fits = F.when(one, apart(F.col("ws")[0], F.col("rs")[0])).otherwise(any_apart)
    return lossy.join(seeds, "state").where(fits).select("state", "write_at", "lossy", "read_at", "seeds")


def competing_writers(writes: DataFrame) -> DataFrame:
    """state, lifecycle, later: state that a lifecycle hook and an asynchronous callback both set to real values.

    writes: state, src, how (lifecycle, async or other), value, resets. Resets to a constant don't compete, nor do
    an asynchronous write of an expression that the hook writes, too, or one that derives from the state itself.
    """
    real = writes.where(~F.coalesce("resets", F.lit(False)))
    hooks = real.where("how = 'lifecycle'")
    short = F.regexp_extract("state", r"([^.#]+)$", 1)
    later = real.where("how = 'async'").where(~F.coalesce(F.array_contains(F.regexp_extract_all("value", F.lit(r"([\w$]+)")), short), F.lit(False)))
    later = later.join(hooks.select("state", "value").distinct(), ["state", "value"], "left_anti")
    count = lambda df, name: df.groupBy("state").agg(F.count_distinct("src").alias(name))
    return count(hooks, "lifecycle").join(count(later, "later"), "state")


def forbidden(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, present: whether what a plan forbids is there. rules: rule, type (edge or path), src, dst, edge_kind.

    All paths walk together. A group is an end, not a rule: the walk starts from the side that has fewer ends.
    """
    direct = rules.where("type = 'edge'").join(edges.select("src", "dst", F.col("kind").alias("edge_kind")).distinct(), ["src", "dst", "edge_kind"], "left_semi").select("rule")
    paths = rules.where("type = 'path'")
    ends = paths.agg(F.count_distinct("src").alias("src"), F.count_distinct("dst").alias("dst")).first()  # two numbers
    start, goal = ("src", "dst") if ends["src"] <= ends["dst"] else ("dst", "src")
    groups = paths.select(F.col(start).alias("id"), F.col(start).alias("grp")).distinct()
    reach = group_closures(walkable(edges), groups, reverse=start == "dst")
    through = paths.join(reach.select(F.col("grp").alias(start), F.col("id").alias(goal)), [start, goal], "left_semi").select("rule")
    there = direct.unionByName(through).distinct().withColumn("present", F.lit(True))
    return rules.select("rule").distinct().join(there, "rule", "left").select("rule", F.coalesce("present", F.lit(False)).alias("present"))


def verified(nodes: DataFrame, edges: DataFrame, planned_nodes: DataFrame, planned_edges: DataFrame) -> DataFrame:
    """what, key, state: planned nodes (id) and edges (src, dst, kind) that are there, or missing; an edge of another kind says so."""
    n = planned_nodes.select("id").distinct().join(nodes.select("id", F.lit(True).alias("here")).distinct(), "id", "left")
    of_nodes = n.select(F.lit("node").alias("what"), F.col("id").alias("key"), F.when(F.col("here"), "present").otherwise("missing").alias("state"))
    held = edges.groupBy("src", "dst").agg(F.collect_set("kind").alias("kinds"))
    e = planned_edges.select("src", "dst", "kind").distinct().join(held, ["src", "dst"], "left")
    state = F.when(F.array_contains("kinds", F.col("kind")), "present").when(F.col("kinds").isNotNull(), "other kind").otherwise("missing")
    return of_nodes.unionByName(e.select(F.lit("edge").alias("what"), F.concat_ws(" ", "src", "kind", "dst").alias("key"), state.alias("state")))


def baseline(spans: DataFrame) -> DataFrame:
    """id, mark: a digest of each symbol's text, by which a plan sees that it changed since."""
    return spans.select("id", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("mark"))


def changed_since(spans: DataFrame, before: DataFrame) -> DataFrame:
    """id, state of the symbols of a baseline: same, changed or gone."""
    return before.select("id", F.col("mark").alias("was")).join(baseline(spans), "id", "left").select("id", F.when(F.col("mark").isNull(), "gone").when(F.col("mark") == F.col("was"), "same").otherwise("changed").alias("state"))


def no_callers(nodes: DataFrame, edges: DataFrame, targets: DataFrame, min_conf: str = "heuristic") -> DataFrame:
    """id, reason, n of targets (id) without callers: no such node, below the confidence, an entry itself, used by tests alone, other edges alone, or nothing."""
    into = edges.groupBy(F.col("dst").alias("id")).agg(
        F.count_if(F.col("kind").isin(PROPAGATING) & (F.col("conf_rank") >= CONFIDENCE[min_conf])).alias("callers"),
        F.count_if(F.col("kind").isin(PROPAGATING) & (F.col("conf_rank") < CONFIDENCE[min_conf])).alias("low"),
        F.count_if(F.col("kind").startswith("TEST_")).alias("tests"),
        F.count(F.lit(1)).alias("every"),
    )
    found = targets.select("id").distinct().join(nodes.select("id", "entry_kind", F.lit(True).alias("here")), "id", "left").join(into, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("callers", "low", "tests", "every")})
    reason = F.when(F.col("here").isNull(), "unknown").when(F.col("low") > 0, "below confidence").when(F.col("entry_kind").isNotNull(), "entry point").when(F.col("tests") > 0, "tests only").when(F.col("every") > 0, "other edges").otherwise("unused")
    n = F.when(reason == "below confidence", F.col("low")).when(reason == "tests only", F.col("tests")).otherwise(F.col("every"))
    return found.where("callers = 0").select("id", reason.alias("reason"), n.alias("n"))


def budgeted(items: DataFrame, group: str, order: Column, size: str, budget: int) -> DataFrame:
    """Items that fit a budget of tokens: in order, each that still has room is taken, one that hasn't is left out and the next tried.

    A round takes the items up to the first that has no room; all that are larger than what is then left can never
    be taken and fall away at once. Each round takes one item of a group at least, so as many rounds as items fit are enough; few are needed.
    """
    ranked = cut(items.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order))), "budget-items")
    left = ranked.select(group, "place", F.col(size).cast("long").alias("n"), F.lit(0).cast("long").alias("used"))
    taken = None
    while True:
        room = left.where(F.col("used") + F.col("n") <= budget).withColumn("sum", F.col("used") + F.sum("n").over(Window.partitionBy(group).orderBy("place")))
        # places behind the first one without room wait for the next round
        full = room.withColumn("stop", F.min(F.when(F.col("sum") > budget, F.col("place"))).over(Window.partitionBy(group)))
        now = cut(full.select(group, "place", "n", "sum", (F.col("stop").isNull() | (F.col("place") < F.col("stop"))).alias("fits")), "budget-round")
        fits = now.where("fits").select(group, "place")
        taken = fits if taken is None else taken.unionByName(fits)
        used = now.where("fits").groupBy(group).agg(F.max("sum").alias("used"))
        left = now.where("not fits").select(group, "place", "n").join(used, group)
        if now.where("not fits").isEmpty():
            return ranked.join(taken, [group, "place"])


def route_clients(edges: DataFrame, limit: int = 3) -> DataFrame:
    """route, client, place: the first callers of each route through the calls that match it; a short list.

    A route's first callers are among the first of each of its calls, so only those meet.
    """
    matched = edges.where("kind = 'MATCHES_ROUTE'").select(F.col("src").alias("call"), F.col("dst").alias("route")).distinct()
    callers = edges.where("kind = 'HTTP_CALLS'").select(F.col("src").alias("client"), F.col("dst").alias("call")).distinct()
    first = callers.withColumn("_n", F.row_number().over(Window.partitionBy("call").orderBy("client"))).where(F.col("_n") <= limit).drop("_n")
    pairs = matched.join(first, "call").select("route", "client").distinct()
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("route").orderBy("client"))).where(F.col("place") <= limit)


def modified_check(edges: DataFrame, modified: DataFrame, middleware: DataFrame) -> DataFrame:
    """id, issue, other: what a planned change of routes and functions (id) would miss.

    `bypass`: callers of what it calls that don't come through it; `direct`: who calls it directly; `middleware`:
    routes to the same function with other middleware (route, names).
    """
    calls = edges.where(F.col("kind").isin("CALLS", "ROUTES_TO")).select("src", "dst").distinct()
    mine = modified.select("id").distinct()
    direct = calls.join(mine.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("id"), F.lit("direct").alias("issue"), F.col("src").alias("other"))
    callee = calls.join(mine.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("callee"))
    bypass = callee.join(calls.select(F.col("src").alias("other"), F.col("dst").alias("callee")), "callee").where("other <> id").select("id", F.lit("bypass").alias("issue"), "other").distinct()
    sorted_names = middleware.select("route", F.array_sort(F.array_distinct("names")).alias("names"))
    pair = callee.join(sorted_names.withColumnRenamed("route", "id"), "id").withColumnRenamed("names", "own").join(calls.select(F.col("src").alias("other"), F.col("dst").alias("callee")), "callee").join(sorted_names.withColumnRenamed("route", "other"), "other").where((F.col("other") != F.col("id")) & (F.col("own") != F.col("names")))
    return direct.unionByName(bypass).unionByName(pair.select("id", F.lit("middleware").alias("issue"), "other").distinct())


def plan_coverage(edges: DataFrame, tables: DataFrame, listed: DataFrame, through: DataFrame) -> DataFrame:
    """tbl, kind, src: readers and writers of planned tables (id) that the plan neither lists (id) nor reaches from what it goes through (id)."""
    inside = forward_closure(walkable(edges), through).select("id")
    covered = listed.select("id").unionByName(inside).distinct().withColumnRenamed("id", "src")
    users = edges.where(F.col("kind").isin("READS_TABLE", "WRITES_TABLE")).join(tables.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    return users.join(covered, "src", "left_anti").select(F.col("dst").alias("tbl"), "kind", "src").distinct()


def impact_order(found: DataFrame) -> DataFrame:
    """Callers by depth and name, entry points by kind and name."""
    return found.orderBy(F.col("is_entry"), F.when(~F.col("is_entry"), F.col("depth")), F.col("entry_kind"), F.coalesce("fqn", "id"))


def tests_order(found: DataFrame) -> DataFrame:
    """Closest tests first: depth, certain before uncertain, file, line."""
    return found.orderBy("depth", F.desc("conf_rank"), "file", "line")


def routes_order(found: DataFrame) -> DataFrame:
    """Routes without a guard first, then those without a checked secret, by place and name."""
    return found.orderBy("has_auth", "secret_checked", "at", "name")


def routes(nodes: DataFrame, edges: DataFrame, guards: DataFrame) -> DataFrame:
    """id, entry_kind, at, guards, has_auth, public, tables, reaches_write, state of every route.

    guards: route, name. Tables are those that a walk from the route writes, at any depth over propagating edges, all
    routes in one walk; `state` is guarded, public, unguarded (a write is reached) or quiet.
    """
    own = nodes.where("kind = 'route'").select("id", "entry_kind", F.concat_ws(":", "file", F.col("line").cast("string")).alias("at"), F.element_at(F.split("name", " "), -1).alias("path"))
    named = guards.groupBy(F.col("route").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("guards"), F.max(is_auth_guard(F.col("name"))).alias("has_auth"))
    used = walkable(edges)
    writes = edges.where(F.col("kind").isin("WRITES_TABLE", "WRITES_COLUMN")).select("src", F.when(F.col("kind") == "WRITES_COLUMN", F.concat(F.lit("table:"), F.regexp_extract("dst", r"^column:(.*)\.[^.]*$", 1))).otherwise(F.col("dst")).alias("tbl")).distinct()
    written = group_closures(used, writes.select(F.col("src").alias("id"), F.col("tbl").alias("grp")).distinct())
    reached = written.where(F.col("id").startswith("route:")).groupBy("id").agg(F.count_distinct("grp").alias("tables"))
    found = own.join(named, "id", "left").join(reached, "id", "left")
    found = found.withColumns({"has_auth": F.coalesce("has_auth", F.lit(False)), "tables": F.coalesce("tables", F.lit(0)), "public": public_reason(F.col("path"))})
    state = F.when(F.col("has_auth"), "guarded").when(F.col("public").isNotNull(), "public").when(F.col("tables") > 0, "unguarded").otherwise("quiet")
    return found.select("id", "entry_kind", "at", "guards", "has_auth", "public", "tables", (F.col("tables") > 0).alias("reaches_write"), state.alias("state"))
