"""Steps whose cost follows their input: a case of each in which pairs of rows would be far too many."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from lattica.operators import aggregate as A
from lattica.operators import joins as J
from lattica.operators import reports as R
from lattica.operators import rules
from lattica.operators import traverse as G

MANY = 60_000
SECONDS = 30


def in_time(spark, work):
    found = G.within(spark, SECONDS, work)
    assert found is not None, "cut off"
    return found


def test_touched_spans_without_pairs(spark):
    n = spark.range(MANY)
    changes = n.select(F.lit("f").alias("file"), F.lit(5).alias("lo"), F.lit(9).alias("hi"))
    spans = n.select("id", F.lit("f").alias("file"), F.when(F.col("id") % 3 == 0, 9).otherwise(10).alias("start"), F.lit(20).alias("end"))
    assert in_time(spark, lambda: J.touched(changes, spans, ["file"]).count()) == MANY // 3


def test_changes_of_one_range_meet_the_spans_once(spark, monkeypatch):
    from lattica.plans import joins as P

    n = spark.range(3_000)
    changes = n.select(F.col("id").alias("event_id"), F.lit("f").alias("file"), F.lit(60).alias("lo"), (F.col("id") % 2 + 70).cast("int").alias("hi"))
    spans = spark.createDataFrame([(f"s{i}", "f", i, i + 40) for i in range(0, 200, 10)] + [("s60", "f", 71, 300), ("x", "g", 60, 70)], "id string, file string, start int, end int")
    monkeypatch.setattr(P, "changes", lambda *a: changes)
    monkeypatch.setattr(P, "spans", lambda *a: spans)
    monkeypatch.setattr(J, "IDS_A_LIST", 4, raising=False)
    found = P.changed_symbols(spark, "")
    want = J.overlapping(changes, spans, ["file"]).select("event_id", "id")
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty() and found.count() == 3_000 * 6 + 1_500
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(_ids" in plan and "collect_list(id" in plan[plan.index("Generate explode(_ids") :]


def test_pairs_of_one_range_go_to_several_tasks_a_few_at_once(spark, monkeypatch):
    n = spark.range(2_000)
    changes = n.select(F.col("id").alias("event_id"), F.lit("f").alias("file"), F.lit(60).alias("lo"), F.lit(70).alias("hi")).unionByName(spark.sql("SELECT 9999L AS event_id, 'g' AS file, 1 AS lo, 200 AS hi"))
    spans = spark.createDataFrame([(f"s{i}", "f", 50 + i, 90) for i in range(10)] + [("x", "g", 60, 70), ("y", "h", 60, 70)], "id string, file string, start int, end int")
    for name, value in (("IDS_A_LIST", 4), ("PAIRS_A_TASK", 1_000), ("PAIRS_AT_ONCE", 200)):
        monkeypatch.setattr(J, name, value, raising=False)
    found = J.overlapping_each(changes, spans, ["event_id"], ["file"])
    want = J.overlapping(changes, spans, ["file"]).select("event_id", "id")
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty() and found.count() == 20_001
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 20_001 / 2
    assert J.overlapping_each(changes, spans.where("file = 'h'"), ["event_id"], ["file"]).isEmpty()


def test_innermost_without_pairs(spark):
    n = spark.range(MANY)
    changes = n.select(F.col("id").alias("item"), F.lit("f").alias("file"), F.lit(5).alias("lo"), F.when(F.col("id") == 0, 1).otherwise(9).alias("hi"))
    spans = n.select("id", F.lit("f").alias("file"), F.when(F.col("id") % 3 == 0, 9).otherwise(8).alias("start"), F.lit(20).alias("end"))
    found = in_time(spark, lambda: J.innermost_each(changes, spans.where("id > 3"), ["item"], ["file"]).groupBy("id", "start").agg(F.count(F.lit(1)).alias("n")).collect())
    assert [tuple(r) for r in found] == [(6, 9, MANY - 1)]


def test_entries_of_equal_the_tags(spark):
    r = random.Random(5)
    rows = [(f"f{r.randrange(25)}", f"f{r.randrange(25)}") for _ in range(40)] + [(f"r{i}", f"f{r.randrange(25)}") for i in range(12)]
    edges = spark.createDataFrame(rows, "src string, dst string")
    nodes = spark.createDataFrame([(f"f{i}", "test" if i == 3 else None) for i in range(25)] + [(f"r{i}", ("route", "job")[i % 2]) for i in range(12)], "id string, entry_kind string")
    wanted = spark.createDataFrame([("f1",), ("f2",), ("f3",), ("r1",), ("f1",)], "id string")
    asked = lambda df: sorted(tuple(x) for x in df.join(wanted.withColumnRenamed("id", "node_id").distinct(), "node_id", "left_semi").select("node_id", "entry_kind", "entry_count", "sample_entry").collect())
    got = asked(G.entries_of(edges, nodes, wanted))
    assert got == asked(G.tag_entries(edges, nodes)) and len(got) > 3


def test_round_trips_of_alike_sites(spark):
    n = spark.range(MANY)
    writes = n.select(F.lit("s").alias("state"), F.lit("a").alias("file"), F.lit(5).alias("line"), F.when(F.col("id") % 2 == 0, 7).otherwise(9).alias("end_line"), F.lit("clamp").alias("lossy"))
    reads = n.select(F.lit("s").alias("state"), F.lit("a").alias("file"), (F.col("id") % 3 + 6).cast("int").alias("line"), F.lit("slider").alias("seeds"))
    found = in_time(spark, lambda: R.round_trips(writes, reads).collect())
    assert [tuple(r) for r in found] == [("s", "a:5", "clamp", "a:8", "slider")]  # apart from the shorter of the two writes


def test_round_trips_of_places_that_read_alike(spark):
    writes = spark.createDataFrame([("s", "a:5", None, None, "clamp"), ("s", "a", 5, 9, "clamp")], "state string, file string, line int, end_line int, lossy string")
    reads = spark.createDataFrame([("s", "a", 7, "slider"), ("s", "b", None, "field")], "state string, file string, line int, seeds string")
    found = sorted(tuple(r) for r in R.round_trips(writes, reads).collect())
    assert found == [("s", "a:5", "clamp", "a:7", "slider"), ("s", "a:5", "clamp", "b", "field")]


def test_forbidden_walks_from_the_fewer_ends(spark, monkeypatch):
    edges = spark.createDataFrame([(f"f{i}", f"f{i + 1}", "CALLS", 3) for i in range(6)], "src string, dst string, kind string, conf_rank int")
    groups = []
    walk = R.group_closures
    monkeypatch.setattr(R, "group_closures", lambda e, t, **k: groups.append(t.select("grp").distinct().count()) or walk(e, t, **k))
    for flip in (False, True):
        rows = [(f"r{i}", "path", *((f"f{i}", "f4") if not flip else ("f4", f"f{i}")), None) for i in range(7)]
        got = {r["rule"]: r["present"] for r in R.forbidden(edges, spark.createDataFrame(rows, "rule string, type string, src string, dst string, edge_kind string")).collect()}
        assert got == {f"r{i}": i >= 4 if flip else i <= 4 for i in range(7)}
    assert groups == [1, 1]


def test_suffixes_meet_by_equal_segments(spark):
    n = spark.range(MANY)
    calls = n.select("id", F.concat(F.lit("/orders/x"), "id").alias("name"))
    routes = n.select("id", F.concat(F.lit("/api/v2/orders/x"), "id").alias("name"))
    assert in_time(spark, lambda: rules.suffix_match(calls, routes).where("sender = receiver").count()) == MANY


def test_suffixes_with_parameters_on_either_side(spark):
    names = ["/orders/7", "/orders/{id}", "/orders/v{n}", "/orders/v3", "/{x}/7", "/{x}/{y}", "/orders/7/lines", "/items/7"]
    calls = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    routes = spark.createDataFrame([(i, f"/api{x}") for i, x in enumerate(names)], "id int, name string")
    m = rules.match_path(F.col("s"), F.col("t"))
    every = calls.select(F.col("id").alias("a"), F.col("name").alias("s")).crossJoin(calls.select(F.col("id").alias("b"), F.col("name").alias("t"))).where(m["ok"] & (m["lit"] > 0) & (F.size(rules.segments(F.col("s"))) == F.size(rules.segments(F.col("t")))))
    assert {tuple(r) for r in rules.suffix_match(calls, routes).collect()} == {(r["a"], r["b"]) for r in every.collect()}


def test_first_clients_without_pairs(spark):
    n = spark.range(MANY)
    matched = n.select(F.lit("call").alias("src"), F.concat(F.lit("route"), F.col("id") % 2).alias("dst"), F.lit("MATCHES_ROUTE").alias("kind"))
    callers = n.select(F.concat(F.lit("c"), F.col("id") + 100_000).alias("src"), F.lit("call").alias("dst"), F.lit("HTTP_CALLS").alias("kind"))
    found = in_time(spark, lambda: R.route_clients(matched.unionByName(callers)).collect())
    assert sorted(tuple(r) for r in found) == [(f"route{k}", f"c{100_000 + i}", i + 1) for k in (0, 1) for i in range(3)]


def test_distinct_beyond_counts_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_BITS", 2)
    r = random.Random(9)
    calls = {(f"r{r.randrange(20)}", f"f{r.randrange(15)}") for _ in range(60)}
    uses = {(f"f{r.randrange(12)}", f"t{r.randrange(30)}") for _ in range(90)}
    want = {}
    for a, f in calls:
        want.setdefault(a, set()).update(t for g, t in uses if g == f)
    found = A.distinct_beyond(spark.createDataFrame(sorted(calls), "id string, fn string"), spark.createDataFrame(sorted(uses), "fn string, to string"))
    assert {x["id"]: x["n"] for x in found.collect()} == {a: len(t) for a, t in want.items() if t}


def test_graph_is_distinct_before_it_is_text(spark):
    """No shuffle of the derived edges holds text of ends: each moves numbers, and none follows the union."""
    from lattica.sources import fixture

    plan = fixture.derive_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "hashpartitioning(src" not in fixture.derive_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Union")]


def plans_of(monkeypatch, module):
    """Physical plans of the tables that a module writes, by name."""
    plans = {}
    write = module.cut
    monkeypatch.setattr(module, "cut", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and write(df, name))
    return plans


def test_distinct_edges_are_numbered_as_they_are(spark, monkeypatch):
    from lattica.operators import build
    from lattica.plans.traversal import graph_edges

    plans = plans_of(monkeypatch, build)
    assert graph_edges(spark, "/root/testdata/sf0.001").agg(F.max("id") == F.count("id")).first()[0]
    assert "hashpartitioning" not in plans["numbered"]


def test_steps_of_a_closure_are_not_shuffled(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("x", "c", 1)], "src string, dst string, line int")
    plans = plans_of(monkeypatch, G)
    found = G.reverse_closure(edges, spark.createDataFrame([("c",)], "id string")).collect()
    assert sorted(tuple(r) for r in found) == [("a", 2), ("b", 1), ("c", 0), ("x", 1)]
    assert "Exchange" not in plans["steps"]


def test_co_callers_make_only_shared_targets_distinct(spark):
    rows = [("a", "t1", "READS_TABLE"), ("a", "t2", "READS_TABLE"), ("b", "t1", "READS_TABLE"), ("b", "t1", "WRITES_TABLE"), ("c", "t3", "READS_TABLE"), ("d", "t2", "READS_TABLE"), ("d", "t1", "READS_TABLE")]
    found = A.co_callers(spark.createDataFrame(rows, "src string, dst string, kind string"), spark.createDataFrame([("a",)], "id string"), ["READS_TABLE", "WRITES_TABLE"])
    assert [tuple(r) for r in found.collect()] == [("d", 2, 1.0), ("b", 1, 0.5)]
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    semi = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
    pairs = [i for i, line in enumerate(lines) if re.search(r"Aggregate \[(src|dst)#\d+, (src|dst)#\d+\]", line)]
    assert pairs and all(i < semi for i in pairs)  # the pairs are made distinct above the semi join, not below


def test_groups_that_move_together_move_in_one_row(spark, monkeypatch):
    rows = []
    write = G.cut
    monkeypatch.setattr(G, "cut", lambda df, name: (rows.append((name, (out := write(df, name)).count())), out)[1])
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("x", "b"), ("c", "c")], "src string, dst string")
    targets = spark.createDataFrame([("c", i) for i in range(130)] + [("x", 7)], "id string, grp int")
    found = sorted(tuple(r) for r in G.group_closures(edges, targets).collect())
    assert found == sorted([("c", i, 0) for i in range(130)] + [(n, i, d) for n, d in (("b", 1), ("a", 2), ("x", 2)) for i in range(130) if (n, i) != ("x", 7)] + [("x", 7, 0)])
    assert [n for name, n in rows if name == "level"] == [4, 3, 6, 0]  # 130 groups are three rows a node


def test_steps_near_few_nodes_are_found_by_numbers(spark, monkeypatch):
    steps = spark.createDataFrame([(f"n{i % 500}", i) for i in range(2_000)], "at string, to int")
    ids = spark.createDataFrame([("n3",), ("n7",), ("n3",), ("none",)], "node string")
    near = G.nearby(steps, "at", ids, 4)
    assert sorted(r["at"] for r in near.collect()) == ["n3"] * 4 + ["n7"] * 4
    assert "BroadcastHashJoin [_mark" in near._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(G, "FEW", 3)
    assert G.nearby(steps, "at", ids, 4) is steps


def test_pairs_are_summed_where_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(A, "PAIR_BLOCK", 3)  # more items of a feature than one array holds
    r = random.Random(3)
    rows = sorted({(r.randrange(12), r.randrange(9)) for _ in range(70)})
    u = spark.createDataFrame(rows, "item int, feature int")
    found = A.shared_pairs(u, u, F.lit(1), 5, same=True)
    have = {i: {f for k, f in rows if k == i} for i, _ in rows}
    assert {(x["a"], x["b"]): x["sum"] for x in found.collect()} == {(a, b): len(have[a] & have[b]) for a in have for b in have if a < b and have[a] & have[b]}
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    made = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    assert not any("Exchange" in line for line in lines[:made])  # no pair moves


def test_entries_walk_over_parts_not_nodes(spark, monkeypatch):
    """A chain of cycles with tables beside them: marks are kept for each cycle, not for each of its nodes and tables."""
    rows = {"marks": 0}
    write = G.cut
    monkeypatch.setattr(G, "cut", lambda df, name: (out := write(df, name), rows.update({name: rows.get(name, 0) + out.count()}))[0])
    edges = [(f"f:{c * 10 + i}", f"f:{c * 10 + (i + 1) % 10}") for c in range(6) for i in range(10)] + [(f"f:{c * 10 + 9}", f"f:{c * 10 + 10}") for c in range(5)]
    edges += [(f"f:{c * 10 + i}", f"t:{c}") for c in range(6) for i in range(3)] + [(f"r:{c}", f"f:{c * 10 + 4}") for c in range(6)]
    nodes = spark.createDataFrame([(f"r:{c}", "route") for c in range(6)] + [("f:1", None)], "id string, entry_kind string")
    found = {r["node_id"]: (r["entry_count"], r["sample_entry"]) for r in G.tag_entries(spark.createDataFrame(edges, "src string, dst string"), nodes).collect()}
    assert found == {f"f:{k}": (k // 10 + 1, "r:0") for k in range(60)} | {f"t:{c}": (c + 1, "r:0") for c in range(6)} | {f"r:{c}": (1, f"r:{c}") for c in range(6)}
    assert 0 < rows["marks"] <= 24
