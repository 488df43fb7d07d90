"""Traversals against plain searches on seeded random graphs with cycles."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lattica.operators import build
from lattica.operators import traverse as G

CONF = {"exact": 3, "resolved": 2, "heuristic": 1}


def graph(seed, n=40):
    r = random.Random(seed)
    edges = []
    for i in range(n):
        for _ in range(r.randint(1, 3)):
            c = r.choice(list(CONF))
            edges.append((f"function:{i}", f"function:{r.randrange(n)}", "CALLS", "f.py", r.randint(1, 9), c, CONF[c], r.choice([None, None, None, "flag_off"])))
        if r.random() < 0.3:
            edges.append((f"function:{i}", f"table:{r.randrange(6)}", "WRITES_TABLE", "f.py", 1, "exact", 3, None))
    return edges


def frame(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, kind string, file string, line int, confidence string, conf_rank int, gate string")


def search(edges, starts, back=True):
    near = {}
    for e in edges:
        a, b = (e[1], e[0]) if back else (e[0], e[1])
        near.setdefault(a, set()).add(b)
    depth = dict.fromkeys(starts, 0)
    todo = deque(starts)
    while todo:
        x = todo.popleft()
        for y in near.get(x, ()):
            if y not in depth:
                depth[y] = depth[x] + 1
                todo.append(y)
    return depth


@pytest.mark.parametrize("seed,conf,gate", [(1, "heuristic", None), (7, "resolved", "flag_off"), (23, "exact", "flag_off")])
def test_closures_equal_a_search(spark, seed, conf, gate):
    rows = graph(seed)
    used = [e for e in rows if CONF[e[5]] >= CONF[conf] and (gate is None or e[7] != gate)]
    edges = G.walkable(frame(spark, rows), None, conf, gate)
    targets = spark.createDataFrame([(f"table:{t}",) for t in range(6)], "id string")
    got = {r["id"]: r["depth"] for r in G.reverse_closure(edges, targets).collect()}
    assert got == search(used, [f"table:{t}" for t in range(6)])
    groups = spark.createDataFrame([(f"table:{t}", t) for t in range(6)], "id string, grp int")
    many = {(r["id"], r["grp"]): r["depth"] for r in G.group_closures(edges, groups).collect()}
    assert many == {(k, t): d for t in range(6) for k, d in search(used, [f"table:{t}"]).items()}
    ahead = {r["id"]: r["depth"] for r in G.forward_closure(edges, spark.createDataFrame([("function:0",)], "id string")).collect()}
    assert ahead == search(used, ["function:0"], back=False)


def test_paths_are_valid_and_the_same_at_any_partitions(spark):
    rows = graph(5)
    targets = spark.createDataFrame([("table:1",)], "id string")
    seen = []
    for parts in (1, 7):
        edges = frame(spark, rows).repartition(parts)
        paths = G.shortest_paths(edges, G.reverse_closure(edges, targets))
        seen.append({r["id"]: (r["depth"], tuple((h["from"], h["kind"], h["to"], h["confidence"]) for h in r["path"]), r["conf_rank"]) for r in paths.collect()})
    assert seen[0] == seen[1]
    known = {(e[0], e[2], e[1], e[5]) for e in rows}
    for node, (depth, path, rank) in seen[0].items():
        assert len(path) == depth and all(h in known for h in path)
        assert rank == min([CONF[h[3]] for h in path], default=3)
        if path:
            assert path[0][0] == node and path[-1][2] == "table:1"


def test_path_between_and_none(spark):
    edges = frame(spark, [("a", "b", "CALLS", None, None, "exact", 3, None), ("b", "c", "CALLS", None, None, "exact", 3, None), ("c", "a", "CALLS", None, None, "exact", 3, None), ("a", "c", "CALLS", None, None, "heuristic", 1, None)])
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    (row,) = G.path_between(edges, one("a"), one("c")).collect()
    assert row["depth"] == 1 and row["path"][0]["confidence"] == "heuristic"
    assert G.path_between(edges, one("a"), one("zz")).collect() == []
    assert G.path_between(edges, one("a"), one("a")).first()["depth"] == 0


def test_entries_impact_and_dispatch(spark):
    edges = frame(spark, [("route:1", "f", "ROUTES_TO", None, None, "exact", 3, None), ("f", "g", "OVERRIDDEN_BY", None, None, "exact", 3, None), ("g", "table:1", "WRITES_TABLE", None, None, "heuristic", 1, "off")])
    nodes = spark.createDataFrame([("route:1", "route", "http_route"), ("f", "function", None), ("g", "function", None), ("table:1", "table", None)], "id string, kind string, entry_kind string")
    tags = {(r["node_id"], r["entry_kind"]): (r["entry_count"], r["sample_entry"]) for r in G.tag_entries(edges, nodes).collect()}
    assert tags == {(k, "http_route"): (1, "route:1") for k in ("route:1", "f", "g", "table:1")}
    target = spark.createDataFrame([("table:1",)], "id string")
    (found,) = G.reaches(nodes, edges, target, "off").collect()
    assert (found["status"], found["class"], found["depth"], found["conf_rank"]) == ("gated", "runtime", 3, 1)
    assert {r["id"]: r["candidate"] for r in G.impact(nodes, edges, target, "table").collect()} == {"g": True, "f": True, "route:1": True}
    down = G.downstream(edges, spark.createDataFrame([("route:1",)], "id string"), ["WRITES_TABLE"], "off").collect()
    assert [(r["id"], r["flags"], r["depth"], r["live"]) for r in down] == [("table:1", 5, 3, False)]
    assert {r["id"] for r in G.only_by_dispatch(edges, spark.createDataFrame([("g",)], "id string")).collect()} == {"f", "route:1"}


@pytest.mark.parametrize("few", [G.FEW, 0])
def test_reaches_walks_once_over_numbers(spark, monkeypatch, few):
    rows = graph(11) + [(f"route:{i}", f"function:{i % 9}", "ROUTES_TO", "f.py", i, "exact", 3, "flag_off" if i % 4 == 0 else None) for i in range(12)] + [("route:7", "table:2", "READS_TABLE", None, None, "exact", 3, "flag_off")]
    entries = {f"route:{i}": "http_route" for i in range(12)} | {"table:2": "test", "alone": "test"}
    nodes = spark.createDataFrame(list(entries.items()), "id string, entry_kind string")
    walks, numbers, levels, number = [], [], G._levels, G._number
    monkeypatch.setattr(G, "_levels", lambda steps, *a: walks.append(dict(steps.dtypes)) or levels(steps, *a))
    monkeypatch.setattr(G, "_number", lambda c, seed: numbers.append(seed) or (number(c, seed) if seed else F.length(c).cast("long")))
    monkeypatch.setattr(G, "FEW", few)
    found = {r["id"]: (r["depth"], r["status"], len(r["path"])) for r in G.reaches(nodes, frame(spark, rows), spark.createDataFrame([("table:2",), ("table:2",)], "id string"), "flag_off").collect()}
    near, live = search(rows, ["table:2"]), search([e for e in rows if e[7] != "flag_off"], ["table:2"])
    assert found == {k: (near[k], "live" if k in live else "gated", near[k]) for k in entries if k in near} and len({s for _, s, _ in found.values()}) == 2
    assert set(numbers) == {0, 1}  # ids of one length had one number
    assert len(walks) == 2 and all(w["at"] == w["to"] == "bigint" for w in walks)
    cut_off = {r["id"]: r["status"] for r in G.reaches(nodes, frame(spark, rows), spark.createDataFrame([("table:2",)], "id string"), "flag_off", max_depth=2).collect()}
    assert cut_off == {k: "live" if live.get(k, 9) <= 2 else "gated" for k in entries if near.get(k, 9) <= 2}


def test_building_a_graph(spark):
    rows = [("a", "b", "CALLS", "f", 1, "heuristic", 1, None), ("a", "b", "CALLS", "f", 1, "exact", 3, None), ("a", "a", "CALLS", "f", 2, "exact", 3, None), ("a", "b", "CALLS", "f", 1, "exact", 3, "g"), ("x:y", "b", "CALLS", None, None, "exact", 3, None)]
    got = build.with_edge_ids(frame(spark, rows)).orderBy("id").collect()
    assert [(r["id"], r["src"], r["gate"], r["confidence"]) for r in got] == [(1, "a", None, "exact"), (2, "a", "g", "exact"), (3, "x:y", None, "exact")]
    nodes = spark.createDataFrame([("a", None, '{"x": "1", "y": "1"}', 1), ("a", "name", '{"x": "2"}', 2), ("a", "later", None, 3)], "id string, name string, attrs string, n int")
    (merged,) = build.merge_nodes(nodes, "n").collect()
    assert merged["name"] == "name" and '"x":"2"' in merged["attrs"] and '"y":"1"' in merged["attrs"]
    missing = {r["id"]: r["kind"] for r in build.placeholders(nodes.select("id"), frame(spark, rows)).collect()}
    assert missing == {"b": "b", "x:y": "x"}
    left = (spark.createDataFrame([("a",), ("b",)], "id string"), frame(spark, rows[:1]))
    right = (spark.createDataFrame([("a",), ("c",)], "id string"), frame(spark, [("c", "a", "CALLS", None, None, "exact", 3, None)]))
    n, e = build.union_graphs({"l": left, "r": right})
    assert {r["id"] for r in n.collect()} == {"a", "b", "c", "r:a"}
    assert {(r["src"], r["dst"]) for r in e.collect()} == {("a", "b"), ("c", "r:a")}


def test_receivers_narrow_overrides(spark):
    schema = "src string, dst string, kind string, conf_rank int, gate string, on_this boolean, recv array<string>"
    rows = [
        ("main", "A.run", "CALLS", 3, None, False, ["B"]), ("A.run", "A.step", "CALLS", 3, None, True, None),
        ("A.step", "B.step", "OVERRIDDEN_BY", 3, None, None, None), ("A.step", "C.step", "OVERRIDDEN_BY", 3, None, None, None),
        ("B.step", "A.other", "CALLS", 3, None, False, None), ("A.other", "C.other", "OVERRIDDEN_BY", 3, None, None, None),
        ("B", "A", "EXTENDS", 3, None, None, None), ("C", "A", "EXTENDS", 3, None, None, None),
    ]
    edges = spark.createDataFrame(rows, schema)
    classes = spark.createDataFrame([("A",), ("B",), ("C",)], "id string")
    pairs = G.class_pairs(edges, classes)
    assert {(r["cls"], r["sub"]) for r in pairs.collect()} == {("A", "A"), ("A", "B"), ("A", "C"), ("B", "B"), ("C", "C")}
    owned = spark.createDataFrame([(m, m[0]) for m in ("A.run", "A.step", "B.step", "C.step", "A.other", "C.other")], "id string, cls string")
    calls = edges.where("kind <> 'EXTENDS'")
    got = {r["id"]: r["depth"] for r in G.receiver_walk(calls, spark.createDataFrame([("main",)], "id string"), owned, pairs).collect()}
    assert got == {"main": 0, "A.run": 1, "A.step": 2, "B.step": 3, "A.other": 4, "C.other": 5}


def test_scoped_entries_deepest_and_deadline(spark):
    import time

    edges = frame(spark, [("r1", "f", "ROUTES_TO", None, None, "exact", 3, None), ("f", "table:1", "WRITES_TABLE", None, None, "exact", 3, None), ("r2", "g", "ROUTES_TO", None, None, "exact", 3, None)])
    nodes = spark.createDataFrame([("r1", "http_route"), ("r2", "http_route"), ("f", None), ("g", None), ("table:1", None)], "id string, entry_kind string")
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    tags = G.platform_entries(edges, nodes, G.reverse_closure(edges, one("table:1"))).collect()
    assert {(r["node_id"], r["entry_count"]) for r in tags} == {("r1", 1), ("f", 1), ("table:1", 1)}
    assert G.deepest(edges, one("r1", "r2"), one("table:1")).first()["id"] == "r1"
    assert G.within(spark, 60, lambda: edges.count()) == 3
    slow = lambda: spark.range(4, numPartitions=4).rdd.map(lambda _: time.sleep(30)).count()
    began = time.time()
    assert G.within(spark, 1, slow) is None and time.time() - began < 25
