"""Sources, scans, sinks and streams on small inputs."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lattica.operators import joins as J
from lattica.operators import scan as S
from lattica.operators import spec
from lattica.sources import graph
from lattica.streaming import refresh


def test_graph_round_trip_and_refused_publish(spark, tmp_path):
    nodes = spark.createDataFrame([("b", "k"), ("a", "k")], "id string, kind string")
    edges = spark.createDataFrame([("a", "b", "CALLS")], "src string, dst string, kind string")
    at = f"file://{tmp_path}/g"
    graph.save(nodes, edges, at, {"salt": "x", "n": 2})
    n, e = graph.load(spark, at, "dst")
    assert n.count() == 2 and e.collect() == edges.collect() and graph.meta(spark, at) == {"salt": "x", "n": 2}
    assert graph.node(spark, at, "b").count() == 1
    assert not refresh.publish({"nodes": nodes.limit(0), "meta": nodes}, at) and graph.load(spark, at)[0].count() == 2
    old = graph.load(spark, at)[0]
    graph.save(nodes.limit(1), edges, at)
    assert graph.load(spark, at)[0].count() == 1 and old.count() == 2  # who read the version before goes on reading it
    assert graph.sql(spark, at, "SELECT count(*) AS n FROM edges JOIN edge_kinds USING (kind) WHERE propagates").first()["n"] == 1


def test_a_saved_graph_is_worked_out_once(spark, tmp_path):
    runs = {name: spark.sparkContext.accumulator(0) for name in ("nodes", "edges")}

    def counted(name, n):
        return F.udf(lambda x: runs[name].add(1) or f"n{x * 7 % n}", "string").asNondeterministic()("id")

    nodes = spark.range(50).select(counted("nodes", 50).alias("id"))
    edges = spark.range(2_000).select(counted("edges", 50).alias("src"), F.concat(F.lit("n"), F.col("id") * 7 % 31).alias("dst"), F.lit("CALLS").alias("kind"))
    graph.save(nodes, edges, f"file://{tmp_path}/g")
    assert {name: n.value for name, n in runs.items()} == {"nodes": 50, "edges": 2_000}
    (n, by_src), (_, by_dst) = (graph.load(spark, f"file://{tmp_path}/g", end) for end in ("src", "dst"))
    assert n.count() == 50 and by_src.count() == 2_000 and by_src.exceptAll(by_dst).isEmpty() and by_dst.exceptAll(by_src).isEmpty()


def test_files_of_a_saved_graph_are_sorted(spark, tmp_path):
    edges = spark.range(2_000).select(F.concat(F.lit("n"), F.col("id") * 7 % 50).alias("src"), F.concat(F.lit("n"), F.col("id") * 7 % 31).alias("dst"), F.lit("CALLS").alias("kind"))
    graph.save(edges.select(F.col("src").alias("id")).distinct(), edges, f"file://{tmp_path}/g", tasks=3)
    for end in ("src", "dst"):
        files = graph.load(spark, f"file://{tmp_path}/g", end)[1].inputFiles()
        held = [[r[end] for r in spark.read.parquet(f).collect()] for f in files]
        assert 1 < len(files) <= 3 and all(h == sorted(h) for h in held) and sum(len(set(h)) for h in held) == (50 if end == "src" else 31)


def test_a_graph_to_save_is_not_written_before(spark, monkeypatch):
    from lattica.plans import truths
    from lattica.sources import fixture

    monkeypatch.setattr(fixture, "_saved", {})
    monkeypatch.setattr(fixture, "cut", lambda *a: pytest.fail("written twice"))
    sf_dir = "/root/testdata/sf0.001"
    path = truths.saved(spark, sf_dir)
    monkeypatch.undo()
    found = graph.load(spark, path)
    for got, want in zip(found, (fixture.nodes(spark, sf_dir), fixture.edges(spark, sf_dir)), strict=True):
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()


def test_registry_goes_by_the_longest_folder(spark):
    r = graph.Registry(spark, {"a": "x", "b": "y"}, {"a": "/w", "b": "/w/b"}, "a")
    assert [r.name_of(p) for p in ("/w/c.py", "/w/b/c.py", "/w/bc.py", "/z", None)] == ["a", "b", "a", "a", "a"]
    with pytest.raises(ValueError, match="several"):
        graph.Registry(spark, {"a": "x", "b": "y"}).name_of("/z")


def test_files_listed_as_changed(spark):
    assert [tuple(r) for r in graph.listed_changes(spark, ["a.py"]).collect()] == [("a.py", 1, 2**31 - 1)]


def test_match_report(spark):
    found = spark.createDataFrame([("b", "y", "exact"), ("a", "x", "heuristic"), ("a", "y", "exact")], "sender string, receiver string, confidence string")
    as_json, as_text = graph.match_report(found, 2)
    assert json.loads(as_json)["counts"] == {"exact": 2, "heuristic": 1} and [m["receiver"] for m in json.loads(as_json)["matches"]] == ["x", "y"]
    assert "- exact: 2" in as_text and "| a | x | heuristic |" in as_text


def test_a_stale_graph(spark):
    tree = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-02-01 00:00:00")], "path string, t string").withColumn("modificationTime", F.col("t").cast("timestamp"))
    assert [refresh.stale(tree, at).first()["is_stale"] for at in ("2024-01-15 00:00:00", "2024-03-01 00:00:00")] == [True, False]


def test_sinks(spark):
    found = spark.createDataFrame([("unguarded", "n", "f.py", 3, "no guard"), ("plaintext", "m", None, None, "http")], "finding string, node string, file string, line int, detail string")
    log = json.loads(graph.sarif_log(found))
    assert log["version"] == "2.1.0" and [r["level"] for r in log["runs"][0]["results"]] == ["warning", "warning"]
    assert log["runs"][0]["results"][1]["locations"][0]["physicalLocation"]["region"]["startLine"] == 3
    assert json.loads(graph.to_json_rows(found).first()["json"])["node"] == "n"


def test_text_sources(spark, tmp_path):
    (tmp_path / ".env").write_text('A=1\nexport B = "two"\n# no\n')
    assert {(r["key"], r["value"]) for r in graph.env_keys(spark, f"file://{tmp_path}/.env").collect()} == {("A", "1"), ("B", "two")}
    (tmp_path / "app.properties").write_text("spring.datasource.url = jdbc:x\nother=1\n")
    assert [(r["key"], r["value"]) for r in graph.properties(spark, f"file://{tmp_path}/app.properties").collect()] == [("spring.datasource.url", "jdbc:x")]
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,4 @@ f\n+a\n@@ -9 +12 @@\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    got = graph.diff_ranges(spark.createDataFrame([(diff,)], "text string")).collect()
    assert sorted(map(tuple, got)) == [("x.py", 3, 6), ("x.py", 12, 12)]
    nodes = spark.createDataFrame([("n", "f", 2, 3)], "id string, file string, line int, end_line int")
    lines = graph.snippet(nodes, spark.createDataFrame([("f", "a\nb\nc\nd")], "file string, text string"), nodes.select("id"))
    assert [tuple(r) for r in lines.orderBy("line").collect()] == [("n", 2, "b"), ("n", 3, "c")]


def test_globs_and_generated(spark):
    df = spark.createDataFrame([("src/a.py",), ("node_modules/x/y.js",), ("a/b/c.txt",), ("dist/app.min.js",)], "p string")
    rules = lambda *x: {r["p"] for r in df.where(S.skipped(F.col("p"), list(x))).collect()}
    assert rules("node_modules") == {"node_modules/x/y.js"} and rules("**/*.txt") == {"a/b/c.txt"} and rules("src/?.py") == {"src/a.py"}
    kept = df.where(S.skipped(F.col("p"), ["**/*"], ["src/**"])).collect()
    assert {r["p"] for r in kept} == {"node_modules/x/y.js", "a/b/c.txt", "dist/app.min.js"}
    assert df.where(S.generated(F.lit("// Code generated by x. DO NOT EDIT."), F.col("p"))).count() == 4
    assert {r["p"] for r in df.where(S.generated(F.lit(""), F.col("p"))).collect()} == {"dist/app.min.js"}


def test_python_scanner_and_call_edges(spark, tmp_path):
    (tmp_path / "a.py").write_text("def f():\n    g(); h()\n\ndef g():\n    pass\n")
    (tmp_path / "b.py").write_text("class C:\n    def h(self):\n        return g()\n")
    (tmp_path / "c.py").write_text("def (:\n")
    facts = S.functions_of_python(spark, S.files(spark, f"file://{tmp_path}", "*.py"))
    assert {(r["fqn"], r["line"]) for r in facts.where("error is null").collect()} == {("f", 1), ("g", 4), ("C", 1), ("C.h", 2)}
    assert facts.where("error is not null").count() == 1
    got = {(r["src"].rsplit("/", 1)[1], r["dst"].rsplit("/", 1)[1], r["confidence"]) for r in S.call_edges(facts).collect()}
    assert got == {("a.py#f", "a.py#g", "resolved"), ("a.py#f", "b.py#C.h", "heuristic"), ("b.py#C.h", "a.py#g", "heuristic")}


def test_redacting_attributes(spark):
    df = spark.createDataFrame([('{"password": "x", "name": "y", "api_key": "${K}"}',)], "attrs string")
    out = json.loads(df.select(S.redact_json(F.col("attrs"), b"s").alias("a")).first()["a"])
    assert out["password"].startswith("redacted:hmac:") and (out["name"], out["api_key"]) == ("y", "${K}")


def test_spec_tiers_and_search(spark):
    nodes = spark.createDataFrame([("function:a.b", "function", "b", "m.a.b", "x.py"), ("function:c.b", "function", "b", "m.c.b", "y.py"), ("table:b", "table", "tbl_1", "tbl_1", None)], "id string, kind string, name string, fqn string, file string")
    specs = spark.createDataFrame([(s,) for s in ("table:b", "x.py#b", "y.py", "function:*", "b", "c.b", "none")], "spec string")
    got: dict = {}
    for r in spec.resolve(nodes, specs).collect():
        got.setdefault(r["spec"], set()).add(r["id"])
    assert got == {"table:b": {"table:b"}, "x.py#b": {"function:a.b"}, "y.py": {"function:c.b"}, "function:*": {"function:a.b", "function:c.b"}, "b": {"function:a.b", "function:c.b"}, "c.b": {"function:c.b"}}
    assert [r["id"] for r in spec.search(nodes, "L_1").collect()] == ["table:b"]
    assert [r["id"] for r in spec.search(nodes, "tl1", fuzzy=True).collect()] == ["table:b"]


def test_endpoint_ranking_and_ties(spark):
    calls = spark.createDataFrame([(1, "/o/new"), (2, "/o/7"), (3, "/q/1")], "id int, name string")
    routes = spark.createDataFrame([("a", "/o/new"), ("b", "/o/{id}"), ("c", "/q/{x}"), ("d", "/q/{y}")], "id string, name string")
    got = {(r["sender"], r["receiver"], r["confidence"]) for r in J.match_endpoints(calls, routes, "path").collect()}
    assert got == {(1, "a", "exact"), (2, "b", "resolved"), (3, "c", "heuristic"), (3, "d", "heuristic")}
    send = spark.createDataFrame([(1, "order:{id}"), (2, "order:9")], "id int, name string")
    recv = spark.createDataFrame([("a", "order:42"), ("b", "order:{x}")], "id string, name string")
    got = {(r["sender"], r["receiver"]) for r in J.match_endpoints(send, recv, "template", fan_out=True).collect()}
    assert got == {(1, "a"), (1, "b"), (2, "b")}


def test_ranges_touch_once_over_buckets(spark):
    left = spark.createDataFrame([("f", 1, 500, "x"), ("f", 70, 70, "y"), ("g", 1, 1, "z")], "file string, lo int, hi int, item string")
    right = spark.createDataFrame([("f", 60, 200, "p"), ("f", 65, 80, "q"), ("f", 501, 600, "r")], "file string, start int, end int, id string")
    pairs = J.overlapping(left, right, ["file"])
    assert sorted((r["item"], r["id"]) for r in pairs.collect()) == [("x", "p"), ("x", "q"), ("y", "p"), ("y", "q")]
    assert {(r["item"], r["id"]) for r in J.innermost(pairs, ["item"]).collect()} == {("x", "q"), ("y", "q")}


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=7 * k), k % 3, "ab"[k % 2], 1.0) for k in range(40)]
    schema = "event_id int, ts timestamp, user_id int, event_type string, value double"
    at = f"file://{tmp_path}/events"
    spark.createDataFrame(rows[:30], schema).write.parquet(at)
    source = refresh.stream(spark, at)
    first = refresh.run(refresh.tumbling(source), "complete", f"file://{tmp_path}/state")
    assert sum(r["n"] for r in first.collect()) == 30
    spark.createDataFrame(rows[30:], schema).write.mode("append").parquet(at)
    assert sum(r["n"] for r in refresh.run(refresh.tumbling(refresh.stream(spark, at)), "complete", f"file://{tmp_path}/state").collect()) == 40
    assert refresh.run(refresh.distinct_facts(refresh.stream(spark, at), ["user_id", "event_type"], "10 hours")).count() == 6
    listing = spark.createDataFrame([("a", 1), ("b", 2)], "path string, size long")
    assert refresh.tree_mark(listing).collect() == refresh.tree_mark(listing.orderBy(F.desc("path"))).collect() != refresh.tree_mark(listing.limit(1)).collect()
