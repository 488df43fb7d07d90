"""Registered walks against plain searches over a small graph that is deeper than any level they could be cut at."""

from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
import pytest
from test_traverse import frame, search

from lattica import queries
from lattica.model import PROPAGATING
from lattica.operators import traverse as G
from lattica.sources.fixture import edges, nodes

SF = "/root/testdata/sf0.001"
PARTS = 24
#: Orders, and the (part, supplier) of their lines: order 1 is one long chain of calls, 2 to 5 enter at its far end.
LINES = {1: [(p, 1 if p == 1 else 2 + p % 2) for p in range(PARTS, 0, -1)], 2: [(PARTS, 3)], 3: [(PARTS, 2)], 4: [(PARTS - 1, 3)], 5: [(PARTS, 2)], 6: [(1, 1), (7, 2), (499, 2)], 7: [(499, 4), (500, 5)]}


@pytest.fixture(scope="module")
def deep(tmp_path_factory):
    at = tmp_path_factory.mktemp("deep")
    c = duckdb.connect()
    lines = ", ".join(f"({o}, {p}, {s}, {k}, 'A', 'F')" for o, xs in LINES.items() for k, (p, s) in enumerate(xs, 1))
    src = lambda t: f"'{SF}/{t}.parquet'"
    tables = {
        "region": f"SELECT * FROM {src('region')}",
        "nation": f"SELECT * FROM {src('nation')}",
        "customer": f"SELECT * FROM {src('customer')} WHERE c_custkey <= 20",
        "supplier": f"SELECT * FROM {src('supplier')} WHERE s_suppkey <= 5",
        "part": f"SELECT * REPLACE (p_partkey + if(p_partkey > {PARTS}, {499 - PARTS - 1}, 0) AS p_partkey, p_name AS p_name, if(p_partkey > {PARTS - 2}, 'one', 'b' || p_partkey) AS p_brand, 't' AS p_type, 5 AS p_size) FROM {src('part')} WHERE p_partkey <= {PARTS + 3}",
        "orders": f"SELECT * REPLACE (1 + o_orderkey % 3 AS o_custkey, ['1-URGENT', '4-NOT SPECIFIED', '5-LOW'][1 + o_orderkey % 3] AS o_orderpriority) FROM {src('orders')} WHERE o_orderkey <= 7",
        "lineitem": f"SELECT l.* REPLACE (v.o AS l_orderkey, v.p AS l_partkey, v.s AS l_suppkey, v.k::INT AS l_linenumber, v.f AS l_returnflag, v.t AS l_linestatus) FROM (VALUES {lines}) v(o, p, s, k, f, t), (SELECT * FROM {src('lineitem')} LIMIT 1) l",
        "events": f"SELECT * REPLACE (if(event_id % 2 = 0, 'error', 'click') AS event_type) FROM {src('events')} WHERE event_id IN (163, 164, 327)",
    }
    for name, sql in tables.items():
        c.execute(f"COPY ({sql}) TO '{at}/{name}.parquet' (FORMAT parquet)")
    return str(at)


@pytest.fixture(scope="module")
def known(spark, deep):
    """Propagating edges and entry kinds."""
    found = [tuple(r[c] for c in ("src", "dst", "kind", "file", "line", "confidence", "conf_rank", "gate")) for r in edges(spark, deep).collect()]
    return [e for e in found if e[2] in PROPAGATING], {r["id"]: r["entry_kind"] for r in nodes(spark, deep).collect() if r["entry_kind"]}


def tagged(rows, entries):
    out = defaultdict(list)
    for entry, kind in entries.items():
        for node in search(rows, [entry], back=False):
            out[node, kind].append(entry)
    return {k: (len(v), min(v)) for k, v in out.items()}


def tags(df):
    return {(r["node_id"], r["entry_kind"]): (r["entry_count"], r["sample_entry"]) for r in df.collect()}


def test_entry_tags_reach_any_depth(spark, deep, known):
    rows, entries = known
    want = tagged(rows, entries)
    assert tags(queries.queries()["entry_tags"](spark, deep)) == want
    info = {(r["id"], r["entries"], r["sample"]) for r in queries.queries()["entry_info"](spark, deep).collect()}
    assert info == {(n, *v) for (n, kind), v in want.items() if kind == "http_route" and n in ("function:1", "function:2", "function:3")}


def test_tags_of_many_entries_over_a_long_chain_and_a_cycle(spark):
    call = lambda a, b: (a, b, "CALLS", None, None, "exact", 3, None)
    rows = [call(f"f{i}", f"f{i + 1}") for i in range(34)] + [call("f5", "f2"), call("f20", "f20"), call("f9", "f1"), call("f30", "f28")]
    rows += [call(f"r{i}", f"f{i % 12}") for i in range(2100)] + [call("f3", "r7")]
    entries = {f"r{i}": "http_route" if i % 7 else "test" for i in range(2100)} | {"f4": "test", "alone": "test"}
    n = spark.createDataFrame(list(entries.items()) + [(f"f{i}", None) for i in range(35) if i != 4], "id string, entry_kind string")
    assert tags(G.tag_entries(frame(spark, rows), n)) == tagged(rows, entries)
    tree = rows[:9]
    assert tags(G.tag_entries(frame(spark, tree), n.where("id in ('f4', 'alone')"))) == tagged(tree, {"f4": "test", "alone": "test"})


def test_closures_and_paths_reach_any_depth(spark, deep, known):
    rows, entries = known
    run = lambda name: queries.queries()[name](spark, deep).collect()
    near = search(rows, ["function:5"])
    assert max(near.values()) > 8 and {r["id"]: r["depth"] for r in run("reverse_closure")} == near
    near = search(rows, ["table:1"])
    assert max(near.values()) > 8
    paths = {r["id"]: (r["depth"], r["path"].count("-> ")) for r in run("shortest_paths")}
    assert paths == {k: (d, d) for k, d in near.items()}
    near = search(rows, ["function:7"])
    assert max(near[k] for k in near if k in entries) > 3
    assert {r["id"]: (r["depth"], r["status"], r["path"].count("-> ")) for r in run("reaches")} == {k: (d, "live", d) for k, d in near.items() if k in entries}


def test_groups_and_downstream_reach_any_depth(spark, deep, known):
    rows, _ = known
    data = [e for e in rows if e[2] in ("READS_TABLE", "WRITES_TABLE")]
    calls = [e for e in rows if e not in data and e[2] != "OVERRIDDEN_BY"]
    got = {(r["grp"], r["depth"]): r["n"] for r in queries.queries()["group_closures"](spark, deep).collect()}
    of = {e[0]: e[1] for e in rows if e[0].startswith("table:") and e[2] == "REFERS_TO"}
    want = defaultdict(int)
    for grp in set(of.values()):
        used = [e for e in rows if e[2] in ("CALLS", "OVERRIDDEN_BY", "READS_TABLE", "WRITES_TABLE")]
        for d in search(used, [t for t in of if of[t] == grp]).values():
            want[grp, d] += 1
    assert max(d for _, d in got) > 4 and got == dict(want)
    far = search(calls, ["route:3"], back=False)
    tables = defaultdict(list)
    for e in data:
        if e[0] in far:
            tables[e[1], e[2]].append(far[e[0]] + 1)
    got = {(r["id"], r["kind"]): r["depth"] for r in queries.queries()["downstream"](spark, deep).collect() if r["flags"] == 0}
    assert max(got.values()) > 5 and got == {k: min(v) for k, v in tables.items()}


def test_affected_takes_all_changes_and_any_distance(spark, deep, known):
    rows, entries = known
    lines = {r["id"]: (r["file"], r["line"], r["end_line"]) for r in nodes(spark, deep).where("kind = 'function'").collect()}
    changed = [(f"src/m{i % 40}.py", i * 13 % 420 + 1, i * 13 % 420 + 1 + i % 5) for (i,) in duckdb.sql(f"SELECT event_id FROM '{deep}/events.parquet'").fetchall()]
    touched = [k for k, (f, a, b) in lines.items() if any(f == g and lo <= b and a <= hi for g, lo, hi in changed)]
    want = Counter(entries[k] for k in search(rows, touched) if k in entries)
    assert touched and {r["entry_kind"]: r["n"] for r in queries.queries()["affected"](spark, deep).collect()} == dict(want)
    near = {e[0] for e in rows if e[1] in touched}
    assert any(k in entries and k not in near for k in search(rows, touched))


def test_dispatch_only_looks_at_calls_too(spark, deep, known):
    rows = [e for e in known[0] if e[2] in ("CALLS", "OVERRIDDEN_BY", "ROUTES_TO")]
    far = search(rows, ["function:499"])
    want = {k: d for k, d in far.items() if d and all(e[2] == "OVERRIDDEN_BY" for e in rows if e[0] == k and far.get(e[1]) == d - 1)}
    assert want == {"function:24": 1, "function:23": 2}
    assert {r["id"]: r["depth"] for r in queries.queries()["dispatch_only"](spark, deep).collect()} == want
    edge = lambda a, b, kind: (a, b, kind, None, None, "exact", 3, None)
    both = [edge("base", "t", "OVERRIDDEN_BY"), edge("both", "t", "OVERRIDDEN_BY"), edge("both", "t", "CALLS"), edge("user", "base", "CALLS"), edge("top", "user", "OVERRIDDEN_BY"), edge("t", "t", "CALLS")]
    assert {(r["id"], r["depth"]) for r in G.every_step_dispatch(frame(spark, both), spark.createDataFrame([("t",)], "id string")).collect()} == {("base", 1), ("top", 3)}
