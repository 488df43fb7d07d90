"""Answers in words on a small graph, against plain walks."""

from __future__ import annotations

from collections import deque

from lattica.operators import explore as E

NODES = [("function:pay.charge_order", "function", "charge_order", "pay.py", 1, 5, None), ("function:shop.orders_total", "function", "orders_total", "shop.py", 1, 200, None), ("class:Orders", "class", "Orders", "shop.py", 1, 3, None), ("function:order.zeta", "function", "zeta", "order.py", 1, 2, None), ("route:GET /orders", "route", "GET /orders", "r.py", 3, 4, "http_route"), ("function:cli", "function", "main", "cli.py", 1, 2, "cli_command"), ("function:helper", "function", "helper", "h.py", 1, 2, None), ("test:t_order", "function", "test_order", "tests/test_x.py", 1, 2, "test"), ("table:orders", "table", "orders", None, None, None, None), ("table:log", "table", "log", None, None, None, None), ("module:order", "module", "order", "o.py", 1, 1, None)]
EDGES = [("route:GET /orders", "function:helper", "CALLS"), ("function:helper", "function:pay.charge_order", "CALLS"), ("function:cli", "function:shop.orders_total", "CALLS"), ("function:shop.orders_total", "function:pay.charge_order", "CALLS"), ("function:pay.charge_order", "table:orders", "WRITES_TABLE"), ("function:helper", "table:log", "READS_TABLE"), ("test:t_order", "function:helper", "CALLS"), ("function:pay.charge_order", "function:helper", "CALLS")]


def graph(spark):
    nodes = spark.createDataFrame(NODES, "id string, kind string, name string, file string, line int, end_line int, entry_kind string")
    edges = spark.createDataFrame([(*e, "f.py", 1, None, 3, "exact") for e in EDGES], "src string, dst string, kind string, file string, line int, gate string, conf_rank int, confidence string")
    return nodes, edges


def depths(start, up):
    seen, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for a, b, kind in EDGES:
            y = (a if b == x else None) if up else (b if a == x else None)
            if y and y not in seen and kind == "CALLS":
                seen[y] = seen[x] + 1
                todo.append(y)
    return seen


def test_words_lose_their_endings_and_what_says_nothing():
    assert E.stems("How does charging of the Orders work, and ORDER?") == ["charg", "order"] and E.stems("what is it") == [] and E.stems("") == []


def test_best_symbols(spark):
    got = [(r["id"], r["score"]) for r in E.ranked(graph(spark)[0], E.stems("charge the orders"), 9).orderBy("place").collect()]
    assert got == [("function:pay.charge_order", 23), ("route:GET /orders", 13), ("function:shop.orders_total", 13), ("class:Orders", 12), ("table:orders", 12)]


def test_answer_equals_plain_walks(spark):
    nodes, edges = graph(spark)
    rows = E.explore(nodes, edges, "charge the orders", budget=500, most=3).collect()
    best = ["function:pay.charge_order", "route:GET /orders", "function:shop.orders_total"]
    assert [r["symbol"] for r in sorted(rows, key=lambda r: r["place"]) if r["section"] == "symbol"] == best
    kinds = {n[0]: n[6] for n in NODES}
    for s in best:
        of = lambda section, s=s: [r for r in rows if r["symbol"] == s and r["section"] == section]
        up = {k: d for k, d in depths(s, True).items() if d}
        if s.startswith("function"):
            assert of("callers")[0]["n"] == sum(kinds[k] is None for k in up) and of("entries")[0]["n"] == sum(kinds[k] is not None for k in up)
            assert {(r["item"], r["n"]) for r in of("entry")} == {(k, d) for k, d in up.items() if kinds[k]}
        below = depths(s, False)
        assert {(r["section"], r["item"]) for r in of("writes") + of("reads")} == {("writes" if k == "WRITES_TABLE" else "reads", b) for a, b, k in EDGES if a in below and k != "CALLS"}
        assert {(r["item"], r["n"]) for r in of("between")} == {(x, d) for x, d in up.items() if x in best and x != s}
        for r in of("between") + of("path"):
            hops = r["path"].split(" -CALLS-> ")
            assert hops[0] == r["item"] and hops[-1] == s and len(hops) == r["n"] + 1 and all((a, b, "CALLS") in EDGES for a, b in zip(hops, hops[1:], strict=False))
    fits = {r["symbol"]: r["n"] for r in rows if r["section"] == "source"}
    assert fits == {"function:pay.charge_order": 50, "route:GET /orders": 20}  # two hundred lines don't fit


def test_a_question_without_an_answer(spark):
    nodes, edges = graph(spark)
    assert E.explore(nodes, edges, "what is the xyzzy").collect() == [] == E.explore(nodes, edges, "how does it work").collect()
