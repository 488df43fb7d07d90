"""Indexes written field by field and read back; damage; the graph they give."""

from __future__ import annotations

import random

from lattica.sources import scip


def number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*parts):
    """Parts (field, value): numbers, texts, bytes, and lists of numbers, packed."""
    out = b""
    for n, v in parts:
        if isinstance(v, int):
            out += number(n << 3) + number(v)
        else:
            data = v.encode() if isinstance(v, str) else b"".join(map(number, v)) if isinstance(v, list) else v
            out += number(n << 3 | 2) + number(len(data)) + data
    return out


def place(symbol, roles, at, body=None):
    return message((1, at), (2, symbol), (3, roles), *([(7, body)] if body else []))


A, B, K, LOCAL = "py pkg a/run().", "py pkg b/Shop#pay().", "py pkg b/Shop#", "local 1"
DOCS = {
    "src/a.py": message((1, "src/a.py"), (4, "python"), (2, place(A, 1, [2, 4, 7], [2, 0, 9, 5])), (2, place(B, 8, [4, 2, 5])), (2, place(LOCAL, 1, [5, 0, 1])), (2, place(LOCAL, 8, [6, 0, 1])), (2, place(B, 2, [0, 7, 9]))),
    "src/b.py": message((1, "src/b.py"), (2, place(K, 1, [0, 6, 10], [0, 0, 20, 0])), (2, place(B, 1, [3, 8, 11], [3, 0, 6, 0])), (2, place(A, 8, [5, 0, 3])), (2, place("py pkg b/Shop#total.", 1, [10, 0, 4])), (2, place("py pkg b/Shop#total.", 4, [4, 0, 4])), (3, message((1, K), (4, message((1, "py lib Base#"), (3, 1))), (6, "Shop")))),
}


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, content binary")


def test_graph_of_an_index(spark):
    index = message((1, message((1, 0))), *((2, d) for d in DOCS.values()), (3, message((1, "x"))))
    nodes, edges = scip.graph(scip.documents(files(spark, [("i.scip", index), ("empty", b""), ("null", None)])).repartition(3))
    assert {(r["id"], r["kind"], r["name"], r["file"], r["line"], r["end_line"]) for r in nodes.collect()} == {(A, "function", "run", "src/a.py", 3, 10), (B, "function", "pay", "src/b.py", 4, 7), (K, "class", "Shop", "src/b.py", 1, 21), ("src/a.py#local 1", "symbol", "1", "src/a.py", 6, 6), ("py pkg b/Shop#total.", "field", "total", "src/b.py", 11, 11)}
    assert {(r["src"], r["kind"], r["dst"], r["line"]) for r in edges.collect()} == {(A, "CALLS", B, 5), (A, "REFERS_TO", "src/a.py#local 1", 7), ("file:src/a.py", "IMPORTS", B, 1), (B, "CALLS", A, 6), (B, "WRITES_PROP", "py pkg b/Shop#total.", 5), (K, "IMPLEMENTS", "py lib Base#", None)}


def test_damage_gives_rows_with_errors(spark):
    whole = message(*((2, d) for d in DOCS.values()))
    bad = message((2, message((1, "c.py"), (2, b"\xff\xff"))), (2, DOCS["src/a.py"]))
    docs = scip.documents(files(spark, [("cut", whole[:-3]), ("bad", bad)]))
    assert [r["index"] for r in docs.where("error is not null").collect()] == ["cut"]
    found = scip.occurrences(docs)
    assert found.where("error is not null").count() == 2 and found.where("error is null").count() == 5


def test_numbers_and_random_bytes():
    r = random.Random(1)
    for n in (0, 1, 127, 128, 300, 2**31, 2**63 - 1):
        assert scip.varint(memoryview(number(n)), 0) == (n, len(number(n)))
    for _ in range(2000):
        data = bytes(r.randrange(256) for _ in range(r.randint(0, 30)))
        try:
            assert all(isinstance(n, int) for n, _ in scip.fields(memoryview(data)))
        except (ValueError, IndexError):
            pass


def test_files_are_read(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.scip").write_bytes(message(*((2, d) for d in DOCS.values())))
    assert scip.read(spark, str(tmp_path), 2).count() == 6
