from __future__ import annotations

import random
from types import SimpleNamespace

import pyarrow as pa
import pytest

from lattica.llm import ngram_join as N
from lattica.llm.components import components


def exact(docs, size, percent):
    """Smallest id reachable, by all pairs."""
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(len(w) - size, 0) + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and (x := find(a)) != (y := find(b)):
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def groups(seed):
    """Families of edited copies, some at the edge of the threshold, that share a passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(25)]
    out = []
    for _ in range(8):
        base = [word() for _ in range(r.randint(4, 60))] + (passage if r.random() < 0.5 else [])
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
    r.shuffle(out)
    return list(enumerate([*out, None, "", "one", "ONE", "one  two", " \n"]))


@pytest.mark.parametrize("seed,size,percent,rounds", [(1, 4, 85, 4), (2, 5, 80, 0), (3, 2, 50, 1), (4, 4, 100, 2)])
def test_components_equal_all_pairs(spark, seed, size, percent, rounds):
    docs = groups(seed)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.linked(df, size, percent, star_rounds=rounds).collect()}
    assert got == exact(docs, size, percent)


def test_one_of_each_group_stays(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(2, text, "a"), (1, text + " end", "b"), (1, text + " end", "b"), (3, "other text", "c"), (None, text, "d"), (4, None, "e"), (5, "", "f")]
    df = spark.createDataFrame(rows, "doc_id int, text string, name string")
    assert sorted(map(repr, N.one_of_each(df).select("doc_id", "name").collect())) == sorted(f"Row(doc_id={i}, name='{n}')" for i, n in [(1, "b"), (3, "c"), (None, "d"), (4, "e"), (5, "f")])


def test_empty_table(spark):
    assert N.report(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_components_of_chains_and_loops(spark):
    links = [(k, k + 1) for k in range(30)] + [(50, 41), (60, 50), (60, 41), (70, 70), (41, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(31)} | {41: 41, 50: 41, 60: 41, 70: 70}


@pytest.mark.parametrize("other_first", [True, False])
def test_a_name_with_two_texts_keeps_its_true_link(spark, other_first):
    """Both orders of the two texts that one id has; one task sees them behind each other."""
    right, other = "a b c d e f g h", "q r s t u v w x"
    names = N.Names()
    name = names.of(N.ngrams(right.encode(), 3))
    held = spark.createDataFrame([(name, x) for x in ([other, right] if other_first else [right, other])], "name bigint, text string").coalesce(1)
    pairs = spark.createDataFrame([(name, name)], "a bigint, b bigint").coalesce(1)
    texts = SimpleNamespace(names=names, of=lambda *_: held)
    assert [tuple(r) for r in N._verified(pairs, texts, 3, 80).collect()] == [(name, name)]


@pytest.mark.parametrize("bits", [6, 7])
def test_sets_that_share_a_name_stay_apart(spark, bits):
    docs = groups(6)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    first = {N.set_name(g, bits)[0] for _, t in docs if len(g := N.ngrams((t or "").encode(), 4))}
    assert len(first) < len({N.set_name(g) for _, t in docs if len(g := N.ngrams((t or "").encode(), 4))})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.linked(df, 4, 85, name_bits=bits).collect()}
    assert got == exact(docs, 4, 85)


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_a_block_adds_up_over_batches(rows):
    """Counts of all pairs of a block, however its rows are cut into batches."""
    r = random.Random(rows)
    held = sorted({(k % 2, min(c, d), max(c, d), column, name) for k in range(2) for name in range(90) for c in (0, 1) if name % 2 == c for d in (0, 1) for column in r.sample(range(12), 4)})
    table = pa.table({"block": [h[0] for h in held], "i": [h[1] for h in held], "j": [h[2] for h in held], "chunk": [h[4] % 2 for h in held], "name": [h[4] for h in held], "n": pa.array([4] * len(held), pa.int32()), "component": [h[4] for h in held], "column": [h[3] for h in held], "outside": [0] * len(held)})
    want: dict = {}
    for block, i, j in {h[:3] for h in held}:
        columns: dict = {}
        for h in held:
            if h[:3] == (block, i, j):
                columns.setdefault(h[3], []).append(h[4])
        for names in columns.values():
            for x in names:
                for y in names:
                    if x < y and (i == j or x % 2 != y % 2):
                        want[x, y, block] = want.get((x, y, block), 0) + 1
    got: dict = {}
    for b in N._multiplied(1)(iter(table.to_batches(max_chunksize=rows))):
        for x, y, c in zip(*(b.column(k).to_pylist() for k in ("a", "b", "c")), strict=True):
            got[x, y] = got.get((x, y), 0) + c
    total: dict = {}
    for (x, y, _), c in want.items():
        total[x, y] = total.get((x, y), 0) + c
    assert got == total
