"""Learned rename rules against the same by dictionaries; contested and ambiguous names."""

from __future__ import annotations

import random
import re
from collections import Counter

from lattica.operators import renames as R


def words(name):
    return [w.lower() for w in re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+", name.rsplit(".", 1)[-1])]


def rules_of(pairs, least=2):
    seen, total = Counter(), Counter()
    for a, b in set(pairs):
        s, t = words(a), words(b)
        n = min(len(s), len(t))
        p = next((i for i in range(n) if s[i] != t[i]), n)
        q = next((i for i in range(n - p) if s[-1 - i] != t[-1 - i]), n - p)
        if p and not q and 0 < len(s) - p <= 2 and 0 < len(t) - p <= 2:
            k = "tail", " ".join(s[p:]), " ".join(t[p:])
        elif q and not p and 0 < len(s) - q <= 2 and 0 < len(t) - q <= 2:
            k = "head", " ".join(s[: len(s) - q]), " ".join(t[: len(t) - q])
        else:
            continue
        seen[k] += 1
        total[k[:2]] += 1
    out = {}
    for (at, a, b), n in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
        if n >= least and 3 * n >= 2 * total[at, a]:
            out.setdefault((at, a), (b, n))
    return {(at, a, b, n) for (at, a), (b, n) in out.items()}


def test_rules_equal_dictionaries(spark):
    r = random.Random(2)
    heads, tails = ["Load", "Fetch", "Old", "New", "XMLGet"], ["Screen", "Page", "View", "ListView", "DTO", "Model2"]
    for _ in range(4):
        pairs = [(f"{r.choice(heads)}{r.choice('ABC')}x{r.choice(tails)}", f"a.b.{r.choice(heads)}{r.choice('ABC')}x{r.choice(tails)}") for _ in range(200)]
        got = {tuple(x) for x in R.learn(spark.createDataFrame(pairs, "a string, b string")).collect()}
        assert got == rules_of(pairs)


def sides(spark, left, right, pairs):
    make = lambda rows: spark.createDataFrame(rows, "id string, name string, kind string")
    return spark.createDataFrame(pairs, "a string, b string"), make(left), make(right)


def test_a_rename_raises_matches_and_a_rare_one_does_not(spark):
    left = [(f"l{k}", f"Item{k}Screen", "type") for k in range(10)] + [("f", "UserModel", "type"), ("k", "Item11Screen", "func")]
    right = [(f"r{k}", f"item{k}_page", "type") for k in range(10)] + [("g", "UserEntity", "type"), ("h", "CartEntity", "type"), ("m", "item11_page", "type")]
    pairs, rules = R.matched(*sides(spark, [*left, ("c", "CartModel", "type")], right, [("l0", "r0"), ("l1", "r1"), ("c", "h")]))
    assert {(x["a"], x["b"], x["how"]) for x in pairs.collect()} == {*((f"l{k}", f"r{k}", "given" if k < 2 else "learned") for k in range(10)), ("c", "h", "given")}
    assert {tuple(x)[:3] for x in rules.collect()} == {("tail", "screen", "page")}


def test_wanted_by_several_and_called_alike(spark):
    rules = spark.createDataFrame([("tail", "screen", "page", 5), ("tail", "view", "page", 3), ("head", "old", "new", 2)], "at string, was string, now string, support long")
    left = [("a", "AxScreen", "t"), ("b", "AxView", "t"), ("c", "BxScreen", "t"), ("d", "OldCxView", "t"), ("e", "DxScreen", "t")]
    right = [("p", "AxPage", "t"), ("q", "BxPage", "t"), ("r", "bx_page", "t"), ("s", "NewCxView", "t"), ("u", "OldCxPage", "other"), ("v", "DxPage", "t")]
    _, ls, rs = sides(spark, left, right, [("x", "y")])
    got = {(x["a"], x["b"]) for x in R.apply(rules, ls, rs).collect()}
    assert got == {("a", "p"), ("d", "s"), ("e", "v")}  # b came second, c has two


def test_nothing_to_learn_from(spark):
    pairs, rules = R.matched(*sides(spark, [("a", None, "t")], [("b", "", "t")], []))
    assert pairs.collect() == [] == rules.collect()
    assert {tuple(x) for x in R.rename_map(*sides(spark, [("a", "X", "t"), ("c", "Z", "t")], [("b", "Y", "t"), ("d", "Z", "t")], [("a", "b"), ("c", "d")])).collect()} == {("X", "Y")}
