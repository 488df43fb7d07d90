from __future__ import annotations

import random

import pytest

from lattica.llm import url_filter as U


@pytest.mark.parametrize("inline", [U.INLINE_BLOCKS, 0])
def test_many_rules_equal_a_scan_of_the_list(spark, inline):
    r = random.Random(6)
    host = lambda: ".".join(r.choice(["a", "b", "c", "org", "com"]) for _ in range(r.randint(1, 4)))
    path = lambda: "".join(r.choice(["/", "x", "y", "/x"]) for _ in range(r.randint(0, 4)))
    rules = sorted({(r.choice(["allow", "block"]), host(), "/" + path()) for _ in range(400)})
    urls = [f"http://{host()}/{path()}{r.choice(['', '?q', '#f'])}" for _ in range(500)] + [None, "", "nothing", "http://"]
    urls += urls[:20]
    got = U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), U.rule_table(spark, rules), inline_blocks=inline)
    for row in got.collect():
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (row["host"] == h or row["host"].endswith("." + h)) and row["path"].startswith(p)]
        longest = max(n for n, _, _ in fits) if fits else None
        best = sorted(v for n, _, v in fits if n == longest)
        assert row["verdict"] == (best[-1] if best else "allow")
        assert (row["rule"] is None) == (not fits) and (not fits or len(row["rule"]) == longest)
    assert got.count() == len(urls)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (None, None)], "page_id int, url string")
    empty = U.rule_table(spark, [("block", "x", "/")]).limit(0)
    assert sorted(map(repr, U.judge(pages, empty).select("host", "verdict").collect())) == ["Row(host='', verdict='allow')", "Row(host='a.b', verdict='allow')"]
    assert U.judge(pages.limit(0), U.rule_table(spark, U.RULES)).collect() == []


def test_filter_passes_few_others(spark):
    keys = spark.range(4000).selectExpr("concat('host', id, '/') as key")
    n = -(-4000 // U.KEYS_PER_BLOCK)
    held = {r["block"]: [r[f"w{i}"] for i in range(U.WORDS)] for r in U.blocks(keys, n).collect()}
    from pyspark.sql import functions as F

    block, bits = U._probes(F.col("key"), n)
    probe = lambda first: [all(held[r["b"]][i] & r[f"b{i}"] for i in range(U.PROBES)) for r in spark.range(first, first + 4000).selectExpr("concat('host', id, '/') as key").select(block.alias("b"), *(x.alias(f"b{i}") for i, x in enumerate(bits))).collect()]
    assert all(probe(0)) and sum(probe(10**6)) < 40
