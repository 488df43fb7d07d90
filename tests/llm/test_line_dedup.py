from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from lattica.llm import line_dedup as L


def test_cuckoo_filter_has_no_false_negatives_and_deletes():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    f = L.CuckooFilter.of(keys)
    assert f.contains(keys).all()
    assert f.contains(np.random.default_rng(2).integers(-(2**62), 2**62, 20000)).mean() < 0.001
    before = f.to_bytes()
    more = [k for k in range(200) if f.insert(k)]
    assert f.contains(np.array(more)).all()
    assert all(f.delete(k) for k in more)
    assert sorted(np.frombuffer(f.to_bytes(), np.uint16)) == sorted(np.frombuffer(before, np.uint16))
    assert L.CuckooFilter.from_bytes(f.to_bytes()).contains(keys).all()


def test_full_filter_refuses_and_keeps_what_it_has():
    f = L.CuckooFilter(2)
    held = [k for k in range(100) if f.insert(k * 7919)]
    assert len(held) <= 8
    assert f.contains(np.array(held) * 7919).all()


def state(index):
    take = lambda df: sorted(map(tuple, df.collect()), key=repr)
    return take(index.postings.select("k0", "k1", "doc_id")), take(index.counts.select("k0", "k1", "n_docs", "keep"))


def test_insert_and_delete_are_reversible(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    old, new = docs.where("doc_id % 4 < 3"), docs.where("doc_id % 4 = 3")
    index = L.build(old)
    first = state(index)
    grown = L.insert(index, new)
    assert state(grown) == state(L.build(docs))
    key = lambda df: sorted(map(tuple, df.select("doc_id", "text", "n_dropped").collect()), key=repr)
    assert key(L.deduplicated(docs, grown)) == key(L.deduplicated(docs))
    shrunk = L.delete(grown, new.select("doc_id"))
    assert state(shrunk) == first
    assert key(L.deduplicated(old, shrunk)) == key(L.deduplicated(old, index))


def test_shards_and_salts_change_nothing(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    whole = sorted(map(tuple, L.report(docs).collect()))
    monkeypatch.setattr(L, "GROUP_ROWS", 10)
    index = L.build(docs, shard_keys=1)
    assert index.shards > 1
    cut = L.deduplicated(docs.select("doc_id", "text"), index)
    assert sorted(map(tuple, cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect())) == whole


def test_nulls_repeats_and_clashing_columns(spark):
    line = "a line of twenty or more signs"
    rows = [(1, line, 7), (2, line + "\nx", 7), (None, line, 7), (3, " " + line.upper(), 7), (3, line, 7), (4, None, 7), (5, "", 7)]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_lines int").withColumn("gone", F.lit("g"))
    out = {(r["doc_id"], r["text"]): (r["n_lines"], r["n_dropped"], r["gone"]) for r in L.deduplicated(df).collect()}
    assert out == {(1, ""): (1, 1, "g"), (2, "x"): (2, 1, "g"), (None, ""): (1, 1, "g"), (3, " " + line.upper()): (1, 0, "g"), (3, line): (1, 0, "g"), (4, None): (1, 0, "g"), (5, ""): (1, 0, "g")}


def test_empty_table(spark):
    assert L.report(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_against_plain_python(spark):
    r = random.Random(3)
    pool = [f"line number {k} of the shared pool" for k in range(12)]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 6)))) for i in range(40)]
    holders = {}
    for i, t in docs:
        for line in set(t.split("\n")):
            holders.setdefault(line, []).append(i)
    want = {i: "\n".join(x for x in t.split("\n") if len(holders[x]) < 3 or max(holders[x]) == i) for i, t in docs}
    got = {x["doc_id"]: x["text"] for x in L.deduplicated(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == want
