from __future__ import annotations

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lattica.llm import packing


def one_by_one(lengths, sizes, cost):
    """Item by item: the fullest bin with room, or the least-cost new bin; the bins' contents."""
    bins: list[list[int]] = []
    count = Counter(lengths)
    for n in sorted(lengths, reverse=True):
        open_bins = [b for b in bins if b[0] - b[1] >= n]
        if open_bins:
            best = min(open_bins, key=lambda b: b[0] - b[1])
        else:
            smaller = sum(k * c for k, c in count.items() if k < n)
            best = [min((s for s in sizes if s >= n), key=lambda s: ((s + cost) / (s // n * n + min(s - s // n * n, smaller)), s)), 0]
            bins.append(best)
        best[1] += n
    return sorted((min(s for s in sizes if s >= held), held) for _, held in bins)


@pytest.mark.parametrize("seed", range(60))
def test_plan_equals_item_by_item(seed):
    r = random.Random(seed)
    sizes = r.choice([(8, 16), (5, 12, 30), (64,), (10, 20, 40)])
    lengths = [r.randint(1, max(sizes)) if r.random() < 0.5 else r.randint(1, max(sizes) // 4 + 1) for _ in range(r.randint(0, 150))]
    plan = packing.Plan(Counter(lengths), sizes, 3)
    assert sorted((c, held) for a, b, c, held in plan.runs for _ in range(b - a)) == one_by_one(lengths, sizes, 3)


@pytest.mark.parametrize("shard_rows", [7, 10**6])
def test_items_fill_their_bins_without_overlap(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(packing, "SHARD_ROWS", shard_rows)
    r = random.Random(2)
    rows = [(i, r.choice([0, 5, 5, 5, 5, r.randint(1, 30), r.randint(60, 300)]), "k") for i in range(150)] + [(None, 9, "k"), (3, 12, "k"), (500, None, "k")]
    df = spark.createDataFrame(rows, "doc_id int, n int, piece string")
    out = packing.packed(df, "n", (16, 64), 2).collect()
    bins: dict = {}
    got = Counter()
    for p in out:
        got[(p["doc_id"], p["n"])] += p["piece_length"]
        if p["bin"] is not None:
            bins.setdefault(p["bin"], []).append(p)
    want = Counter()
    for i, n, _ in rows:
        want[(i, n)] += n or 0
    assert got == want
    for items in bins.values():
        at = 0
        for p in sorted(items, key=lambda p: p["bin_place"]):
            assert p["bin_place"] == at
            at += p["piece_length"]
        assert {p["bin_capacity"] for p in items} == {16 if at <= 16 else 64}
    assert sorted(bins) == list(range(len(bins)))
    rest = Counter(n % 64 for _, n, _ in rows if n and n % 64)
    assert len(bins) == packing.Plan(rest, (16, 64), 2).bins + sum((n or 0) // 64 for _, n, _ in rows)


@pytest.mark.parametrize("seed", range(30))
def test_places_equal_item_by_item(seed):
    r = random.Random(seed)
    sizes = r.choice([(8, 16), (5, 12, 30), (64,)])
    lengths = [r.randint(0, max(sizes) * 3) if r.random() < 0.4 else r.randint(0, max(sizes) // 3) for _ in range(r.randint(0, 120))]
    item, start, length, bins, capacity, at = packing.place(np.array(lengths, np.int64), sizes, 3)
    top = max(sizes)
    held: dict = {}
    for b, c, p, n in zip(bins.tolist(), capacity.tolist(), at.tolist(), length.tolist(), strict=True):
        assert held.get(b, (c, 0)) == (c, p)
        held[b] = (c, p + n)
    assert sorted(held.values()) == sorted(one_by_one([n % top for n in lengths if n % top], sizes, 3) + [(top, top)] * sum(n // top for n in lengths))
    parts: dict = {}
    for i, s, n in sorted(zip(item.tolist(), start.tolist(), length.tolist(), strict=True)):
        assert parts.get(i, 0) == s
        parts[i] = s + n
    assert parts == {i: n for i, n in enumerate(lengths) if n}


PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("shard_bytes", [3_000, 10**8])
def test_sequences_hold_every_document_s_tokens(spark, folder, shard_bytes):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "a null id"), (None, "another"), (7000, " " * 100_000), (7001, "x" * 100_000), (7002, "copied text " * 30), (7002, "<|endoftext|>")] + [(9, "copied text " * 30)] * 40, "doc_id bigint, text string"))
    encode, sizes = packing.encoding(PATH), (64, 256)
    want = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    found = packing.sequences(docs, PATH, sizes, 4, shard_bytes).collect()
    assert len({s["bin"] for s in found if s["bin"] is not None}) == sum(s["bin"] is not None for s in found)
    pieces: dict = {}
    for s in found:
        assert s["n_tokens"] == len(s["tokens"]) == sum(s["lengths"]) and len(s["doc_ids"]) == len(s["starts"]) == len(s["lengths"])
        if s["bin"] is None:
            assert s["n_tokens"] == 0 and len(s["doc_ids"]) == 1
        else:
            assert s["bin_capacity"] == min(c for c in sizes if c >= s["n_tokens"]) and all(s["lengths"])
        at = 0
        for d, start, n in zip(s["doc_ids"], s["starts"], s["lengths"], strict=True):
            pieces.setdefault(d, []).append((start, tuple(s["tokens"][at : at + n])))
            at += n
    for d, text in want:
        texts = [encode.encode_ordinary(t) for (i, t), k in want.items() if i == d for _ in range(k)]
        every = Counter((start, tuple(t[start : start + 256])) for t in texts for start in range(0, max(len(t), 1), 256))
        assert Counter(pieces[d]) == every, (d, text)


def test_sequences_of_an_empty_table_and_of_extra_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert packing.sequences(docs.limit(0), PATH).collect() == []
    more = docs.withColumn("shard", F.lit("x")).withColumn("h", F.lit(1)).withColumn("bin", F.lit(2))
    assert sorted(map(repr, packing.sequences(more, PATH).collect())) == sorted(map(repr, packing.sequences(docs, PATH).collect()))
