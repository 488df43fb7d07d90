"""Codes against plain Python integers, extreme values, nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from lattica.llm import vector_codes as V

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """The same by dictionaries and unbounded integers; rows of distinct ids and equal lengths."""
    usable = [(i, [math.floor(Fraction(x) * scale) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(usable[0][1])
    at = [p * width // parts for p in range(parts + 1)]
    books = [[v[at[p] : at[p + 1]] for _, v, _ in usable[:entries]] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x, p: min((far(x, c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in usable:
                x = v[at[p] : at[p + 1]]
                groups.setdefault(near(x, p)[1], []).append(x)
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    out, by_label = [], {}
    for i, v, label in usable:
        found = [near(v[at[p] : at[p + 1]], p) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append([i, "".join(f"{k:02x}" for _, k in found), min(error, V.LONG_MAX), label])
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted([(i, code, error, min(by_label[label], V.LONG_MAX), digest) for i, code, error, label in out], key=repr)


def found(spark, rows, schema=SCHEMA, **more):
    df = V.report(spark.createDataFrame(rows, schema).repartition(3), **more)
    return sorted(map(tuple, df.collect()), key=repr)


def vectors(n, width, seed, spread=0.3, labels=4):
    r = random.Random(seed)
    return [(i * 7 % 1009, [r.gauss(0, spread) for _ in range(width)], r.choice([None, *range(labels)])) for i in range(n)]


def test_equals_plain_integers(spark):
    rows = vectors(150, 16, 1)
    rows += [(5000, None, 1), (5001, [0.1] * 15 + [None], 1), (5002, [math.nan] + [0.0] * 15, 2), (5003, [math.inf] * 16, None), (-4, [-math.inf] + [0.0] * 15, 0), (None, [0.25] * 16, 3)]
    assert found(spark, rows) == plain(rows)


def test_ties_fewer_ids_than_entries_and_unused_entries(spark):
    rows = [(i, [float(i % 2)] * 8, 0) for i in range(5)]  # equal entries: the lower one takes all, the others stay
    assert found(spark, rows) == plain(rows)
    assert {r[1] for r in found(spark, rows)} == {"00" * 8, "01" * 8}


@pytest.mark.parametrize("spread", [1e6, 1e12, 3e38])
def test_large_values_are_exact(spark, spread):
    rows = vectors(40, 8, 3, spread)
    assert found(spark, rows) == plain(rows)


def test_negative_floors():
    assert V.whole(np.array([-0.1, 0.1, -1 / 4096, 1e300]), 4096).tolist() == [-410, 409, -1, math.floor(Fraction(1e300) * 4096)]
    assert V.whole(np.array([-0.1, 0.35]), 10).tolist() == [-2, 3]


def test_limbs_add_up():
    for v in (0, 1, -1, 2**31, -(2**95) + 7):
        assert sum(d << (V.LIMB_BITS * k) for k, d in enumerate(V._limbs(v))) == v


def test_other_lengths_repeats_and_clashing_columns(spark):
    rows = [(0, [0.1] * 16, 1), (0, [0.1] * 16, 1), (1, [0.5] * 16, 1), (2, [0.5] * 9, 1), (3, [], None)]
    out = found(spark, rows)
    assert [r[0] for r in out] == [0, 0, 1]
    df = spark.createDataFrame([(*r, "mine", 1.5) for r in rows], SCHEMA + ", code string, weight double")
    coded = V.encode(df, V.fit(df))
    assert sorted(coded.columns) == ["code", "codes", "error", "label", "vec_id", "weight"]
    assert {r["code"] for r in coded.collect()} == {"00" * 8, "01" * 8}
    odd = [(k, [k / 8 + j for j in range(11)], None) for k in range(30)]  # 11 components in eight parts
    assert found(spark, odd) == plain(odd)


def test_empty_tables_and_unusable_vectors(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, 2), (2, [None], None)]) == []
    assert found(spark, [(1, [], 2)]) == [(1, "00" * 8, 0, 0, hashlib.sha256(b",".join([b""] * 0)).hexdigest())]


def test_decoding_comes_close(spark):
    rows = vectors(300, 16, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    books = V.fit(df, entries=64, rounds=3)
    got = {r["vec_id"]: books.decode(r["codes"]) for r in V.encode(df, books).collect()}
    lost = np.mean([np.square(np.subtract(got[i], v)).sum() for i, v, _ in rows])
    assert lost < 0.35 * np.mean([np.square(v).sum() for _, v, _ in rows])
    with pytest.raises(ValueError, match="positive"):
        V.fit(df, parts=0)


def test_many_labels_join_by_a_shuffle(spark, monkeypatch):
    rows = vectors(60, 8, 9, labels=20)
    whole = found(spark, rows)
    monkeypatch.setattr(V, "BROADCAST_LABELS", 0)
    assert found(spark, rows) == whole == plain(rows)
