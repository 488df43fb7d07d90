"""Runs against a scan of every period, the registered query against plain Python, edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from lattica.llm import periodic_runs as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def every_period(w, least=24, times=3):
    """Runs by trying all periods at all places."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                found.setdefault((s, i + q - s), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(r, n, kinds):
    w = [b"%d" % r.randrange(kinds) for _ in range(n)]
    for _ in range(r.randint(0, 4)):
        if n > 5:
            a, q = r.randrange(n), r.randint(1, 20)
            for i in range(a + q, min(n, a + r.randint(1, 120))):
                w[i] = w[i - q]
    return w


@pytest.mark.parametrize("least, times", [(24, 3), (10, 2), (25, 4), (6, 3), (2, 2)])
def test_equals_a_scan_of_every_period(least, times):
    r = random.Random(least)
    for _ in range(400):
        w = periodic(r, r.randint(0, 220), r.choice([1, 2, 2, 3, 5, 40]))
        assert P.runs_of(P.ranks(w), least, times) == every_period(w, least, times), w


def test_blocks_of_queries_change_nothing(monkeypatch):
    r = random.Random(2)
    some = [periodic(r, 300, 3) for _ in range(40)]
    whole = [P.runs_of(P.ranks(w)) for w in some]
    monkeypatch.setattr(P, "QUERIES", 7)
    assert [P.runs_of(P.ranks(w)) for w in some] == whole


def test_overlap_is_the_least_of_all_periods():
    for least, times in ((24, 3), (25, 4), (7, 2), (100, 3), (3, 5), (2, 2)):
        assert P.minimum_overlap(least, times) == min(max(least, times * q) - q for q in range(1, 200))
    with pytest.raises(ValueError, match="two periods"):
        P.minimum_overlap(24, 1)


def test_words_outside_repeated_grams_survive_nowhere():
    w = [b"%d" % k for k in range(500)]
    assert P.segments(P.ranks(w), 16) == []
    assert P.segments(P.ranks(w[:100] + w[10:40] + w[200:]), 16) == [(10, 40), (100, 130)]


def test_longest_texts():
    w = [b"%d" % (k % 30_011) for k in range(100_000)]
    assert P.runs_of(P.ranks(w)) == [(0, 100_000, 30_011)]
    assert P.runs_of(P.ranks([b"a"] * 300_000)) == [(0, 300_000, 1)]


def plain_digest(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = every_period(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_query_equals_plain_python(spark):
    r = random.Random(6)
    rows = [(k, " ".join(x.decode() for x in periodic(r, r.randint(0, 150), 4)).replace(" ", r.choice([" ", "\n", "\x0b ", "\t"]))) for k in range(200)]
    rows += [(900, None), (901, ""), (902, " \n "), (20, "x " * 24), (20, "x " * 24), (903, "a b " * 30), (904, "über \x1c " * 20), (None, "y " * 30)]
    got = sorted(map(tuple, P.report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()), key=repr)
    want = sorted((plain_digest(*x) if x[0] is not None else (None, 1, 0, 30, 1, 30_000, hashlib.sha256(b"0,30,1\n").hexdigest(), hashlib.sha256(b"y").hexdigest()) for x in rows), key=repr)
    assert got == want


def test_query_equals_plain_python_on_the_fixture(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").where("length(text) < 3000 or text is null").collect()
    got = {r["doc_id"]: tuple(r) for r in P.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i] == plain_digest(i, t) for i, t in map(tuple, rows))


def test_detected_keeps_columns_and_cuts_periods(spark):
    schema = "doc_id bigint, text string, runs string, text_before int"
    rows = [(1, "start " + "a b c " * 10 + "end", "mine", 5), (2, "no  runs\nhere", "mine", None), (3, None, None, None)]
    got = {r["doc_id"]: r for r in P.detected(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["text"] == "start a b c end" and [tuple(x) for x in got[1]["runs"]] == [(1, 30, 3)] and got[1]["text_before"] == 5
    assert got[2]["text"] == "no  runs\nhere" and got[2]["runs"] == [] and got[3]["text"] is None
    assert P.detected(spark.createDataFrame([], schema)).collect() == []
    assert P.report(spark.createDataFrame([], schema)).collect() == []
