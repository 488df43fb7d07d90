"""Counts against plain Python, host verdicts against the moments written out, edge cases."""

from __future__ import annotations

import random
import re

from lattica.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_plain_python():
    r = random.Random(3)
    for _ in range(400):
        text = "".join(r.choice(["a", "b", "ü", "#", "<", " ", " ", "\n", "\t", "\x0b", "\x1c", " ", " ", "word "]) for _ in range(r.randint(0, 120)))
        if r.random() < 0.5:
            text += text[: r.randint(0, 100)]
        assert Q.counts_of(text.encode()) == plain(text), text


def rates(rows, rules=Q.Rules()):
    """Refused hosts by the docstring's equation."""
    hosts = {}
    for host, failed in rows:
        if host is not None:
            n, f = hosts.get(host, (0, 0))
            hosts[host] = n + 1, f + failed
    total = sum(n for n, _ in hosts.values())
    m = sum(f for _, f in hosts.values()) / total
    spread = sum(n * (f / n - m) ** 2 for n, f in hosts.values())
    if not 0 < m < 1 or spread <= m * (1 - m) * len(hosts) or total <= len(hosts):
        return set()
    s = max((total - len(hosts)) / (spread / (m * (1 - m)) - len(hosts)) - 1, 0)
    out = set()
    for h, (n, f) in hosts.items():
        a, b = f + m * s, n - f + (1 - m) * s
        rate = a / (a + b)
        if rate - rules.deviations * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5 > max(rules.max_host_rate, m):
            out.add(h)
    return out


def corpus():
    r = random.Random(4)
    good = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(30))
    out = []
    for host, n, bad in (("clean", 60, 0.05), ("fair", 60, 0.3), ("junk", 60, 0.95), ("tiny", 2, 1.0), ("other", 50, 0.1), (None, 12, 1.0)):
        out += [(len(out) + k, host, "too short" if r.random() < bad else good()) for k in range(n)]
    return out


def test_hosts_are_judged_by_shrunk_rates(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(4)
    got = {r["doc_id"]: r for r in Q.report(df).collect()}
    refused = rates([(h, len(t.split()) < 20) for _, h, t in rows])
    assert refused == {"junk"}  # not the host of two failing texts
    for i, host, text in rows:
        assert got[i]["base_failed"] == (len(text.split()) < 20)
        assert got[i]["host_refused"] == (host in refused)
        assert got[i]["kept"] == (not got[i]["base_failed"] and host not in refused)


def test_alike_hosts_refuse_nobody(spark):
    rows = [(k, f"h{k % 5}", "short" if k // 5 % 10 < 8 else " ".join(f"x{j}" for j in range(25))) for k in range(500)]
    got = Q.report(spark.createDataFrame(rows, "doc_id bigint, source string, text string"))
    assert got.where("host_refused").count() == 0 and got.where("kept").count() == 100


def test_refused_hosts_join_by_a_shuffle_and_rates_are_given(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), "doc_id bigint, source string, text string")
    whole = sorted(map(tuple, Q.report(df).collect()))
    monkeypatch.setattr(Q, "BROADCAST_HOSTS", 0)
    assert sorted(map(tuple, Q.report(df).collect())) == whole
    table = {r["host"]: r for r in Q.host_rates(Q.judged(df), "source").collect()}
    assert table["tiny"]["rate"] < 1 and table["junk"]["refused"] and None not in table


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    schema = "doc_id bigint, source string, text string, kept string, n_words string, extra int"
    rows = [(1, None, None, "k", "n", 1), (1, None, None, "k", "n", 1), (None, "s", "", "k", "n", 2), (2, "s", "a " * 10 + "b " * 30, "k", "n", None)]
    out = Q.judged(spark.createDataFrame(rows, schema))
    got = sorted(map(tuple, out.select("doc_id", "n_words", "kept", "extra").collect()), key=repr)
    assert got == [(1, 0, False, 1), (1, 0, False, 1), (2, 40, False, None), (None, 0, False, 2)]
    assert Q.report(spark.createDataFrame([], "doc_id bigint, source string, text string")).collect() == []
    assert Q.report(spark.createDataFrame([(1, None, None)], "doc_id bigint, source string, text string")).count() == 1


def test_very_long_text_counts_whole():
    text = ("abc " * 200_000 + "\n") * 2
    assert Q.counts_of(text.encode()) == (400_000, 1_200_000, 0, 1, 400_000)
