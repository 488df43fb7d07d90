"""Registered queries against their oracle SQL on a small fixture with nulls, ties and repeats."""

from __future__ import annotations

import pytest

from lattica.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(spark, folder, oracle, rows, name):
    assert rows(queries.queries()[name](spark, folder)) == oracle(queries.oracle_sql()[name])


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries() if q.startswith("op")) == list(range(1, 14))
