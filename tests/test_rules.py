"""Rule predicates and path algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import rules as R


def test_suffix_needs_a_base_and_a_literal(spark):
    calls = spark.createDataFrame([(1, "/orders/7"), (2, "/{x}"), (3, "/v1/orders")], "id int, name string")
    routes = spark.createDataFrame([("a", "/api/v1/orders/{id}"), ("b", "/shop/orders/7"), ("c", "/api/{y}"), ("d", "/api/v1/orders")], "id string, name string")
    assert {tuple(r) for r in R.suffix_match(calls, routes).collect()} == {(1, "a"), (3, "d")}


def test_predicates(spark):
    df = spark.createDataFrame([("JwtGuard", "int", "decimal", "/api/login"), ("ThrottleRole", "bool", "int", "/ping"), ("Rate", None, "int", "/x")], "guard string, client string, server string, path string")
    rows = df.select(R.is_auth_guard(F.col("guard"), ["^Ra"]).alias("auth"), R.compatible(F.col("client"), F.col("server")).alias("fits"), R.public_reason(F.col("path")).alias("why")).collect()
    assert [tuple(r) for r in rows] == [(True, False, "sign-in / sign-up / password reset"), (False, False, "health check"), (True, True, None)]


def test_receivers_and_chains(spark):
    e = spark.createDataFrame([("a", ["T"]), ("b", ["U"]), ("c", []), ("d", None)], "src string, recv array<string>")
    assert [r["src"] for r in R.narrowed(e, F.array(F.lit("T"))).collect()] == ["a", "c", "d"]
    d = spark.createDataFrame([(["x", "y"], ["x", "z"]), (["x"], ["x"]), ([], ["q"])], "a array<string>, b array<string>")
    got = [tuple(r["d"]) for r in d.select(R.chain_difference(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [(1, "y", "z"), (1, None, None), (0, None, "q")]
    p = spark.createDataFrame([([("a", "CALLS"), ("b", "REFERS_TO"), ("c", "TEST_CALLS")],)], "path array<struct<from:string,kind:string>>")
    assert p.select(R.app_depth(F.col("path")).alias("n")).first()["n"] == 1
