"""Truth tables of matchers and scalar functions."""

from __future__ import annotations

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from lattica import model
from lattica.functions import matchers as M
from lattica.functions import platforms as P
from lattica.functions import text as X

CASES = {
    "path": [("/orders/42", "/orders/{id}", True), ("/orders/{x}", "/orders/{id}", True), ("/orders", "/users", False), ("/a/b/c", "/a/{rest*}", True), ("/a", "/a/{rest*}", False), ("/a", "/a/{rest*?}", True), ("/x", "/{id}", False), ("/", "/", True), ("/a", "/a/{b?}", True), ("/x/export.csv", "/x/export.{format}", True), ("/export.csv", "/export.{format}", False), ("/a.b/c", "/{x}/c", True), ("/a/{x}", "/a/b", True), ("/a/b/c", "/a/b", False), ("/v1/file.{e}", "/v1/file.txt", True)],
    "mqtt": [("devices/7/state", "devices/+/state", True), ("devices", "devices/#", True), ("a/b", "a/#/b", False), ("a/b/c", "a/#", True), ("a/b", "a/b", True), ("a/b", "a", False), ("a/{x}", "a/b", True), ("a", "+/b", False)],
    "nats": [("a.b", "a.>", True), ("a", "a.>", False), ("a.b.c", "a.*.c", True), ("a.b.c.d", "a.*.c", False)],
    "amqp_topic": [("a.b.c", "a.*.c", True), ("a.c", "a.#.c", True), ("a.x.y.c", "a.#.c", True), ("a.b", "#", True), ("a.b", "*.*.*", False), ("a.b", "#.b", True), ("ab", "a.#", False)],
    "glob": [("order.created", "order.*", True), ("order.created", "order.?reated", True), ("order", "ord", False), ("a1", "a[0-9]", True), ("a.b", "a?b", True), ("axb", "a.b", False)],
    "template": [("order:42", "order:{id}", True), ("order:{x}", "order:42", True), ("order:", "order:{id}", False), ("a(b)", "a({x})", True), ("same", "same", True), ("other", "same", False)],
    "mcp": [("srv/read", "srv/read", True), ("*/notes://4", "srv/notes://{id}", True), ("other/read", "srv/read", False)],
    "amqp": [("ex/a.b", "ex/a.*", True), ("ex/a.b", "other/a.*", False), ("queue:q", "queue:q", True), ("plain", "plain", False)],
    "webhook": [("app:paid", "app:paid", True), ("app:paid", "hmac:paid", True), ("app:paid", "other:paid", False), ("app:{x}", "hmac:{x}", False)],
    "extension": [("port:a", "port:*", True), ("a", "port:*", False), ("port:a", "*", False), ("a", "*", True)],
    "exact": [("a", "a", True), ("a", "A", False)],
    "dotted": [("orders.{id}", "orders.{x}", True), ("orders.1", "orders.{x}", True), ("orders.1", "orders.1.2", False)],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_matcher(spark, name):
    df = spark.createDataFrame([(s, r, want) for s, r, want in CASES[name]], "s string, r string, want boolean")
    rows = df.select("s", "r", "want", M.MATCHERS[name](F.col("s"), F.col("r"))["ok"].alias("ok")).collect()
    assert [(x["s"], x["r"]) for x in rows if x["ok"] != x["want"]] == []


def test_every_protocol_has_a_matcher():
    assert len(model.PROTOCOLS) == 61 and {m for _, m, _ in model.PROTOCOLS.values()} <= set(M.MATCHERS)
    assert (len(model.PROPAGATING), len(model.NON_PROPAGATING)) == (54, 31) and sum(map(len, model.ENTRY_CLASSES.values())) == 22


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_redaction_is_keyed(spark):
    mark = lambda salt: value(spark, X.redaction_marker(F.lit("pässword"), salt))
    for salt in (b"a", b"k" * 100):
        assert mark(salt) == "redacted:hmac:" + hmac.new(salt, "pässword".encode(), hashlib.sha256).hexdigest()[:8]
    assert mark(b"a") == mark(b"a") != mark(b"b")
    assert value(spark, X.redact_url(F.lit("db://u:pw@h/x"), b"a")).startswith("db://u:redacted:hmac:")
    assert value(spark, X.redact_url(F.lit("db://h/x"), b"a")) == "db://h/x"
    both = value(spark, X.redact_url(F.lit("a://u:x1@h b://v:y2@k c://u:x1@m"), b"a"))
    assert "x1" not in both and "y2" not in both and both.count("redacted:hmac:") == 3 and both.startswith("a://u:redacted") and both.endswith("@m")
    for kept in ("db://u:${PW}@h", "db://u:redacted:hmac:0a1b@h", "", "no address"):
        assert value(spark, X.redact_url(F.lit(kept), b"a")) == kept
    assert value(spark, X.redact_url(F.lit(None).cast("string"), b"a")) is None


@pytest.mark.parametrize("column,want", [
    (lambda: X.page_pattern(F.lit("/a/[id]/[...rest]/:x")), "/a/{id}/{rest*}/{x}"),
    (lambda: X.endpoint_name(F.lit("/a/${id}/{{ b }}/:c")), "/a/{id}/{b}/{c}"),
    (lambda: X.snake(F.lit("ApiKeyGuard2")), "api_key_guard_2"),
    (lambda: X.head_token(F.lit("findHTTPServer")), "server"),
    (lambda: X.concept_forms(F.lit("Categories")), ["categories", "category"]),
    (lambda: X.concept_forms(F.lit("box")), ["box", "boxes"]),
    (lambda: X.canonical_key(F.lit("a_b[0].Cd")), ["ab", "*", "cd"]),
    (lambda: X.same_key(F.lit("items[3].userId"), F.lit("items.*.user_id")), True),
    (lambda: X.parity_name(F.lit("OrderListVM")), "orderlistviewmodel"),
    (lambda: X.parity_member(F.lit("_getName")), "name"),
    (lambda: X.same_shape(F.lit("/a/{x}"), F.lit("/a/{y}")), True),
    (lambda: X.auth_name(F.lit("requireAdmin")), True),
    (lambda: X.auth_name(F.lit("adminName")), False),
    (lambda: X.is_loopback(F.lit("127.0.0.9")), True),
    (lambda: X.is_loopback(F.lit("example.org")), False),
    (lambda: X.world_writable(F.lit("0o666")), True),
    (lambda: X.world_writable(F.lit("0644")), False),
    (lambda: X.line_of(F.lit("a\nb\nc"), F.lit(3)), 2),
    (lambda: X.secret_key(F.lit("DB_PASSWORD")), True),
    (lambda: X.secret_key(F.lit("stripeApiKey")), True),
    (lambda: X.secret_key(F.lit("passwordHint")), False),
    (lambda: X.placeholder(F.lit("${TOKEN}")), True),
    (lambda: X.method_ok(F.lit("HEAD"), F.lit("get|post")), True),
    (lambda: X.method_ok(F.lit("PUT"), F.lit("GET")), False),
    (lambda: X.route_variants(F.lit("orders/1/")), ["/orders/1", "/api/orders/1"]),
    (lambda: X.dsn(F.lit("postgres://u:p@h:5432/db?sslmode=require"))["port"], 5432),
    (lambda: P.all_of(F.array(F.lit(True), F.lit(None).cast("boolean"))), None),
    (lambda: P.all_of(F.array(F.lit(False), F.lit(None).cast("boolean"))), False),
    (lambda: P.any_of(F.array().cast("array<boolean>")), None),
    (lambda: P.all_of(F.array().cast("array<boolean>")), True),
    (lambda: P.atom(F.lit("os"), F.lit("Unix"), "ios"), True),
])
def test_scalar(spark, column, want):
    assert value(spark, column()) == want
