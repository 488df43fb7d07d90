"""Rule predicates over routes, guards, payload types, findings and platforms, and small path algebra."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.matchers import PARAM, match_path, segments
from lattica.functions.text import canonical_key, words

# Which kinds of a server fit a client's kind, beside an equal one.
COMPATIBLE = {"number": ["int", "float", "decimal"], "float": ["int", "number", "decimal"], "int": ["number"], "str": ["decimal", "enum"], "datetime": ["str", "decimal", "enum"], "enum": ["str", "decimal"], "object": ["dict"]}
# Whole path segments by which a route is public by design.
PUBLIC = {
    "sign-in / sign-up / password reset": "login logout signin sign-in signout sign-out signup sign-up register registration forgot-password forgot_password forgot password-reset reset-password password_reset reset_password verify-email verify_email confirm-email csrf csrf-token",
    "health check": "health healthz healthcheck health-check health_check ready readyz readiness live livez liveness ping status up alive",
    "robots / sitemap / favicon / manifest": "robots.txt sitemap.xml favicon.ico opensearch.xml manifest.json manifest.webmanifest security.txt humans.txt ads.txt browserconfig.xml",
    "static assets": "static assets public media _next locales fonts images img css js dist",
    "jwks / .well-known": ".well-known jwks jwks.json",
    "OAuth / OIDC callback or token endpoint": "oauth oauth2 oidc openid openid-configuration callback callbacks authorize sso saml nextauth",
    "media / thumbnails": "thumbnail thumbnails image avatar avatars favicon favicons emoji logo",
    "API schema / documentation": "swagger swagger-ui redoc openapi openapi.json openapi.yaml openapi.yml api-docs apidocs",
    "utility endpoint (version / client IP / geolocation)": "version ip geolocation whoami-public",
    "scheduled job endpoint (cron key)": "cron",
    "embed pages": "embeds",
}
#: Reported, but at low severity.
LOW = {"metrics endpoint": "metrics prometheus stats"}
NEVER_AUTH = ["throttle", "cors", "csrf", "locale", "trim", "cache"]


def route_spec(nodes: DataFrame, verb: str, path: str) -> DataFrame:
    """Routes of a verb whose path equals one segment by segment, parameters being alike."""
    hole = lambda s: F.transform(segments(s), lambda x: F.when(x.rlike(PARAM), "{}").otherwise(x))
    parts = F.split("name", " ")
    return nodes.where((F.col("kind") == "route") & (F.upper(parts[0]) == verb.upper()) & (hole(F.try_element_at(parts, F.lit(2))) == hole(F.lit(path))))


def suffix_match(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """sender, receiver: paths that equal the end of a longer route, when what is left before it is only a base such as api or v1.

    Segments that are free of parameters on both sides must be equal. Where a path has parameters is its mask; for each pair
    of masks that occur (few) the paths meet by all the other segments.
    """
    c = calls.select(F.col("id").alias("sender"), F.col("name").alias("s"), segments(F.col("name")).alias("ss")).withColumn("n", F.size("ss"))
    r = routes.select(F.col("id").alias("receiver"), segments(F.col("name")).alias("rs"))
    ends = r.select("receiver", "rs", F.explode(F.sequence(F.lit(1), F.greatest(F.size("rs") - 1, F.lit(1)))).alias("drop")).where("drop < size(rs)")
    base = F.forall(F.slice("rs", F.lit(1), F.col("drop")), lambda x: x.rlike(r"(?i)^(api|v\d+)$"))
    ends = ends.where(base).select("receiver", F.concat(F.lit("/"), F.array_join(F.slice("rs", F.col("drop") + 1, F.size("rs")), "/")).alias("tail"), (F.size("rs") - F.col("drop")).alias("n"))
    mask = lambda x: F.array_join(F.transform(x, lambda p: F.when(p.rlike(r"\{[^{}]*\}"), "1").otherwise("0")), "")
    c = c.withColumn("sm", mask(F.col("ss")))
    ends = ends.withColumn("ts", segments(F.col("tail"))).withColumn("tm", mask(F.col("ts")))
    free = lambda x: F.array_join(F.transform(x, lambda p, i: F.when((F.substr("sm", i + 1, F.lit(1)) == "1") | (F.substr("tm", i + 1, F.lit(1)) == "1"), "").otherwise(p)), "/")
    left = c.join(ends.select("n", "tm").distinct(), "n").withColumn("k", free(F.col("ss"))).drop("ss")
    right = ends.join(c.select("n", "sm").distinct(), "n").withColumn("k", free(F.col("ts"))).drop("ts", "rs")
    m = match_path(F.col("s"), F.col("tail"))
    return left.join(right, ["n", "sm", "tm", "k"]).withColumn("m", m).where("m.ok and m.lit > 0").select("sender", "receiver").distinct()


def is_auth_guard(name: Column, patterns: Iterable[str] = ()) -> Column:
    """A guard's name that speaks of authentication, by its words or a project's patterns, and is none that never does."""
    w = words(name)
    own = F.lit(False)
    for p in patterns:
        own = own | name.rlike(p)
    return (own | F.arrays_overlap(w, F.array(*(F.lit(x) for x in ("auth", "authenticate", "jwt", "session", "permission", "role", "admin", "token", "login"))))) & ~F.arrays_overlap(w, F.array(*(F.lit(x) for x in NEVER_AUTH)))


def public_reason(path: Column, of: dict[str, str] | None = None) -> Column:
    """Why a route is public by design: the first reason that one of its path's segments, or one before a dot, names."""
    found = F.array_distinct(F.flatten(F.transform(segments(F.lower(path)), lambda s: F.array(s, F.regexp_replace(s, r"\.[^.]*$", "")))))
    out = F.when(F.lower(path) == "/", "site root")
    for reason, names in (of or PUBLIC).items():
        out = out.when(F.arrays_overlap(found, F.array(*(F.lit(n) for n in names.split()))), reason)
    return out


def compatible(client: Column, server: Column, cast: Column | None = None) -> Column:
    """Whether a client's kind fits a server's; what isn't known fits. A whole number read `as double` fails on the client."""
    out = F.when(client.isNull() | server.isNull() | (client == "any") | server.isin("any", "null") | (client == server), True)
    strict = F.coalesce(F.regexp_replace(cast, r"\?$", "") == "double", F.lit(False)) if cast is not None else F.lit(False)
    for kind, fits in COMPATIBLE.items():
        out = out.when(client == kind, server.isin(fits) & (~strict if kind == "float" else F.lit(True)))
    return out.otherwise(False)


def ignored(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings that no rule (mark, or path as a pattern) leaves out."""
    by_mark = findings.join(rules.where("mark is not null").select("mark").distinct(), "mark", "left_anti")
    paths = [r["path"] for r in rules.where("path is not null").select("path").distinct().collect()]  # a configuration's patterns
    keep = F.lit(True)
    for p in paths:
        keep = keep & ~F.coalesce(F.col("file").rlike(p), F.lit(False))
    return by_mark.where(keep)


def without_platform(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that aren't certainly left out (column `fits` false), and no edge of a node that is."""
    out = nodes.where(F.col("fits").eqNullSafe(F.lit(False))).select("id")
    kept = edges.where(~F.col("fits").eqNullSafe(F.lit(False)))
    for end in ("src", "dst"):
        kept = kept.join(out.withColumnRenamed("id", end), end, "left_anti")
    return nodes.join(out, "id", "left_anti"), kept


def app_depth(path: Column, wiring: Iterable[str] = ("REFERS_TO", "CONTAINS", "BOUND_TO")) -> Column:
    """Hops of a path that aren't wiring or tests."""
    return F.size(F.filter(path, lambda h: ~h["kind"].isin(list(wiring)) & ~h["kind"].startswith("TEST_")))


def chain_difference(a: Column, b: Column) -> Column:
    """Length of the common start of two chains, and the step after it on either side."""
    same = F.zip_with(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b))), lambda x, y: x == y)
    n = F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same)).cast("int")
    return F.struct(n.alias("common"), F.try_element_at(a, n + 1).alias("next_a"), F.try_element_at(b, n + 1).alias("next_b"))


def forwarding_gaps(calls: DataFrame) -> DataFrame:
    """Calls (id, sent, known) with the keys they send that aren't known; where what is known is open, none."""
    return calls.select("id", F.when(F.col("known").isNotNull(), F.array_sort(F.array_except("sent", "known"))).alias("gap")).where(F.size("gap") > 0)


def narrowed(edges: DataFrame, allowed: Column) -> DataFrame:
    """Edges whose receiver types (recv) may be one of the allowed; untyped receivers stay."""
    return edges.where(F.col("recv").isNull() | (F.size("recv") == 0) | F.arrays_overlap("recv", allowed))


def isolate_tests(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of tests as test edges, which no traversal follows."""
    tests = nodes.where(F.col("entry_kind") == "test").select(F.col("id").alias("src"), F.lit(True).alias("_t"))
    kind = F.when(F.col("kind").isin("CALLS", "ROUTES_TO"), "TEST_CALLS").when(F.col("kind") == "HTTP_CALLS", "TEST_HTTP").otherwise("TEST_USES")
    return edges.join(tests, "src", "left").withColumn("kind", F.when(F.col("_t"), kind).otherwise(F.col("kind"))).drop("_t")


def in_repo(nodes: DataFrame, repo: str) -> DataFrame:
    """Nodes of one linked repository, by their attributes."""
    return nodes.where(F.get_json_object("attrs", "$.repo") == repo)


#: Kinds of nodes that stand for a class.
CLASS_KINDS = ["class", "interface", "trait", "enum", "struct", "protocol", "mixin", "extension", "object"]


def has_class_target(targets: DataFrame) -> DataFrame:
    """One row, has_class: whether any target (id) is like a class."""
    return targets.agg(F.coalesce(F.bool_or(F.substring_index("id", ":", 1).isin(CLASS_KINDS)), F.lit(False)).alias("has_class"))


def registered_callbacks(edges: DataFrame, routes: DataFrame) -> DataFrame:
    """src, route: who registers a route's address somewhere outside."""
    return edges.where("kind = 'REGISTERS_CALLBACK'").join(routes.select(F.col("id").alias("dst")), "dst").select("src", F.col("dst").alias("route")).distinct()


def table_columns(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """id: the targets, and the columns that target tables contain: who uses a column uses its table."""
    tables = targets.where(F.col("id").startswith("table:")).select(F.col("id").alias("src"))
    columns = edges.where((F.col("kind") == "CONTAINS") & F.col("dst").startswith("column:")).join(tables, "src", "left_semi").select(F.col("dst").alias("id"))
    return targets.select("id").unionByName(columns).distinct()


def payload_issues(sent: DataFrame, declared: DataFrame) -> DataFrame:
    """endpoint, key, issue, severity: keys that one side gives (endpoint, key, kind) against those that the other declares (endpoint, key, kind, required).

    `missing`: required and not given; `unknown`: given and not declared; `case`: declared in another spelling; `type`:
    a kind that doesn't fit. Keys are compared by their parts, an index being any. A request gives what the
    client sends, a response what the server answers.
    """
    parts = lambda c: F.array_join(canonical_key(F.col(c)), ".")
    a = sent.groupBy("endpoint", "key").agg(F.min("kind").alias("a_kind")).withColumn("c", parts("key")).withColumnRenamed("key", "a_key")
    b = declared.groupBy("endpoint", "key").agg(F.min("kind").alias("b_kind"), F.max("required").alias("required")).withColumn("c", parts("key")).withColumnRenamed("key", "b_key")
    exact = a.join(b.drop("c"), (a["endpoint"] == b["endpoint"]) & (F.regexp_replace("a_key", r"\[\d*\]", "[*]") == F.regexp_replace("b_key", r"\[\d*\]", "[*]")), "left").select(a["endpoint"], "a_key", "a_kind", "c", "b_key", "b_kind")
    known = exact.where("b_key is not null")
    wrong = known.where(~compatible(F.col("a_kind"), F.col("b_kind"))).select("endpoint", F.col("a_key").alias("key"), F.lit("type").alias("issue"))
    rest = exact.where("b_key is null").select("endpoint", "a_key", "c")
    folded = b.select("endpoint", "c", F.lit(True).alias("folds")).distinct()
    other = rest.join(folded, ["endpoint", "c"], "left").select("endpoint", F.col("a_key").alias("key"), F.when(F.col("folds"), "case").otherwise("unknown").alias("issue"))
    given = a.select("endpoint", "c").distinct()
    missing = b.where("required").join(given, ["endpoint", "c"], "left_anti").select("endpoint", F.col("b_key").alias("key"), F.lit("missing").alias("issue"))
    found = wrong.unionByName(other).unionByName(missing)
    severity = F.when(F.col("issue").isin("missing", "type"), "high").when(F.col("issue") == "case", "medium").otherwise("low")
    return found.withColumn("severity", severity)
