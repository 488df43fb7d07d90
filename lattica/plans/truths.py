"""Scalar functions and sources on stated inputs; the oracle is the stated answers, taken from the rules by reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import matchers as M
from lattica.functions import platforms as P
from lattica.functions import text as X
from lattica.operators import joins as J
from lattica.operators import rules, scan
from lattica.operators import traverse as G
from lattica.plans.registry import on_graph, query
from lattica.plans.traversal import PROPAGATES, ids, up, walk_sql
from lattica.sources import graph
from lattica.sources.fixture import edges, nodes, read, to_save
from lattica.storage import shared_dir

#: matcher, what is sent, what is received, whether they match.
MATCHES = [
    ("path", "/orders/42", "/orders/{id}", True), ("path", "/orders/{x}", "/orders/{id}", True), ("path", "/orders", "/users", False), ("path", "/a/b/c", "/a/{rest*}", True), ("path", "/x", "/{id}", False),
    ("mqtt", "devices/7/state", "devices/+/state", True), ("mqtt", "devices", "devices/#", True), ("mqtt", "a/b", "a/#/b", False), ("nats", "a.b", "a.>", True), ("nats", "a", "a.>", False), ("nats", "a.b.c", "a.*.c", True),
    ("amqp_topic", "a.c", "a.#.c", True), ("amqp_topic", "a.x.y.c", "a.#.c", True), ("amqp_topic", "a.b", "*.*.*", False), ("glob", "order.created", "order.*", True), ("glob", "axb", "a.b", False), ("template", "order:42", "order:{id}", True),
    ("template", "order:", "order:{id}", False), ("mcp", "srv/read", "srv/read", True), ("mcp", "other/read", "srv/read", False), ("amqp", "ex/a.b", "ex/a.*", True), ("amqp", "ex/a.b", "other/a.*", False), ("webhook", "app:paid", "hmac:paid", True),
    ("webhook", "app:paid", "other:paid", False), ("extension", "port:a", "port:*", True), ("extension", "port:a", "*", False), ("exact", "a", "a", True), ("exact", "a", "A", False), ("dotted", "orders.{id}", "orders.{x}", True), ("dotted", "orders.1", "orders.1.2", False),
]

#: function, input, answer as text.
NAMES = [
    ("page_pattern", "/a/[id]/[...rest]/:x", "/a/{id}/{rest*}/{x}"), ("endpoint_name", "/a/${id}/{{ b }}/:c", "/a/{id}/{b}/{c}"), ("is_pattern", "a/{x}", "true"), ("is_pattern", "a/x", "false"), ("snake", "ApiKeyGuard", "api_key_guard"),
    ("head_token", "findHTTPServer", "server"), ("concept_forms", "Categories", "categories,category"), ("concept_forms", "box", "box,boxes"), ("canonical_key", "a_b[0].Cd", "ab,*,cd"), ("parity_name", "OrderListVM", "orderlistviewmodel"),
    ("parity_member", "_getName", "name"), ("route_variants", "orders/1/", "/orders/1,/api/orders/1"), ("auth_name", "requireAdmin", "true"), ("auth_name", "adminName", "false"), ("secret_key", "DB_PASSWORD", "true"), ("secret_key", "stripeApiKey", "true"),
    ("secret_key", "cache.key", "false"), ("secret_key", "app.key", "true"), ("secret_key", "session_token", "true"), ("secret_key", "csrf_token", "false"), ("secret_key", "PUBLIC_KEY", "false"), ("secret_key", "db.dsn", "true"), ("secret_key", "login.pass", "true"),
    ("secret_key", "password_hint", "false"), ("placeholder", "%(user)s", "true"), ("placeholder", "<token>", "true"), ("placeholder", "$HOME", "true"), ("placeholder", "hunter2", "false"), ("placeholder", "None", "true"), ("world_writable", "0o666", "true"),
    ("world_writable", "0644", "false"), ("world_writable", "a+rw", "true"), ("world_writable", "u+w", "false"), ("method_head", "get|post", "true"), ("method_put", "GET", "false"), ("is_auth_guard", "JwtGuard", "true"), ("is_auth_guard", "ThrottlerGuard", "false"),
    ("public_reason", "/api/readyz", "health check"), ("public_reason", "/swagger.json", "API schema / documentation"), ("public_reason", "/orders", "null"), ("origin_text", '{"base_env": "SHOP_API_URL"}', "SHOP_API_URL"), ("origin_fits", "SHOP_API_URL", "true"), ("origin_fits", "CART_API_URL", "false"),
    ("glob_node", "web/node_modules/a.js", "true"), ("glob_dist", "dist/a.js", "true"), ("glob_dist", "web/dist/a.js", "false"), ("glob_deep", "src/a/b/c.ts", "true"), ("glob_deep", "lib/a.ts", "false"),
]


def _values(rows) -> str:
    said = lambda v: str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(said, r))})" for r in rows)


@query(f"SELECT * FROM (VALUES {_values(MATCHES)}) v(matcher, sent, received, ok)")
def matcher_truths(spark, sf_dir):
    """Every matcher on cases that its rules decide."""
    rows = spark.createDataFrame([r[:3] for r in MATCHES], "matcher string, sent string, received string")
    ok = F.lit(None).cast("boolean")
    for name in sorted({r[0] for r in MATCHES}):
        ok = F.when(F.col("matcher") == name, M.MATCHERS[name](F.col("sent"), F.col("received"))["ok"]).otherwise(ok)
    return rows.select("matcher", "sent", "received", ok.alias("ok"))


@query(f"SELECT * FROM (VALUES {_values(NAMES)}) v(f, given, answer)")
def name_truths(spark, sf_dir):
    """X5, X6, X7, X8, X9, X10, X11, X24, X25, X28, X30, X31, X32, X35, X36, X41, F24, F25, F26, SC12, SC13: names, keys, modes and paths."""
    x = F.col("given")
    fits = lambda pattern: x.rlike(scan.glob_regex(pattern))
    answers = {
        "page_pattern": X.page_pattern(x), "endpoint_name": X.endpoint_name(x), "is_pattern": X.is_pattern(x), "snake": X.snake(x), "head_token": X.head_token(x), "concept_forms": F.array_join(X.concept_forms(x), ","), "canonical_key": F.array_join(X.canonical_key(x), ","),
        "parity_name": X.parity_name(x), "parity_member": X.parity_member(x), "route_variants": F.array_join(X.route_variants(x), ","), "auth_name": X.auth_name(x), "secret_key": X.secret_key(x), "placeholder": X.placeholder(x), "world_writable": X.world_writable(x),
        "method_head": X.method_ok(F.lit("HEAD"), x), "method_put": X.method_ok(F.lit("PUT"), x), "is_auth_guard": rules.is_auth_guard(x), "public_reason": F.coalesce(rules.public_reason(x), F.lit("null")), "origin_text": X.origin_text(x), "origin_fits": X.origin_fits(x, F.lit("shop-api")),
        "glob_node": fits("node_modules"), "glob_dist": fits("/dist"), "glob_deep": fits("src/**/*.ts"),
    }
    out = F.lit(None).cast("string")
    for name, column in answers.items():
        out = F.when(F.col("f") == name, column.cast("string")).otherwise(out)
    return spark.createDataFrame([r[:2] for r in NAMES], "f string, given string").select("f", "given", out.alias("answer"))


def saved(spark, sf_dir) -> str:
    path = f"{shared_dir(spark)}/lattica-saved-graph"
    n, e, tasks = to_save(spark, sf_dir)
    graph.save(n, e, path, {"source": sf_dir, "version": 2}, tasks)
    return path


@query(on_graph("SELECT e.kind, true AS propagates, count(*) AS n FROM edges e WHERE e.kind <> 'EXTENDS' GROUP BY e.kind UNION ALL SELECT 'EXTENDS', false, count(*) FROM edges WHERE kind = 'EXTENDS'"))
def saved_graph(spark, sf_dir):
    """SC2, SC5, SC6, T6: a graph saved as one version, asked in SQL with its table of edge kinds."""
    return graph.sql(spark, saved(spark, sf_dir), "SELECT e.kind, k.propagates, count(*) AS n FROM edges e JOIN edge_kinds k USING (kind) GROUP BY e.kind, k.propagates")


@query(on_graph("SELECT id, name, file FROM nodes WHERE id = 'function:12'"))
def node_lookup(spark, sf_dir):
    """SC4, SC25: one node of a saved graph, found through the registry."""
    path = saved(spark, sf_dir)
    n, _ = graph.Registry(spark, {"shop": path}, {"shop": "/work/shop"}).open(place="/work/shop/a.py")
    return n.where("id = 'function:12'").select("id", "name", "file")


@query(on_graph("SELECT src, dst, kind FROM edges WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)", walk_sql("walk", "SELECT 'table:2' AS id", up(PROPAGATES)) + ", near AS (SELECT id FROM walk ORDER BY depth, id LIMIT 60)"))
def view_graph(spark, sf_dir):
    """SK5, O7: the edges among the sixty nodes nearest to a table; the limit is the view's."""
    e = edges(spark, sf_dir)
    closure = G.reverse_closure(G.walkable(e), ids(spark, "table:2"))
    return graph.subgraph(nodes(spark, sf_dir), e, closure, 60)[1].select("src", "dst", "kind")


@query("""SELECT 'src/m' || (event_id % 40) || '.py' AS path, (event_id % 300 + 1)::INT AS lo, (event_id % 300 + greatest(event_id % 4, 1))::INT AS hi, count(*) AS n FROM events GROUP BY ALL""")
def diff_hunks(spark, sf_dir):
    """SC17, SC18: hunks of unified diffs as changed line ranges."""
    e = F.col("event_id")
    text = F.format_string("diff --git a/x b/x\n--- a/src/m%d.py\n+++ b/src/m%d.py\n@@ -1,2 +%d,%d @@ def f():\n+x\n-- %d", e % 40, e % 40, e % 300 + 1, e % 4, e)
    return graph.diff_ranges(read(spark, sf_dir, "events").select(text.alias("text"))).groupBy("path", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))


@query(on_graph("""SELECT '{"id":"' || id || '","kind":"' || kind || '","line":' || line || '}' AS json FROM nodes WHERE kind = 'function'"""))
def json_rows(spark, sf_dir):
    """SK1: rows as JSON."""
    return graph.to_json_rows(nodes(spark, sf_dir).where("kind = 'function'").select("id", "kind", "line"))


@query(on_graph("""SELECT '{"ruleId":"unguarded","level":"warning","message":{"text":"' || name || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || file || '"},"region":{"startLine":' || line || '}}}]}' AS result FROM nodes WHERE kind = 'function'"""))
def sarif_rows(spark, sf_dir):
    """SK2: findings as SARIF results."""
    found = nodes(spark, sf_dir).where("kind = 'function'").select(F.lit("unguarded").alias("finding"), F.col("id").alias("node"), "file", "line", F.col("name").alias("detail"))
    return graph.to_sarif(found)


@query(on_graph("""SELECT n.kind, count(*) AS n, count(*) FILTER (file IN ('src/m3.py', 'src/m4.py')) AS generated FROM nodes n GROUP BY n.kind"""))
def generated_marked(spark, sf_dir):
    """SC14, SC15: nodes of generated files, marked."""
    files = spark.createDataFrame([(f"src/m{k}.py", "# @generated by a tool" if k in (3, 4) else "x = 1") for k in range(40)], "path string, text string")
    made = files.where(scan.generated(F.col("text"), F.col("path")))
    n, _ = scan.without_generated(nodes(spark, sf_dir), edges(spark, sf_dir), made, label=True)
    return n.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("generated").alias("generated"))


@query(on_graph("SELECT kind, count(*) AS n FROM edges WHERE coalesce(file, '') <> '1996-05' AND src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY kind", "gone AS (SELECT id FROM nodes WHERE file = 'src/m5.py')"))
def generated_dropped(spark, sf_dir):
    """SC15: edges that stay when generated files go."""
    made = spark.createDataFrame([("src/m5.py",), ("1996-05",)], "path string")
    _, e = scan.without_generated(nodes(spark, sf_dir), edges(spark, sf_dir), made)
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


#: condition, and on which targets it holds, doesn't, or may.
CONDITIONS = [
    ("defined(_WIN32)", "windows", "linux android macos ios web"), ("!defined(_WIN32) && defined(__APPLE__)", "macos ios", "windows linux android web"), ("defined __linux__ || defined(__APPLE__)", "linux android macos ios", "windows web"),
    ("TARGET_OS_IPHONE == 1", "ios", "windows linux android macos web"), ("defined(FEATURE)", "", ""), ("defined(FEATURE) && defined(_WIN32)", "", "linux android macos ios web"), ("defined(__FreeBSD__)", "", "windows linux android macos ios web"),
    ("(defined(__unix__) && !defined(__ANDROID__)) || TARGET_OS_OSX", "linux macos web", "windows android ios"), ("_MSC_VER >= 1900", "", "linux android macos ios web"), ("defined(", "", ""), ("A ? B : C", "", ""),
]


@query(f"SELECT given, target, CASE WHEN list_contains(string_split(yes, ' '), target) THEN true WHEN list_contains(string_split(no, ' '), target) THEN false END AS holds FROM (VALUES {_values(CONDITIONS)}) v(given, yes, no), (SELECT unnest(['windows', 'linux', 'android', 'macos', 'ios', 'web']) AS target)")
def condition_truths(spark, sf_dir):
    """Preprocessor conditions on each target: true, false or unknown."""
    rows = spark.createDataFrame([r[:1] for r in CONDITIONS], "given string")
    out = None
    for target in P.MACROS:
        one = rows.select("given", F.lit(target).alias("target"), P.condition(F.col("given"), target).alias("holds"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH p AS (SELECT DISTINCT user_id % 9 AS k FROM events), v AS (SELECT DISTINCT event_id % 60 AS t, user_id % 12 AS k, event_type FROM events)
SELECT DISTINCT 'test:' || t AS src, CASE WHEN event_type = 'view' THEN 'page:home' WHEN event_type = 'click' THEN 'page:new' ELSE 'page:shop' || k END AS page, 'exact' AS confidence FROM v WHERE event_type IN ('view', 'click') OR k < 9""")
def test_visits(spark, sf_dir):
    """Pages that the visits of tests open: the most literal pattern that fits."""
    e = read(spark, sf_dir, "events")
    pages = e.select(F.concat(F.lit("page:shop"), F.col("user_id") % 9).alias("id"), F.concat(F.lit("/shop"), F.col("user_id") % 9, F.lit("/{id}")).alias("name")).distinct()
    pages = pages.unionByName(spark.createDataFrame([("page:home", "/"), ("page:new", "/orders/new"), ("page:order", "/orders/{id}")], "id string, name string"))
    url = F.when(F.col("event_type") == "view", "https://example.org?x=1").when(F.col("event_type") == "click", "orders/new#top").otherwise(F.concat(F.lit("{BASE}/shop"), F.col("user_id") % 12, F.lit("/7?tab=2")))
    return J.visited_pages(e.select(F.concat(F.lit("test:"), F.col("event_id") % 60).alias("src"), url.alias("url")), pages)


@query("""WITH f AS (SELECT p_partkey AS k, 'shop.m' || (p_partkey % 7) || '.' || CASE WHEN p_partkey % 5 = 0 THEN '_' ELSE '' END || 'run' || p_partkey AS name FROM part), j AS (SELECT DISTINCT user_id AS k FROM events)
SELECT 'job:' || j.k AS job, 'function:' || f.k AS function FROM j JOIN f ON f.name = 'shop.m' || (j.k % 7) || '.run' || j.k UNION ALL SELECT 'job:t' || t.k, 'function:' || f.k FROM (SELECT DISTINCT event_id % 7 AS k FROM events) t JOIN f ON f.k % 7 = t.k AND f.k % 5 <> 0""")
def jobs_by_import_path(spark, sf_dir):
    """Jobs that nothing receives, by the dotted path of the function they name."""
    p = F.col("p_partkey")
    functions = read(spark, sf_dir, "part").select(F.concat(F.lit("function:"), p).alias("id"), F.concat(F.lit("shop.m"), p % 7, F.lit("."), F.when(p % 5 == 0, "_").otherwise(""), F.lit("run"), p).alias("name"))
    e, u = read(spark, sf_dir, "events"), F.col("user_id")
    jobs = e.select(F.concat(F.lit("job:"), u).alias("id"), F.concat(F.lit("shop.m"), u % 7, F.lit(".run"), u).alias("name")).distinct()
    templates = e.select(F.concat(F.lit("job:t"), F.col("event_id") % 7).alias("id"), F.concat(F.lit("shop.m"), F.col("event_id") % 7, F.lit(".run{n}")).alias("name")).distinct()
    return J.by_import_path(jobs.unionByName(templates), functions)


@query("SELECT 'app' || n_regionkey || '/compose.yml' AS file, 'svc' || n_nationkey AS service, CASE WHEN n_nationkey % 2 = 0 THEN 'shop/' || lower(replace(n_name, ' ', '-')) || ':1' END AS image, [(8000 + n_nationkey) || ':80'] AS ports, list_sort(['MODE: fast', 'TOKEN_' || n_nationkey || ': x']) AS environment FROM nation")
def compose_services(spark, sf_dir):
    """SC20: services of compose files with image, ports and environment."""
    k = F.col("n_nationkey")
    text = F.concat(F.lit("  svc"), k, F.lit(":\n"), F.when(k % 2 == 0, F.concat(F.lit('    image: "shop/'), F.lower(F.regexp_replace("n_name", " ", "-")), F.lit(':1"\n'))).otherwise("    # built here\n    build: .\n"), F.lit('    ports:\n      - "'), k + 8000, F.lit(':80"\n    environment:\n      MODE: fast\n      TOKEN_'), k, F.lit(": x\n"))
    files = read(spark, sf_dir, "nation").groupBy(F.concat(F.lit("app"), "n_regionkey", F.lit("/compose.yml")).alias("path")).agg(F.concat(F.lit("version: '3'\nservices:\n"), F.array_join(F.array_sort(F.collect_list(text)), ""), F.lit("volumes:\n  data:\n    x: y\n")).alias("text"))
    return graph.compose_services(files)
