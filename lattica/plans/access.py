"""Reports over attributed facts that are derived from the star schema: each fact table is one text that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import reports as R
from lattica.plans.registry import on_graph, query
from lattica.plans.traversal import PROPAGATES, ids, walk_sql
from lattica.sources.fixture import edges, nodes, read

#: name: table, columns, condition.
FACTS = {
    "columns": ("lineitem", ["'function:' || l_partkey AS src", "CASE WHEN l_linenumber = 7 THEN 'table:' || (l_suppkey % 50) ELSE 'column:' || (l_suppkey % 50) || '.c' || (l_linenumber % 3) END AS dst", "CASE WHEN l_linenumber = 7 THEN CASE l_returnflag WHEN 'A' THEN 'WRITES_TABLE' ELSE 'READS_TABLE' END WHEN l_returnflag = 'A' THEN 'WRITES_COLUMN' WHEN l_returnflag = 'R' THEN 'READS_COLUMN' ELSE 'MENTIONS_COLUMN' END AS kind", "CAST(NULL AS STRING) AS file", "CAST(l_linenumber AS INT) AS line"], "l_partkey % 20 = 0"),
    "wires": ("events", ["CASE event_id % 4 WHEN 0 THEN 'event:' || event_type || (user_id % 9) WHEN 1 THEN 'route:' || (user_id % 12) WHEN 2 THEN 'channel_sub:' || (user_id % 30) ELSE 'channel_sub:x' || event_type END AS src", "'channel:' || (user_id % 25) AS dst", "CASE event_id % 4 WHEN 0 THEN 'BROADCASTS_ON' WHEN 1 THEN 'AUTHORIZES_CHANNEL' WHEN 2 THEN 'MATCHES_CHANNEL' ELSE 'LISTENS_FOR' END AS kind", "CASE WHEN event_id % 8 = 0 THEN '{\"visibility\": \"public\"}' END AS attrs"], "user_id % 25 < 20 OR event_id % 4 = 0"),
    "posts": ("events", ["CASE event_id % 3 WHEN 2 THEN 'endpoint:b' || (user_id % 40) ELSE 'function:' || user_id END AS src", "CASE event_id % 3 WHEN 2 THEN 'function:' || user_id ELSE 'endpoint:b' || (user_id % 40) END AS dst", "CASE event_id % 3 WHEN 0 THEN 'SENDS_TO' WHEN 1 THEN 'TEST_CALLS' ELSE 'RECEIVED_BY' END AS kind", "CASE WHEN event_id % 3 = 2 THEN CASE WHEN event_id % 2 = 0 THEN '{\"platform\": \"ios\"}' ELSE '{\"platform\": \"android\"}' END END AS attrs"], "(user_id % 40 < 20 OR event_id % 3 <> 0) AND (user_id % 40 < 30 OR event_id % 3 <> 2) AND NOT (user_id % 40 IN (5, 25) AND event_id % 3 = 1)"),
    "writes": ("lineitem", ["'property:State.p' || (l_partkey % 400) AS state", "'function:' || l_suppkey AS src", "'src/m' || (l_suppkey % 40) || '.py' AS file", "CAST(l_quantity AS INT) AS line", "CAST(l_quantity AS INT) + 2 AS end_line", "CASE WHEN l_linenumber = 1 THEN 'clamp' WHEN l_linenumber = 2 THEN 'round' END AS lossy", "CASE l_returnflag WHEN 'A' THEN 'lifecycle' WHEN 'R' THEN 'async' ELSE 'other' END AS how", "CASE WHEN l_linenumber = 3 THEN 'p' || (l_partkey % 400) || '.filter(x)' ELSE 'load' || (l_suppkey % 6) || '()' END AS value", "l_linenumber >= 5 AS resets"], "l_partkey % 400 < 120"),
    "reads": ("lineitem", ["'property:State.p' || (l_partkey % 400) AS state", "'src/m' || (l_suppkey % 40) || '.py' AS file", "CAST(l_quantity AS INT) AS line", "CASE WHEN l_linenumber = 4 THEN 'slider' WHEN l_linenumber = 5 THEN 'field' END AS seeds"], "l_partkey % 400 < 10"),
    "rules": ("supplier", ["'r' || s_suppkey AS rule", "CASE WHEN s_suppkey % 2 = 0 THEN 'edge' ELSE 'path' END AS type", "'function:' || (s_suppkey * 3) AS src", "'table:' || (s_suppkey % 20 + 1) AS dst", "'WRITES_TABLE' AS edge_kind"], "true"),
    "plan_nodes": ("customer", ["'function:' || (c_custkey * 2) AS id"], "c_custkey % 10 = 0"),
    "plan_edges": ("supplier", ["'function:' || s_suppkey AS src", "'table:' || (s_suppkey % 30 + 1) AS dst", "CASE WHEN s_suppkey % 2 = 0 THEN 'READS_TABLE' ELSE 'WRITES_TABLE' END AS kind"], "true"),
    "calls": ("events", ["CASE event_id % 2 WHEN 0 THEN 'function:' || user_id ELSE 'call:' || (user_id % 60) END AS src", "CASE event_id % 2 WHEN 0 THEN 'call:' || (event_id % 60) ELSE 'route:' || (user_id % 25) END AS dst", "CASE event_id % 2 WHEN 0 THEN 'HTTP_CALLS' ELSE 'MATCHES_ROUTE' END AS kind"], "true"),
    "defaults": ("events", ["'function:' || user_id AS src", "'function:' || (event_id % 50) AS dst", "'CALLS' AS kind", "'src/m.py' AS file", "CAST(event_id % 300 AS INT) AS line", "CASE WHEN event_id % 5 = 0 THEN '{\"default_arg\": \"' || event_type || '\"}' END AS attrs"], "true"),
    "sources": ("part", ["p_brand", "'function:' || p_partkey AS id", "p_size * 7 AS tokens", "p_retailprice AS score"], "true"),
    "middleware": ("orders", ["'route:' || o_orderkey AS route", "CASE WHEN o_orderkey % 3 = 0 THEN 'auth,log' ELSE 'log' END AS names"], "true"),
}


def fact(spark, sf_dir, name):
    table, columns, where = FACTS[name]
    return read(spark, sf_dir, table).where(where).selectExpr(*columns)


def facts_sql(*names: str) -> str:
    return ", ".join(f"{name} AS (SELECT {', '.join(columns)} FROM {table} WHERE {where})" for name in names for table, columns, where in [FACTS[name]])


ASKED = ["table:7", "table:8", "column:9.c1", "column:10.c2", "column:7.c0"]
TABLE_OF = "'table:' || regexp_extract(dst, '^column:(.*)[.][^.]*$', 1)"


def _access_sql(writers: bool) -> str:
    kind = "WRITES" if writers else "READS"
    at = "CASE WHEN dst LIKE 'column:%' THEN dst END AS at_column, file, line"
    parts = [f"SELECT dst AS target, 'column' AS grp, src, {at} FROM columns WHERE kind = '{kind}_COLUMN' AND dst IN (SELECT id FROM asked)", f"SELECT dst, 'table', src, {at} FROM columns WHERE kind = '{kind}_TABLE' AND dst IN (SELECT id FROM asked)", f"SELECT {TABLE_OF}, '{'table' if writers else 'column'}', src, {at} FROM columns WHERE kind = '{kind}_COLUMN' AND {TABLE_OF} IN (SELECT id FROM asked)"]
    if writers:
        parts.append(f"SELECT a.id, 'table_level', c.src, NULL, c.file, c.line FROM columns c JOIN asked a ON a.id LIKE 'column:%' AND c.dst = 'table:' || regexp_extract(a.id, '^column:(.*)[.][^.]*$', 1) WHERE c.kind = 'WRITES_TABLE' AND NOT EXISTS (SELECT 1 FROM columns x WHERE x.kind = 'WRITES_COLUMN' AND x.src = c.src AND 'table:' || regexp_extract(x.dst, '^column:(.*)[.][^.]*$', 1) = c.dst)")
    else:
        parts += [f"SELECT dst, 'mentions', src, {at} FROM columns WHERE kind = 'MENTIONS_COLUMN' AND dst IN (SELECT id FROM asked)", f"SELECT {TABLE_OF}, 'mentions', src, {at} FROM columns WHERE kind = 'MENTIONS_COLUMN' AND {TABLE_OF} IN (SELECT id FROM asked)"]
    return f"WITH {facts_sql('columns')}, asked AS (SELECT unnest({ASKED}) AS id) SELECT target, grp, at_column, count(*) AS sites, count(DISTINCT src) AS users FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


def _access(spark, sf_dir, writers):
    found = R.access(fact(spark, sf_dir, "columns"), ids(spark, *ASKED), writers)
    return found.groupBy("target", "grp", "at_column").agg(F.count(F.lit(1)).alias("sites"), F.count_distinct("src").alias("users"))


@query(_access_sql(False))
def readers_of(spark, sf_dir):
    """Readers of tables and columns by group: columns, the table itself, texts that mention one."""
    return _access(spark, sf_dir, False)


@query(_access_sql(True))
def writers_of(spark, sf_dir):
    """Writers, and table-level writes of functions that record no column."""
    return _access(spark, sf_dir, True)


@query(f"WITH {facts_sql('defaults')} SELECT src, dst, file, line, json_extract_string(attrs, '$.default_arg') AS param FROM defaults WHERE attrs IS NOT NULL AND dst IN ('function:5', 'function:10', 'function:15')")
def default_arguments(spark, sf_dir):
    """Calls out of default arguments."""
    return R.default_argument_callers(fact(spark, sf_dir, "defaults"), ids(spark, "function:5", "function:10", "function:15"))


CHANNEL_NODES = "SELECT DISTINCT dst AS id, 'channel' AS kind, CAST(regexp_extract(dst, '[0-9]+', 0) AS INT) % 3 <> 0 AS declared, CASE WHEN CAST(regexp_extract(dst, '[0-9]+', 0) AS INT) % 6 = 0 THEN 'public' END AS visibility FROM wires UNION ALL SELECT DISTINCT src, 'channel_sub', NULL, NULL FROM wires WHERE src LIKE 'channel_sub:%'"


def _channel_nodes(wires):
    number = F.regexp_extract("dst", "[0-9]+", 0).cast("int")
    own = wires.select(F.col("dst").alias("id"), F.lit("channel").alias("kind"), (number % 3 != 0).alias("declared"), F.when(number % 6 == 0, "public").alias("visibility")).distinct()
    subs = wires.where("src like 'channel_sub:%'").select(F.col("src").alias("id"), F.lit("channel_sub").alias("kind"), F.lit(None).cast("boolean").alias("declared"), F.lit(None).cast("string").alias("visibility")).distinct()
    return own.unionByName(subs)


@query(f"""WITH {facts_sql('wires')}, n AS ({CHANNEL_NODES}), c AS (SELECT dst, count(DISTINCT src) FILTER (kind = 'AUTHORIZES_CHANNEL') AS routes, count(DISTINCT src) FILTER (kind = 'BROADCASTS_ON') AS publishers, count(DISTINCT src) FILTER (kind = 'BROADCASTS_ON' AND attrs IS NOT NULL) AS public, count(DISTINCT src) FILTER (kind = 'MATCHES_CHANNEL') AS subscribers FROM wires GROUP BY dst)
SELECT id, declared, routes, publishers, subscribers, list_filter([CASE WHEN NOT declared AND coalesce(visibility, 'private') <> 'public' THEN 'undeclared' END, CASE WHEN declared AND public > 0 THEN 'public publish' END, CASE WHEN declared AND routes = 0 THEN 'no auth route' END, CASE WHEN publishers = 0 THEN 'no publisher' END, CASE WHEN subscribers = 0 THEN 'no subscriber' END], lambda x: x IS NOT NULL) AS flags FROM n JOIN c ON c.dst = n.id WHERE n.kind = 'channel'""")
def channels(spark, sf_dir):
    """Channels with who authorizes, publishes and listens, and what is wrong with them."""
    wires = fact(spark, sf_dir, "wires")
    return R.channels(_channel_nodes(wires), wires)


@query(f"WITH {facts_sql('wires')} SELECT DISTINCT src AS id FROM wires WHERE src LIKE 'channel_sub:%' AND src NOT IN (SELECT src FROM wires WHERE kind = 'MATCHES_CHANNEL')")
def orphan_subscriptions(spark, sf_dir):
    """Client subscriptions that no channel matches."""
    wires = fact(spark, sf_dir, "wires")
    return R.orphan_subscriptions(_channel_nodes(wires), wires)


@query(f"""WITH {facts_sql('posts')}, n AS (SELECT DISTINCT CASE kind WHEN 'RECEIVED_BY' THEN src ELSE dst END AS id FROM posts),
s AS (SELECT dst AS id, count(DISTINCT src) FILTER (kind = 'SENDS_TO') AS senders, count(DISTINCT src) FILTER (kind = 'TEST_CALLS') AS test_senders FROM posts WHERE kind <> 'RECEIVED_BY' GROUP BY dst),
r AS (SELECT src AS id, count(DISTINCT dst) AS receivers, list_sort(list(DISTINCT json_extract_string(attrs, '$.platform'))) AS received_on FROM posts WHERE kind = 'RECEIVED_BY' GROUP BY src),
j AS (SELECT n.id, coalesce(senders, 0) AS senders, coalesce(test_senders, 0) AS test_senders, coalesce(receivers, 0) AS receivers, coalesce(received_on, []) AS received_on FROM n LEFT JOIN s USING (id) LEFT JOIN r USING (id)),
m AS (SELECT *, CASE WHEN len(received_on) > 0 THEN list_sort(list_filter(['android', 'ios', 'web'], lambda x: NOT list_contains(received_on, x))) ELSE [] END AS missing_on FROM j)
SELECT id, senders, test_senders, receivers, received_on, missing_on, list_filter([CASE WHEN senders > 0 AND receivers = 0 THEN 'no_receiver' END, CASE WHEN receivers > 0 AND senders = 0 THEN CASE WHEN test_senders > 0 THEN 'test_sender_only' ELSE 'no_sender' END END, CASE WHEN len(missing_on) > 0 THEN 'missing_on' END], lambda x: x IS NOT NULL) AS checks FROM m""")
def bridges(spark, sf_dir):
    """R11, SP3: bridge endpoints with senders, receivers by platform, and their checks."""
    posts = fact(spark, sf_dir, "posts")
    own = posts.select(F.when(F.col("kind") == "RECEIVED_BY", F.col("src")).otherwise(F.col("dst")).alias("id"), F.lit("endpoint").alias("kind"), F.lit("bridge").alias("protocol")).distinct()
    return R.bridges(own, posts, ["android", "ios", "web"]).drop("protocol")


@query(f"WITH {facts_sql('writes', 'reads')} SELECT DISTINCT w.state, w.file || ':' || w.line AS write_at, lossy, r.file || ':' || r.line AS read_at, seeds FROM writes w JOIN reads r USING (state) WHERE lossy IS NOT NULL AND seeds IS NOT NULL AND NOT (w.file = r.file AND r.line BETWEEN w.line AND w.end_line)")
def lossy_round_trips(spark, sf_dir):
    """Lossy writes of a property and reads elsewhere that seed the interface from it."""
    return R.round_trips(fact(spark, sf_dir, "writes"), fact(spark, sf_dir, "reads"))


@query(f"""WITH {facts_sql('writes')}, real AS (SELECT * FROM writes WHERE NOT resets), h AS (SELECT * FROM real WHERE how = 'lifecycle'),
l AS (SELECT * FROM real r WHERE how = 'async' AND NOT list_contains(regexp_extract_all(value, '[\\w$]+'), regexp_extract(state, '([^.#]+)$', 1)) AND NOT EXISTS (SELECT 1 FROM h WHERE h.state = r.state AND h.value = r.value))
SELECT state, a.n AS lifecycle, b.n AS later FROM (SELECT state, count(DISTINCT src) AS n FROM h GROUP BY state) a JOIN (SELECT state, count(DISTINCT src) AS n FROM l GROUP BY state) b USING (state)""")
def competing_writers(spark, sf_dir):
    """State that a lifecycle hook and a later callback set to values of their own."""
    return R.competing_writers(fact(spark, sf_dir, "writes"))


@query(on_graph("SELECT r.rule, CASE r.type WHEN 'edge' THEN EXISTS (SELECT 1 FROM edges e WHERE e.src = r.src AND e.dst = r.dst AND e.kind = r.edge_kind) ELSE EXISTS (SELECT 1 FROM walk w WHERE w.grp = r.rule AND w.id = r.dst) END AS present FROM rules r", facts_sql("rules") + ", " + walk_sql("walk", "SELECT src AS id, rule AS grp FROM rules WHERE type = 'path'", f"SELECT DISTINCT src AS comes, dst AS goes FROM edges WHERE {PROPAGATES}", "id, grp")))
def forbidden(spark, sf_dir):
    """Whether forbidden edges and paths are there, all rules in one walk."""
    return R.forbidden(edges(spark, sf_dir), fact(spark, sf_dir, "rules"))


@query(on_graph("""SELECT 'node' AS what, p.id AS key, CASE WHEN n.id IS NULL THEN 'missing' ELSE 'present' END AS state FROM (SELECT DISTINCT id FROM plan_nodes) p LEFT JOIN nodes n USING (id)
UNION ALL SELECT 'edge', p.src || ' ' || p.kind || ' ' || p.dst, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.src = p.src AND e.dst = p.dst AND e.kind = p.kind) THEN 'present' WHEN EXISTS (SELECT 1 FROM edges e WHERE e.src = p.src AND e.dst = p.dst) THEN 'other kind' ELSE 'missing' END FROM (SELECT DISTINCT * FROM plan_edges) p""", facts_sql("plan_nodes", "plan_edges")))
def plan_verified(spark, sf_dir):
    """Planned nodes and edges that are there, missing, or of another kind."""
    return R.verified(nodes(spark, sf_dir), edges(spark, sf_dir), fact(spark, sf_dir, "plan_nodes"), fact(spark, sf_dir, "plan_edges"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'gone' WHEN p_partkey % 4 = 0 THEN 'changed' ELSE 'same' END AS state FROM part")
def plan_baseline(spark, sf_dir):
    """Symbols against the digests of a baseline."""
    before = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    now = before.where("id % 9 <> 0").withColumn("text", F.when(F.col("id") % 4 == 0, F.concat("text", F.lit(" new"))).otherwise(F.col("text")))
    return R.changed_since(now, R.baseline(before)).withColumnRenamed("id", "p_partkey")


@query(on_graph("""SELECT id, reason, CASE reason WHEN 'below confidence' THEN low ELSE n_all END AS n FROM (SELECT a.id, CASE WHEN n.id IS NULL THEN 'unknown' WHEN low > 0 THEN 'below confidence' WHEN n.entry_kind IS NOT NULL THEN 'entry point' WHEN n_all > 0 THEN 'other edges' ELSE 'unused' END AS reason, low, n_all
FROM (SELECT DISTINCT id, (SELECT count(*) FROM edges e WHERE e.dst = t.id AND e.kind <> 'EXTENDS' AND conf_rank >= 3) AS callers, (SELECT count(*) FROM edges e WHERE e.dst = t.id AND e.kind <> 'EXTENDS' AND conf_rank < 3) AS low, (SELECT count(*) FROM edges e WHERE e.dst = t.id) AS n_all FROM (SELECT id FROM nodes UNION ALL SELECT 'function:none') t) a LEFT JOIN nodes n USING (id) WHERE callers = 0)"""))
def without_callers(spark, sf_dir):
    """Why a node has no callers at full confidence."""
    n = nodes(spark, sf_dir)
    return R.no_callers(n, edges(spark, sf_dir), n.select("id").unionByName(ids(spark, "function:none")), "exact")


@query(f"""WITH RECURSIVE {facts_sql('sources')}, o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, id) AS r FROM sources),
f(p_brand, r, used, took) AS (SELECT DISTINCT p_brand, 0::BIGINT, 0::BIGINT, false FROM o UNION ALL SELECT o.p_brand, o.r, CASE WHEN f.used + o.tokens <= 900 THEN f.used + o.tokens ELSE f.used END, f.used + o.tokens <= 900 FROM f JOIN o ON o.p_brand = f.p_brand AND o.r = f.r + 1)
SELECT o.p_brand, o.id, o.tokens::BIGINT AS tokens, o.r AS place FROM f JOIN o USING (p_brand, r) WHERE took""")
def budgeted_sources(spark, sf_dir):
    """Sources of each brand that fit a budget of tokens, best first."""
    found = R.budgeted(fact(spark, sf_dir, "sources").withColumn("o", F.struct((-F.col("score")).alias("s"), "id")), "p_brand", F.col("o"), "tokens", 900)
    return found.select("p_brand", "id", F.col("tokens").cast("long").alias("tokens"), F.col("place").cast("long").alias("place"))


@query(f"WITH {facts_sql('calls')} SELECT route, client, place FROM (SELECT route, client, row_number() OVER (PARTITION BY route ORDER BY client) AS place FROM (SELECT DISTINCT m.dst AS route, c.src AS client FROM calls m JOIN calls c ON c.dst = m.src AND c.kind = 'HTTP_CALLS' WHERE m.kind = 'MATCHES_ROUTE')) WHERE place <= 3")
def route_clients(spark, sf_dir):
    """The first clients of each route; a short list."""
    return R.route_clients(fact(spark, sf_dir, "calls"))


@query(on_graph("""SELECT id, issue, count(*) AS n FROM (
SELECT dst AS id, 'direct' AS issue, src AS other FROM calls WHERE dst IN (SELECT id FROM mine) UNION ALL
SELECT DISTINCT a.src, 'bypass', b.src FROM calls a JOIN calls b ON b.dst = a.dst AND b.src <> a.src WHERE a.src IN (SELECT id FROM mine) UNION ALL
SELECT DISTINCT a.src, 'middleware', b.src FROM calls a JOIN calls b ON b.dst = a.dst AND b.src <> a.src JOIN middleware x ON x.route = a.src JOIN middleware y ON y.route = b.src AND y.names <> x.names WHERE a.src IN (SELECT id FROM mine)) GROUP BY id, issue""", facts_sql("middleware") + ", calls AS (SELECT DISTINCT src, dst FROM edges WHERE kind IN ('CALLS', 'ROUTES_TO')), mine AS (SELECT unnest(['route:1', 'route:2', 'route:3', 'function:4', 'function:5']) AS id)"))
def plan_modified(spark, sf_dir):
    """What a planned change misses: direct callers, those that bypass it, routes with other middleware."""
    names = fact(spark, sf_dir, "middleware").withColumn("names", F.split("names", ","))
    found = R.modified_check(edges(spark, sf_dir), ids(spark, "route:1", "route:2", "route:3", "function:4", "function:5"), names)
    return found.groupBy("id", "issue").agg(F.count(F.lit(1)).alias("n"))


@query(on_graph("SELECT DISTINCT e.dst AS tbl, e.kind, e.src FROM edges e WHERE e.kind IN ('READS_TABLE', 'WRITES_TABLE') AND e.dst IN ('table:1', 'table:2', 'table:3') AND e.src NOT IN (SELECT id FROM walk) AND e.src NOT IN (SELECT id FROM nodes WHERE module = 'Brand#12')", walk_sql("walk", "SELECT id FROM nodes WHERE id IN ('module:7', 'module:8')", f"SELECT DISTINCT src AS comes, dst AS goes FROM edges WHERE {PROPAGATES}")))
def plan_tables(spark, sf_dir):
    """Users of planned tables that the plan neither lists nor goes through."""
    listed = nodes(spark, sf_dir).where("module = 'Brand#12'").select("id")
    return R.plan_coverage(edges(spark, sf_dir), ids(spark, "table:1", "table:2", "table:3"), listed, ids(spark, "module:7", "module:8"))


@query(on_graph("""SELECT r.id, r.entry_kind, coalesce(g.has_auth, false) AS has_auth, coalesce(t.tables, 0) AS tables, CASE WHEN g.has_auth THEN 'guarded' WHEN t.tables > 0 THEN 'unguarded' ELSE 'quiet' END AS state FROM nodes r
LEFT JOIN (SELECT e.src AS id, bool_or(c.module = 'BUILDING') AS has_auth FROM edges e JOIN nodes c ON c.id = e.dst WHERE e.kind = 'USES_TYPE' GROUP BY e.src) g USING (id)
LEFT JOIN (SELECT id, count(DISTINCT grp) AS tables FROM walk WHERE id LIKE 'route:%' GROUP BY id) t USING (id) WHERE r.kind = 'route'""", walk_sql("walk", "SELECT DISTINCT src AS id, dst AS grp FROM edges WHERE kind = 'WRITES_TABLE' AND conf_rank = 3 AND dst IN ('table:1', 'table:2', 'table:3')", f"SELECT DISTINCT dst AS comes, src AS goes FROM edges WHERE {PROPAGATES} AND conf_rank = 3 AND (kind <> 'WRITES_TABLE' OR dst IN ('table:1', 'table:2', 'table:3'))", "id, grp")))
def guarded_routes(spark, sf_dir):
    """Routes with their guards and the tables that a walk from them writes, over certain edges to three tables."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir).where("conf_rank = 3 and (kind <> 'WRITES_TABLE' or dst in ('table:1', 'table:2', 'table:3'))")
    classes = n.where("kind = 'class'").select(F.col("id").alias("dst"), F.when(F.col("module") == "BUILDING", "JwtGuard").otherwise("ThrottlerGuard").alias("name"))
    guards = edges(spark, sf_dir).where("kind = 'USES_TYPE'").join(classes, "dst").select(F.col("src").alias("route"), "name")
    return R.routes(n, e, guards).select("id", "entry_kind", "has_auth", "tables", "state")


@query("""WITH s AS (SELECT event_type AS endpoint, ['id', 'userId', 'items[0].name', 'extra' || (user_id % 3)][(event_id % 4 + 1)::INT] AS key, ['int', 'str', 'str', 'str'][(event_id % 4 + 1)::INT] AS kind FROM events),
sent AS (SELECT endpoint, key, min(kind) AS kind FROM s GROUP BY ALL),
declared AS (SELECT DISTINCT event_type AS endpoint, d.key, d.kind, d.required FROM events, (VALUES ('id', 'str', true), ('user_id', 'str', true), ('items[*].name', 'str', false), ('total', 'number', true), ('extra1', 'str', false)) d(key, kind, required))
SELECT endpoint, key, issue, severity FROM (SELECT endpoint, 'id' AS key, 'type' AS issue, 'high' AS severity FROM sent WHERE key = 'id' UNION ALL SELECT endpoint, 'userId', 'case', 'medium' FROM sent WHERE key = 'userId'
UNION ALL SELECT endpoint, key, 'unknown', 'low' FROM sent WHERE key LIKE 'extra%' AND key <> 'extra1' UNION ALL SELECT DISTINCT endpoint, 'total', 'missing', 'high' FROM declared)""")
def payload_issues(spark, sf_dir):
    """Keys of requests against a declared schema: missing, unknown, in another spelling, of another kind."""
    from lattica.operators import rules

    e = read(spark, sf_dir, "events")
    at = (F.col("event_id") % 4 + 1).cast("int")
    keys = F.array(F.lit("id"), F.lit("userId"), F.lit("items[0].name"), F.concat(F.lit("extra"), F.col("user_id") % 3))
    sent = e.select(F.col("event_type").alias("endpoint"), F.element_at(keys, at).alias("key"), F.element_at(F.array(*(F.lit(k) for k in ("int", "str", "str", "str"))), at).alias("kind"))
    schema = spark.createDataFrame([("id", "str", True), ("user_id", "str", True), ("items[*].name", "str", False), ("total", "number", True), ("extra1", "str", False)], "key string, kind string, required boolean")
    declared = e.select(F.col("event_type").alias("endpoint")).distinct().join(F.broadcast(schema))
    return rules.payload_issues(sent, declared)
