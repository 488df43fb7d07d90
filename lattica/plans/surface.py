"""Findings over facts derived from the star schema, producer by producer, with the SQL of each rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import surface as S
from lattica.plans.registry import query
from lattica.sources.fixture import read

INBOUND_SQL = """
inbound AS (SELECT 'route:' || o_orderkey AS node, 'POST /orders/' || o_orderkey AS name, ['http', 'unix', 'ws'][(o_orderkey % 3 + 1)::INT] AS protocol, ['tcp', 'ipc', 'tcp'][(o_orderkey % 3 + 1)::INT] AS transport,
  CASE o_orderstatus WHEN 'F' THEN 'unguarded' WHEN 'O' THEN 'guarded' ELSE 'unchecked' END AS guard_state, CASE WHEN o_orderkey % 7 = 0 THEN 'health check' END AS public, CASE WHEN o_orderkey % 11 = 0 THEN 'handler not found' END AS unsure,
  o_totalprice > 100000 AS reaches_write, CASE WHEN o_orderkey % 5 = 0 THEN 'all' ELSE 'loopback' END AS exposure, CASE WHEN o_orderkey % 2 = 0 THEN 8000 + o_orderkey % 10 END AS port, ['0666', '0o640', 'a+rw'][(o_custkey % 3 + 1)::INT] AS mode,
  CASE WHEN o_orderkey % 13 = 0 THEN 'payment' END AS webhook, o_orderkey % 2 = 0 AS verified, 'src/m' || (o_custkey % 40) || '.py' AS file, (o_orderkey % 400)::INT AS line, 'resolved' AS confidence FROM orders),
transport AS (SELECT 'function:' || user_id AS id, ['tls-verify-off', 'ssh-hostkey-off', 'grpc-plaintext', 'ipc-electron', 'ipc-extension-external', 'other'][(event_id % 6 + 1)::INT] AS kind, 'seen in ' || event_type AS detail, CASE WHEN event_id % 4 = 0 THEN 'https' END AS system_protocol,
  'src/m' || (event_id % 40) || '.py' AS file, (event_id % 400)::INT AS line, 'exact' AS confidence FROM events),
requests AS (SELECT 'function:' || user_id AS id, CASE WHEN event_type = 'view' THEN 'dns-input' ELSE 'ssrf' END AS kind, ['host', 'url', 'path', 'query'][(event_id % 4 + 1)::INT] AS part, 'query' AS source, event_type AS key, CASE WHEN event_id % 3 = 0 THEN 'helper' ELSE 'direct' END AS via,
  event_id % 5 = 0 AS checked, 'src/m' || (event_id % 40) || '.py' AS file, (event_id % 400)::INT AS line FROM events),
posts AS (SELECT 'function:' || user_id AS src, 'endpoint:postmessage:' || event_type AS dst, CASE WHEN event_id % 3 = 0 THEN '*' ELSE 'https://example.org' END AS target_origin, 'src/m' || (event_id % 40) || '.js' AS file, (event_id % 400)::INT AS line, 'exact' AS confidence FROM events WHERE event_type = 'click'),
externals AS (SELECT 'external:' || s_suppkey AS id, ['redis', 'mqtt', 'telnet', 'saas', 'smtp'][(s_suppkey % 5 + 1)::INT] AS protocol, CASE WHEN s_suppkey % 9 = 0 THEN 'localhost' ELSE 'host' || s_suppkey || '.example.com' END AS host,
  [6379, 1883, 23, 443, 25][(s_suppkey % 5 + 1)::INT] AS port, CASE WHEN s_suppkey % 4 = 0 THEN false WHEN s_suppkey % 4 = 1 THEN true END AS tls, CASE WHEN s_suppkey % 5 = 0 THEN 'redis' END AS scheme, s_suppkey % 6 = 0 AS literal, s_suppkey % 10 = 0 AS in_url,
  'conf/' || s_nationkey || '.yml' AS file, s_suppkey::INT AS line, 'exact' AS confidence FROM supplier),
config AS (SELECT 'config:' || c_custkey AS id, ['mail.password', 'app.key', 'cache.key', 'services.api_token', 'app.name'][(c_custkey % 5 + 1)::INT] AS key, CASE WHEN c_custkey % 3 = 0 THEN '${SECRET}' WHEN c_custkey % 7 = 0 THEN 'null' ELSE c_name END AS value, 'conf/app.py' AS file, c_custkey::INT AS line FROM customer)"""

PARTS = {
    "hardcoded": """SELECT 'hardcoded' AS finding, 'high' AS severity, protocol, id AS node, file, line, confidence, 'literal ' || CASE protocol WHEN 'saas' THEN 'key' ELSE 'password' END || ' in code or configuration (value not shown)' AS detail, NULL::VARCHAR AS variant FROM externals WHERE literal
UNION ALL SELECT 'hardcoded', 'high', protocol, id, file, line, confidence, 'password inline in the ' || coalesce(scheme, protocol) || ' connection URL (value not shown)', NULL FROM externals WHERE in_url
UNION ALL SELECT 'hardcoded', 'high', 'config', id, file, line, 'resolved', 'literal value in config key ' || key || ' (value not shown)', NULL FROM config WHERE key IN ('mail.password', 'app.key', 'cache.key', 'services.api_token') AND NOT starts_with(value, '$') AND value <> 'null'""",
    "plaintext": """SELECT 'plaintext' AS finding, 'medium' AS severity, protocol, id AS node, file, line, CASE WHEN tls IS NULL THEN 'heuristic' ELSE confidence END AS confidence, why || ': ' || host || ':' || port AS detail, NULL::VARCHAR AS variant FROM (
SELECT *, CASE WHEN NOT tls THEN coalesce(scheme, protocol) || ' without TLS' WHEN tls IS NULL AND protocol = 'telnet' THEN 'telnet has no transport protection' WHEN tls IS NULL AND protocol = 'mqtt' AND port = 1883 THEN 'mqtt on the plaintext port 1883' WHEN tls IS NULL AND protocol = 'smtp' AND port = 25 THEN 'smtp on the plaintext port 25' END AS why FROM externals) WHERE why IS NOT NULL AND host <> 'localhost'
UNION ALL SELECT 'plaintext', 'medium', 'grpc', id, file, line, confidence, detail, kind FROM transport WHERE kind = 'grpc-plaintext'""",
    "unverified": """SELECT 'unverified' AS finding, 'high' AS severity, protocol, node, file, line, 'resolved' AS confidence, webhook || ' webhook ' || name || ' never verifies the signature or secret' AS detail, NULL::VARCHAR AS variant FROM inbound WHERE webhook IS NOT NULL AND NOT verified""",
    "unguarded": """SELECT 'unguarded' AS finding, CASE WHEN public IS NOT NULL OR unsure IS NOT NULL OR NOT reaches_write THEN 'low' ELSE 'medium' END AS severity, protocol, node, file, line, CASE WHEN public IS NULL AND unsure IS NOT NULL THEN 'heuristic' ELSE confidence END AS confidence,
name || ' has no auth guard' || CASE WHEN reaches_write THEN ' and reaches a write' ELSE '' END || CASE WHEN public IS NOT NULL THEN ' (public by design: ' || public || ')' WHEN unsure IS NOT NULL THEN ' (unclear: ' || unsure || ')' ELSE '' END AS detail, NULL::VARCHAR AS variant FROM inbound WHERE guard_state = 'unguarded'""",
    "exposed-listener": """SELECT 'exposed-listener' AS finding, 'medium' AS severity, protocol, node, file, line, confidence, transport || ' listener' || CASE WHEN port IS NULL THEN '' ELSE ' on port ' || port END || ' bound to all interfaces' AS detail, NULL::VARCHAR AS variant FROM inbound WHERE exposure = 'all'""",
    "tls-off": """SELECT 'tls-off' AS finding, 'high' AS severity, CASE kind WHEN 'ssh-hostkey-off' THEN 'ssh' ELSE coalesce(system_protocol, 'tls') END AS protocol, id AS node, file, line, confidence, detail, kind AS variant FROM transport WHERE kind IN ('tls-verify-off', 'ssh-hostkey-off')""",
    "ssrf": """SELECT 'ssrf' AS finding, CASE kind WHEN 'dns-input' THEN 'medium' ELSE 'high' END AS severity, CASE kind WHEN 'dns-input' THEN 'dns' ELSE 'http' END AS protocol, id AS node, file, line, CASE via WHEN 'helper' THEN 'heuristic' ELSE 'resolved' END AS confidence,
CASE WHEN kind = 'dns-input' THEN 'DNS lookup of request input' WHEN part = 'url' THEN 'the whole outbound URL comes from request input' ELSE 'outbound URL host comes from request input' END || ' (' || source || '.' || key || ')' || CASE via WHEN 'helper' THEN ' via helper' ELSE '' END AS detail, kind || ':' || source || '.' || key AS variant
FROM requests WHERE NOT checked AND (kind = 'dns-input' OR part IN ('host', 'url'))""",
    "ipc-exposed": """SELECT 'ipc-exposed' AS finding, 'medium' AS severity, 'postmessage' AS protocol, src AS node, file, line, confidence, 'postMessage with target origin ''*'': any page in that window receives the message' AS detail, 'postmessage-send' AS variant FROM posts WHERE target_origin = '*'
UNION ALL SELECT 'ipc-exposed', 'medium', protocol, node, file, line, confidence, 'Unix socket ' || name || ' is chmod ' || mode || ': any local user can connect', 'unix-mode' FROM inbound WHERE protocol = 'unix' AND mode IN ('0666', 'a+rw')
UNION ALL SELECT 'ipc-exposed', 'medium', CASE kind WHEN 'ipc-electron' THEN 'electron' ELSE 'extension' END, id, file, line, confidence, detail, kind || ':' || substr(sha256(detail), 1, 6) FROM transport t WHERE kind LIKE 'ipc-%'
  AND NOT (kind = 'ipc-extension-external' AND EXISTS (SELECT 1 FROM inbound i WHERE i.guard_state = 'unguarded' AND i.file = t.file AND i.line = t.line))""",
}


def _facts(spark, sf_dir) -> S.Facts:
    t = lambda name: read(spark, sf_dir, name)
    pick = lambda values, at: F.element_at(F.array(*(F.lit(v) for v in values)), (at % len(values) + 1).cast("int"))
    name = lambda prefix, key, end="": F.concat(F.lit(prefix), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(end))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    inbound = t("orders").select(
        name("route:", "o_orderkey").alias("node"), name("POST /orders/", "o_orderkey").alias("name"), pick(["http", "unix", "ws"], key).alias("protocol"), pick(["tcp", "ipc", "tcp"], key).alias("transport"),
        F.when(F.col("o_orderstatus") == "F", "unguarded").when(F.col("o_orderstatus") == "O", "guarded").otherwise("unchecked").alias("guard_state"),
        F.when(key % 7 == 0, "health check").alias("public"), F.when(key % 11 == 0, "handler not found").alias("unsure"), (F.col("o_totalprice") > 100000).alias("reaches_write"),
        F.when(key % 5 == 0, "all").otherwise("loopback").alias("exposure"), F.when(key % 2 == 0, 8000 + key % 10).alias("port"), pick(["0666", "0o640", "a+rw"], cust).alias("mode"),
        F.when(key % 13 == 0, "payment").alias("webhook"), (key % 2 == 0).alias("verified"), name("src/m", cust % 40, ".py").alias("file"), (key % 400).cast("int").alias("line"), F.lit("resolved").alias("confidence"),
    )
    event, line = F.col("event_id"), (F.col("event_id") % 400).cast("int").alias("line")
    fn, file = name("function:", "user_id"), name("src/m", event % 40, ".py").alias("file")
    transport = t("events").select(fn.alias("id"), pick(["tls-verify-off", "ssh-hostkey-off", "grpc-plaintext", "ipc-electron", "ipc-extension-external", "other"], event).alias("kind"), name("seen in ", "event_type").alias("detail"), F.when(event % 4 == 0, "https").alias("system_protocol"), file, line, F.lit("exact").alias("confidence"))
    requests = t("events").select(fn.alias("id"), F.when(F.col("event_type") == "view", "dns-input").otherwise("ssrf").alias("kind"), pick(["host", "url", "path", "query"], event).alias("part"), F.lit("query").alias("source"), F.col("event_type").alias("key"), F.when(event % 3 == 0, "helper").otherwise("direct").alias("via"), (event % 5 == 0).alias("checked"), file, line)
    posts = t("events").where("event_type = 'click'").select(fn.alias("src"), name("endpoint:postmessage:", "event_type").alias("dst"), F.when(event % 3 == 0, "*").otherwise("https://example.org").alias("target_origin"), name("src/m", event % 40, ".js").alias("file"), line, F.lit("exact").alias("confidence"))
    s = F.col("s_suppkey")
    externals = t("supplier").select(
        name("external:", "s_suppkey").alias("id"), pick(["redis", "mqtt", "telnet", "saas", "smtp"], s).alias("protocol"), F.when(s % 9 == 0, "localhost").otherwise(name("host", "s_suppkey", ".example.com")).alias("host"), pick([6379, 1883, 23, 443, 25], s).alias("port"),
        F.when(s % 4 == 0, False).when(s % 4 == 1, True).alias("tls"), F.when(s % 5 == 0, "redis").alias("scheme"), (s % 6 == 0).alias("literal"), (s % 10 == 0).alias("in_url"), name("conf/", "s_nationkey", ".yml").alias("file"), s.cast("int").alias("line"), F.lit("exact").alias("confidence"),
    )
    c = F.col("c_custkey")
    config = t("customer").select(name("config:", "c_custkey").alias("id"), pick(["mail.password", "app.key", "cache.key", "services.api_token", "app.name"], c).alias("key"), F.when(c % 3 == 0, "${SECRET}").when(c % 7 == 0, "null").otherwise(F.col("c_name")).alias("value"), F.lit("conf/app.py").alias("file"), c.cast("int").alias("line"))
    return S.Facts(externals, inbound, config, transport, requests, posts)


def _sql(parts: list[str]) -> str:
    every = "\nUNION ALL ".join(PARTS[p] for p in parts)
    return f"""WITH {INBOUND_SQL.strip()}, every AS ({every}),
marked AS (SELECT *, substr(sha256(concat_ws(chr(0), finding, node, coalesce(file, ''), variant)), 1, 16) AS mark FROM every)
SELECT finding, severity, protocol, node, file, line, confidence, detail, variant, mark, n_lines FROM (SELECT *, count(DISTINCT line) OVER (PARTITION BY mark) AS n_lines, row_number() OVER (PARTITION BY mark ORDER BY coalesce(line, 0), line, finding, severity, protocol, node, file, confidence, detail, variant) AS n FROM marked) WHERE n = 1"""


def _query(name: str, rows: str, finding: str):
    def run(spark, sf_dir):
        found = S.findings(_facts(spark, sf_dir), [finding])
        return found.select("finding", "severity", "protocol", "node", "file", "line", "confidence", "detail", "variant", "mark", (F.size("also") + 1).cast("long").alias("n_lines"))

    run.__name__, run.__doc__ = name, f"{rows}: findings of kind {finding}."
    return query(_sql([finding]))(run)


hardcoded_findings = _query("hardcoded_findings", "B5, R16", "hardcoded")
plaintext_findings = _query("plaintext_findings", "B6, B7, R16", "plaintext")
unverified_findings = _query("unverified_findings", "B8, R16", "unverified")
unguarded_findings = _query("unguarded_findings", "B9, R15", "unguarded")
exposed_listener_findings = _query("exposed_listener_findings", "B10, R15", "exposed-listener")
tls_off_findings = _query("tls_off_findings", "B11, SP19", "tls-off")
ssrf_findings = _query("ssrf_findings", "B12, SP20", "ssrf")
ipc_exposed_findings = _query("ipc_exposed_findings", "B13, X41", "ipc-exposed")


@query(f"SELECT finding, severity, count(*) AS n FROM ({_sql(list(PARTS))}) GROUP BY finding, severity")
def surface_report(spark, sf_dir):
    """All findings of all producers, by kind and severity."""
    return S.findings(_facts(spark, sf_dir)).groupBy("finding", "severity").agg(F.count(F.lit(1)).alias("n"))
