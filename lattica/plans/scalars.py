"""Scalar function queries over names, urls, texts and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import matchers as M
from lattica.functions import platforms as P
from lattica.functions import text as X
from lattica.operators import scan as S
from lattica.plans.registry import on_graph, query
from lattica.sources.fixture import nodes, read

SALT = b"lattica"
_PAD = lambda x: "".join(f"{b ^ x:02x}" for b in SALT.ljust(64, b"\0"))


@query("""SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS protocol, regexp_extract(url, '://([^/:?#]*)', 1) AS host,
CASE WHEN len(s) > 2 THEN '.../' || array_to_string(s[-2:], '/') ELSE p END AS short, len(s)::INT AS n, regexp_replace(p, '[0-9]+', '{}', 'g') AS shape
FROM (SELECT *, list_filter(string_split(p, '/'), lambda x: x <> '') AS s FROM (SELECT *, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p FROM pages))""")
def url_parts(spark, sf_dir):
    """Protocol, host, short path and shape of urls."""
    u = read(spark, sf_dir, "pages").withColumn("p", F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1))
    d = X.dsn(F.col("url"))
    return u.select("page_id", d["protocol"].alias("protocol"), d["host"].alias("host"), X.short_path(F.col("p"), 2).alias("short"), F.size(M.segments(F.col("p"))).alias("n"), F.regexp_replace(F.regexp_replace("p", "[0-9]+", "{id}"), r"\{[^{}]*\}", "{}").alias("shape"))


@query("""SELECT p_partkey, 'function:' || p_partkey AS id, replace(p_name, ' ', '_') AS snake, string_split(p_name, ' ')[-1] AS head, regexp_replace(lower(string_split(p_name, ' ')[-1]), '(ing|ed|es|s)$', '') AS stem, lower(replace(replace(p_brand, '#', ''), '_', '')) AS key FROM part""")
def name_parts(spark, sf_dir):
    """Id, words, head word, stem and key of names."""
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", X.node_id(F.lit("function"), F.col("p_partkey").cast("string")).alias("id"), X.snake(name).alias("snake"), X.head_token(name).alias("head"), X.stem(X.head_token(name)).alias("stem"), X.norm_key(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("key"))


@query(on_graph("SELECT id, substr(sha256('unused' || chr(0) || id || chr(0) || coalesce(file, '')), 1, 16) AS mark FROM nodes"))
def fingerprints(spark, sf_dir):
    """Fingerprint of a finding at every node."""
    return nodes(spark, sf_dir).select("id", X.fingerprint(F.lit("unused"), F.col("id"), F.coalesce("file", F.lit(""))).alias("mark"))


@query(f"""SELECT c_custkey, 'redacted:hmac:' || substr(sha256(unhex('{_PAD(0x5C)}') || unhex(sha256(unhex('{_PAD(0x36)}') || encode(c_name)))), 1, 8) AS marker FROM customer""")
def redaction_markers(spark, sf_dir):
    """Keyed markers of names, by HMAC out of plain digests."""
    return read(spark, sf_dir, "customer").select("c_custkey", X.redaction_marker(F.col("c_name"), SALT).alias("marker"))


@query(r"""SELECT doc_id, count(*) AS n, count(DISTINCT m) AS n_distinct FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS m FROM documents) GROUP BY doc_id""")
def address_scan(spark, sf_dir):
    """IP addresses found in texts, by document."""
    found = S.matches(read(spark, sf_dir, "documents"), "doc_id", "text", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("found").alias("n_distinct"))


def _one_of(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query(rf"""SELECT doc_id, line, key, value FROM (SELECT *, list_filter(regexp_split_to_array(lower(regexp_replace(key, '([a-z])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM (
SELECT doc_id, line, regexp_extract(l, '([A-Za-z_][A-Za-z0-9_]*) = "([^"]*)"', 1) AS key, regexp_extract(l, '([A-Za-z_][A-Za-z0-9_]*) = "([^"]*)"', 2) AS value
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line FROM documents)) WHERE key <> '')
WHERE (w = ['app', 'key'] OR w[-1] IN ({_one_of(X.SECRET_LAST)}) OR w[-2] || ' ' || w[-1] IN ({_one_of(X.SECRET_TWO)}) OR (w[-1] IN ('key', 'token') AND coalesce(w[-2], '') NOT IN ({_one_of(X.NOT_SECRET_BEFORE)})))
AND trim(value) <> '' AND NOT regexp_matches(trim(value), '^(\$|<|\{{\{{|%\()') AND lower(trim(value)) NOT IN ({_one_of(X.NO_VALUE)}) AND NOT starts_with(trim(value), 'redacted:')""")
def secret_scan(spark, sf_dir):
    """Assignments of credentials in texts with their lines, placeholders left out."""
    found = S.line_matches(read(spark, sf_dir, "documents"), "doc_id", "text", r'([A-Za-z_][A-Za-z0-9_]*) = "([^"]*)"', ["key", "value"])
    return found.where(X.secret_key(F.col("key")) & ~X.placeholder(F.col("value")))


@query(r"""SELECT doc_id, length(regexp_replace(text, '[^\n]', '', 'g'))::INT + 1 AS last_line, regexp_matches(text, '(?i)license') AS licensed FROM documents""")
def line_numbers(spark, sf_dir):
    """Line number of a text's last offset; text mentions."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", X.line_of(F.col("text"), F.length("text")).alias("last_line"), F.col("text").rlike("(?i)license").alias("licensed"))


@query("""SELECT a.p_name AS word, b.p_name AS close, levenshtein(a.p_name, b.p_name)::INT AS distance FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON left(a.p_name, 2) = left(b.p_name, 2) AND a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) <= 4""")
def close_names(spark, sf_dir):
    """Names a few edits apart, blocked on their first signs."""
    names = read(spark, sf_dir, "part").select("p_name").distinct()
    left, right = names.select(F.col("p_name").alias("word"), F.substring("p_name", 1, 2).alias("k")), names.select(F.col("p_name").alias("close"), F.substring("p_name", 1, 2).alias("k"))
    return left.join(right, "k").where("word < close").select("word", "close", F.levenshtein("word", "close").alias("distance")).where("distance <= 4")


@query(on_graph("SELECT id FROM nodes WHERE lower(name) LIKE '%blue%' OR lower(fqn) LIKE '%blue%' ORDER BY length(id), id LIMIT 20"))
def search(spark, sf_dir):
    """Nodes whose name holds a text, shortest ids first; a top-k report."""
    from lattica.operators.spec import search as find

    return find(nodes(spark, sf_dir), "blue", 20).select("id")


@query(on_graph("""SELECT spec, id FROM (SELECT spec, id, tier, min(tier) OVER (PARTITION BY spec) AS best FROM (
SELECT spec, nodes.id, CASE WHEN nodes.id = spec THEN 1 WHEN nodes.file = spec THEN 3 WHEN nodes.name = spec THEN 5 WHEN ends_with(nodes.fqn, '.' || spec) THEN 6 END AS tier FROM (VALUES ('function:7'), ('src/m3.py'), ('Customer#5'), ('blue anvil'), ('Supplier#2'), ('nothing')) s(spec), nodes) WHERE tier IS NOT NULL) WHERE tier = best"""))
def resolve_specs(spark, sf_dir):
    """specs to nodes by the first tier that fits."""
    from lattica.operators.spec import resolve

    specs = spark.createDataFrame([(s,) for s in ("function:7", "src/m3.py", "Customer#5", "blue anvil", "Supplier#2", "nothing")], "spec string")
    return resolve(nodes(spark, sf_dir), specs).select("spec", "id")


@query("""SELECT event_id, CASE WHEN k IN ('click', 'view') THEN (k = 'click') ELSE NULL END AS both_known,
CASE WHEN v > 50 THEN true WHEN k = 'error' THEN NULL ELSE false END AS either FROM (SELECT event_id, event_type AS k, value AS v FROM events)""")
def three_valued(spark, sf_dir):
    """Conditions that are true, false or unknown, joined by all and any."""
    e = read(spark, sf_dir, "events")
    known = F.when(F.col("event_type") == "click", True).when(F.col("event_type") == "view", False)
    either = F.array(F.col("value") > 50, F.when(F.col("event_type") != "error", False))
    return e.select("event_id", P.all_of(F.array(known, F.lit(True))).alias("both_known"), P.any_of(either).alias("either"))


@query("""SELECT t.target, e.event_type, NULL::BOOLEAN AS on_other, (e.event_type = 'click' AND t.target IN ('linux', 'macos', 'android', 'ios')) AS on_unix FROM (VALUES ('linux'), ('macos'), ('windows'), ('android'), ('ios'), ('web')) t(target), (SELECT DISTINCT event_type FROM events) e""")
def platform_atoms(spark, sf_dir):
    """Which targets a condition holds on."""
    kinds = read(spark, sf_dir, "events").select("event_type").distinct()
    rows = None
    for target in P.TARGETS:
        unix = P.atom(F.lit("os"), F.when(F.col("event_type") == "click", "unix").otherwise("none"), target)
        other = P.atom(F.lit("feature"), F.lit("x"), target)
        out = kinds.select(F.lit(target).alias("target"), "event_type", other.alias("on_other"), unix.alias("on_unix"))
        rows = out if rows is None else rows.unionByName(out)
    return rows
