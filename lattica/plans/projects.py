"""A source tree made from the star schema, indexed by rules; the SQL counts what the tree was made from."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import languages as L
from lattica.plans.registry import query
from lattica.sources.fixture import read


def sources(spark, sf_dir):
    """path, text: a Python module for each fortieth of the parts, a function for each part."""
    p = F.col("p_partkey")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    lines = F.array_compact(F.array(
        F.when(p % 10 == 0, text('@app.get("/items/', p, '")')),
        text("def f_", p, "(x):"),
        text("    f_", p + 7, "(x)"),
        F.when(p % 5 == 0, text("    y = f_", p + 40, "(x)")),
        F.when(p % 3 == 0, text('    client.publish("orders/', p % 9, '/new", x)')),
        F.when(p % 4 == 0, text('    os.environ.get("KEY_', p % 6, '")')),
        F.when(p % 6 == 0, text("    Order", p % 8, ".objects.create(x)")),
        F.when(p % 25 == 0, F.lit("    requests.get(url, verify=False)")),
        F.when(p % 30 == 0, text('    DB = "postgres://shop:', F.when(p % 60 == 0, "$SECRET").otherwise(F.concat(F.lit("pw"), p.cast("string"))), "@db", p % 4, ':5432/shop"')),
        F.when(p % 45 == 0, text('    CACHE = "redis://cache', p % 4, ':6379"')),
        F.when(p % 8 == 0, F.lit("    if not x.user: abort(403)")),
        F.when(p % 14 == 0, F.lit("    await x.load()")),
        F.when(p % 21 == 0, F.lit("    if self.gone: return")),
        F.when(p % 7 == 0, F.lit("    self.value = 1")),
        F.lit(""),
    ))
    own = read(spark, sf_dir, "part").select(F.concat(F.lit("src/m"), (p % 40).cast("string"), F.lit(".py")).alias("path"), p.alias("k"), F.array_join(lines, "\n").alias("t"))
    return own.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "\n").alias("text"))


@query("""WITH last AS (SELECT max(p_partkey) AS m FROM part) SELECT kind, confidence, count(*) AS n FROM (
SELECT 'CALLS' AS kind, 'heuristic' AS confidence FROM part, last WHERE p_partkey + 7 <= m
UNION ALL SELECT 'CALLS', 'resolved' FROM part, last WHERE p_partkey % 5 = 0 AND p_partkey + 40 <= m
UNION ALL SELECT 'ROUTES_TO', 'heuristic' FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT 'SENDS_TO', 'heuristic' FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT 'READS_ENV', 'heuristic' FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'WRITES_TABLE', 'heuristic' FROM part WHERE p_partkey % 6 = 0) GROUP BY kind, confidence""")
def project_edges(spark, sf_dir):
    """SC9, SL1, SP9, E2: edges of a source tree by kind and confidence."""
    return L.index(sources(spark, sf_dir))[1].groupBy("kind", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'function' AS kind, p_partkey::VARCHAR AS k FROM part UNION ALL SELECT 'route', p_partkey::VARCHAR FROM part WHERE p_partkey % 10 = 0
UNION ALL SELECT DISTINCT 'endpoint', (p_partkey % 9)::VARCHAR FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT DISTINCT 'env', (p_partkey % 6)::VARCHAR FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT DISTINCT 'table', (p_partkey % 8)::VARCHAR FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT DISTINCT 'file', (p_partkey % 40)::VARCHAR FROM part) GROUP BY kind""")
def project_nodes(spark, sf_dir):
    """SC9, SL12, SL20: nodes of a source tree by kind; ends of edges that nothing defines get one, too."""
    return L.index(sources(spark, sf_dir))[0].groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'src/m' || (p_partkey % 40) || '.py' AS path, 'tls-verify-off' AS kind, count(*) AS n FROM part WHERE p_partkey % 25 = 0 GROUP BY 1""")
def project_facts(spark, sf_dir):
    """SP19, SP24: facts of insecure transport by file."""
    found = L.facts(sources(spark, sf_dir), L.FACTS).where("what = 'fact'")
    return found.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, finding, count(*) AS n FROM (SELECT DISTINCT id, finding, m FROM (SELECT 'external:postgres:db' || (p_partkey % 4) || ':5432' AS id, 'hardcoded' AS finding, p_partkey % 40 AS m FROM part WHERE p_partkey % 30 = 0 AND p_partkey % 60 <> 0
UNION ALL SELECT 'external:redis:cache' || (p_partkey % 4) || ':6379', 'plaintext', p_partkey % 40 FROM part WHERE p_partkey % 45 = 0)) GROUP BY id, finding""")
def project_externals(spark, sf_dir):
    """SP1, R12, B5, B6, B15: systems that source text addresses, with their findings by file."""
    from lattica.operators import surface

    found = surface.findings(surface.Facts(externals=L.externals(sources(spark, sf_dir))))
    return found.groupBy(F.col("node").alias("id"), "finding").agg(F.count(F.lit(1)).alias("n"))


def _definitions(spark, sf_dir):
    tree = sources(spark, sf_dir)
    return tree, L.spans(L.facts(tree, L.DEFINITIONS))


@query("SELECT 'function:src/m' || (p_partkey % 40) || '.py#f_' || p_partkey AS src, 'abort(' AS said FROM part WHERE p_partkey % 8 = 0")
def early_checks(spark, sf_dir):
    """Refusals in the first lines of handlers."""
    return L.early_checks(*_definitions(spark, sf_dir)).select("src", "said")


@query("SELECT 'function:src/m' || (p_partkey % 40) || '.py#f_' || p_partkey AS src, 1 AS waits FROM part WHERE p_partkey % 14 = 0 AND p_partkey % 21 <> 0")
def stale_async(spark, sf_dir):
    """State written after an await without a check between."""
    return L.stale_writes(*_definitions(spark, sf_dir)).select("src", F.when(F.col("waited") < F.col("line"), 1).otherwise(0).alias("waits"))


@query("SELECT name, count(*) AS n FROM (SELECT 'KEY_' || (p_partkey % 6) AS name FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'Order' || (p_partkey % 8) FROM part WHERE p_partkey % 6 = 0) WHERE name IN ('KEY_2', 'KEY_4', 'Order4') GROUP BY name")
def text_mentions(spark, sf_dir):
    """Lines that hold a name."""
    names = spark.createDataFrame([("KEY_2",), ("KEY_4",), ("Order4",), ("nowhere",)], "name string")
    return L.mentions(sources(spark, sf_dir), names).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'function:src/m' || (p_partkey % 40) || '.py#f_' || p_partkey AS src FROM part WHERE p_partkey % 3 = 0")
def precedents(spark, sf_dir):
    """Functions that publish, as precedents of a plan."""
    tree, defs = _definitions(spark, sf_dir)
    return L.precedents(tree, defs, r"client\.publish\(").select("src")
