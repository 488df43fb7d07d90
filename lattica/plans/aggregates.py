"""Aggregation, ranking and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.operators import aggregate as A
from lattica.plans.registry import on_graph, query
from lattica.sources.fixture import edges, nodes, read


@query(on_graph("SELECT dst, count(DISTINCT src) AS users FROM edges WHERE kind IN ('READS_TABLE', 'WRITES_TABLE') GROUP BY dst ORDER BY users DESC, dst LIMIT 10"))
def top_tables(spark, sf_dir):
    """The tables with most distinct users."""
    return A.users_by_target(edges(spark, sf_dir), ["READS_TABLE", "WRITES_TABLE"], 10)


@query(on_graph("SELECT dst, count(DISTINCT src) AS users FROM edges WHERE kind = 'CALLS' GROUP BY dst HAVING count(DISTINCT src) > 1"))
def most_called(spark, sf_dir):
    """A3: functions with more than one caller."""
    return A.users_by_target(edges(spark, sf_dir), ["CALLS"]).where("users > 1")


@query(on_graph("""SELECT 'node kind' AS what, kind AS key, count(*) AS n FROM nodes GROUP BY kind
UNION ALL SELECT 'edge kind', kind, count(*) FROM edges GROUP BY kind UNION ALL SELECT 'confidence', confidence, count(*) FROM edges GROUP BY confidence
UNION ALL SELECT 'gated', (gate IS NOT NULL)::VARCHAR, count(*) FROM edges GROUP BY gate IS NOT NULL
UNION ALL SELECT 'entry kind', entry_kind, count(*) FROM nodes WHERE entry_kind IS NOT NULL GROUP BY entry_kind"""))
def graph_stats(spark, sf_dir):
    """Counts by kind, confidence, gate and entry kind."""
    return A.stats(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(on_graph("SELECT id, (SELECT count(*) FROM edges WHERE dst = nodes.id) AS n_in, (SELECT count(*) FROM edges WHERE src = nodes.id) AS n_out FROM nodes"))
def node_degrees(spark, sf_dir):
    """Edges in and out of every node."""
    return A.degree(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(on_graph("SELECT coalesce(file, 'none') AS connection, count(*) AS n, count(*) FILTER (gate IS NOT NULL) AS gated, min(src) AS sample FROM edges WHERE kind IN ('READS_TABLE', 'WRITES_TABLE') GROUP BY 1"))
def connections_seen(spark, sf_dir):
    """Data edges by connection, here the month of the shipment."""
    data = edges(spark, sf_dir).where(F.col("kind").isin("READS_TABLE", "WRITES_TABLE"))
    return data.groupBy(F.coalesce("file", F.lit("none")).alias("connection")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gate").isNotNull()).alias("gated"), F.min("src").alias("sample"))


@query(on_graph("""SELECT u.src AS id, count(*) AS shared, round(count(*) / (SELECT count(*) FROM own), 2) AS containment FROM used u JOIN own USING (dst) WHERE u.src <> 'function:5' GROUP BY u.src ORDER BY shared DESC, id LIMIT 40""", "used AS (SELECT DISTINCT src, dst FROM edges WHERE kind IN ('READS_TABLE', 'WRITES_TABLE')), own AS (SELECT dst FROM used WHERE src = 'function:5')"))
def co_callers(spark, sf_dir):
    """Functions that use the tables one function uses, by the share of its tables."""
    return A.co_callers(edges(spark, sf_dir), spark.createDataFrame([("function:5",)], "id string"), ["READS_TABLE", "WRITES_TABLE"])


@query(on_graph("SELECT src, dst, kind, confidence FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY conf_rank DESC, kind, coalesce(line, -1), coalesce(file, ''), coalesce(gate, '')) AS n FROM edges) WHERE n = 1"))
def first_per_pair(spark, sf_dir):
    """One edge for each pair of nodes."""
    e = edges(spark, sf_dir)
    out = A.first_per_pair(e, ["src", "dst"], [F.desc("conf_rank"), F.col("kind"), F.coalesce("line", F.lit(-1)), F.coalesce("file", F.lit("")), F.coalesce("gate", F.lit(""))])
    return out.select("src", "dst", "kind", "confidence")


@query(on_graph("SELECT id, name, count(*) OVER (PARTITION BY name) AS same, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' (' || file || ')' ELSE name END AS shown FROM nodes WHERE kind = 'function'"))
def unique_labels(spark, sf_dir):
    """Names that more than one function has get their file."""
    out = A.label_counts(nodes(spark, sf_dir).where("kind = 'function'"), F.col("name"))
    return out.select("id", "name", "same", F.when(F.col("same") > 1, F.concat(F.col("name"), F.lit(" ("), F.col("file"), F.lit(")"))).otherwise(F.col("name")).alias("shown"))


@query("""SELECT signature, count(*) AS n, min(conv) AS sample FROM (SELECT conv_id AS conv, string_agg(role, '>' ORDER BY turn, role) AS signature FROM conversations GROUP BY conv_id) GROUP BY signature""")
def chain_signatures(spark, sf_dir):
    """Conversations grouped by the sequence of their roles."""
    c = read(spark, sf_dir, "conversations")
    return A.signature_groups(c, "conv_id", "turn", F.col("role"))


@query(on_graph("""SELECT class, count(*) AS n, count(*) FILTER (gated) AS gated FROM (SELECT DISTINCT src, CASE entry_kind WHEN 'http_route' THEN 'runtime' WHEN 'queue_job' THEN 'runtime' WHEN 'cli_command' THEN 'operator' WHEN 'ui_page' THEN 'ui' ELSE 'dev' END AS class, bool_or(gate IS NOT NULL) OVER (PARTITION BY src) AS gated FROM edges JOIN nodes ON nodes.id = src WHERE edges.kind = 'ROUTES_TO') GROUP BY class"""))
def entries_by_class(spark, sf_dir):
    """Routes by class, and those with a gated edge."""
    from lattica.operators.traverse import classify

    routed = edges(spark, sf_dir).where("kind = 'ROUTES_TO'").groupBy(F.col("src").alias("id")).agg(F.bool_or(F.col("gate").isNotNull()).alias("gated"))
    return routed.join(nodes(spark, sf_dir).select("id", "entry_kind"), "id").groupBy(classify(F.array("entry_kind")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if("gated").alias("gated"))


@query("SELECT bucket, count(*) AS n, round(avg(len), 6) AS mean FROM (SELECT n_chars AS len, CASE WHEN n_chars <= 100 THEN '<=100' WHEN n_chars <= 1000 THEN '<=1000' WHEN n_chars <= 10000 THEN '<=10000' ELSE '>10000' END AS bucket FROM documents) GROUP BY bucket")
def size_buckets(spark, sf_dir):
    """Documents by the first size bucket that holds them."""
    d = read(spark, sf_dir, "documents")
    return d.groupBy(A.bins(F.col("n_chars"), [100, 1000, 10000]).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("""WITH f AS (SELECT DISTINCT 's' || l_suppkey AS item, 'p' || l_partkey AS feature, l_suppkey % 2 AS side FROM lineitem),
n AS (SELECT count(DISTINCT item) AS n FROM f), w AS (SELECT feature, greatest(ln(n.n / (2.0 * count(*))), 0) AS w FROM f, n GROUP BY feature, n.n HAVING greatest(ln(n.n / (2.0 * count(*))), 0) > 0),
x AS (SELECT item, side, feature, w / sqrt(sum(w * w) OVER (PARTITION BY item)) AS w FROM f JOIN w USING (feature)),
scores AS (SELECT a.item AS a, b.item AS b, sum(a.w * b.w) AS score FROM x a JOIN x b USING (feature) WHERE a.side = 0 AND b.side = 1 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS na, lead(score) OVER (PARTITION BY a ORDER BY score DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS nb, lead(score) OVER (PARTITION BY b ORDER BY score DESC, a) AS rb FROM scores)
SELECT a, b, round(score, 6) AS score FROM r WHERE na = 1 AND nb = 1 AND coalesce(ra < score * 0.95, true) AND coalesce(rb < score * 0.95, true)""")
def structural_parity(spark, sf_dir):
    """Suppliers of two sides matched by the rare parts they share: cosine, mutual best, a margin."""
    item = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("item"), F.col("l_partkey").alias("feature"))
    scores = A.idf_cosine(item.where("item % 2 = 0"), item.where("item % 2 = 1"))
    named = lambda c: F.concat(F.lit("s"), c).alias(c)
    return A.mutual_best(scores, margin=0.95).select(named("a"), named("b"), F.round("score", 6).alias("score"))


@query("""SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS r FROM events GROUP BY event_type, user_id) WHERE r <= 3""")
def top_per_group(spark, sf_dir):
    """The three users with most events of each type."""
    n = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))).where("r <= 3").drop("r")


@query(on_graph("SELECT id FROM nodes WHERE kind = 'function' AND id NOT IN (SELECT dst FROM edges WHERE kind = 'OVERRIDDEN_BY') UNION SELECT id FROM nodes WHERE kind = 'class' AND id NOT IN (SELECT dst FROM edges WHERE kind = 'USES_TYPE')"))
def unreached(spark, sf_dir):
    """Functions that override nothing, and classes that no route uses."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    lost = lambda kind, by: n.where(F.col("kind") == kind).select("id").join(e.where(F.col("kind") == by).select(F.col("dst").alias("id")), "id", "left_anti")
    return lost("function", "OVERRIDDEN_BY").unionByName(lost("class", "USES_TYPE"))


@query("""WITH k AS (SELECT e.event_id, e.event_type AS t, json_keys(e.props) AS keys FROM events e)
SELECT t AS event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, count(*) FILTER (json_extract(props, '$.k')::BIGINT > 50) AS large FROM events JOIN k USING (event_id) GROUP BY t""")
def json_attributes(spark, sf_dir):
    """Attributes out of JSON text, summed by type."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.count_if(k > 50).alias("large"))
