"""Questions in words over the graph, with SQL that walks by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import renames
from lattica.operators.explore import explore
from lattica.plans.registry import on_graph, query
from lattica.plans.traversal import CALLS, PROPAGATES, up, walk_sql
from lattica.sources.fixture import edges, nodes, read

QUESTION = "Where does the code handle small widgets and red plates?"

_WORDS = "handle small widget red plat".split()
_SCORE = " + ".join(f"CASE WHEN contains(lower(coalesce(name, '')), '{w}') THEN 10 WHEN contains(lower(id), '{w}') THEN 4 ELSE 0 END" for w in _WORDS)
_BEST = f"""best AS (SELECT *, row_number() OVER (ORDER BY score DESC, length(id), id) AS place FROM (
  SELECT id, kind, name, line, end_line, {_SCORE} + CASE kind WHEN 'function' THEN 3 WHEN 'route' THEN 3 WHEN 'class' THEN 2 WHEN 'table' THEN 2 ELSE 0 END AS score FROM nodes
  WHERE kind NOT IN ('module', 'package') AND coalesce(entry_kind, '') <> 'test' OR kind = 'package') WHERE score >= 10 ORDER BY score DESC, length(id), id LIMIT 4)"""
_UP = walk_sql("climbed", "SELECT id, id AS grp FROM best WHERE kind <> 'table'", up(CALLS), "id, grp")
_DOWN = walk_sql("sunk", "SELECT id, id AS grp FROM best WHERE kind <> 'table'", f"SELECT DISTINCT src AS comes, dst AS goes FROM edges WHERE {PROPAGATES} AND kind NOT IN ('READS_TABLE', 'WRITES_TABLE')", "id, grp")


@query(on_graph("""
SELECT id AS symbol, 'symbol' AS section, place, kind AS item, score::BIGINT AS n FROM best
UNION ALL SELECT b.id, 'callers', 0, '', (SELECT count(*) FROM climbed c JOIN nodes USING (id) WHERE c.grp = b.id AND c.depth > 0 AND entry_kind IS NULL) FROM best b WHERE kind NOT IN ('table', 'route')
UNION ALL SELECT b.id, 'entries', 0, '', (SELECT count(*) FROM climbed c JOIN nodes USING (id) WHERE c.grp = b.id AND c.depth > 0 AND entry_kind IS NOT NULL) FROM best b WHERE kind NOT IN ('table', 'route')
UNION ALL SELECT grp, 'entry', place, id, depth FROM (SELECT c.grp, c.id, c.depth, row_number() OVER (PARTITION BY c.grp ORDER BY n.entry_kind, n.name, n.id) AS place FROM climbed c JOIN nodes n ON n.id = c.id JOIN best b ON b.id = c.grp WHERE b.kind <> 'route' AND c.depth > 0 AND n.entry_kind IS NOT NULL) WHERE place <= 6
UNION ALL SELECT DISTINCT s.grp, CASE e.kind WHEN 'WRITES_TABLE' THEN 'writes' ELSE 'reads' END, 0, e.dst, NULL FROM sunk s JOIN edges e ON e.src = s.id WHERE e.kind IN ('READS_TABLE', 'WRITES_TABLE')
UNION ALL SELECT c.grp, 'path', 0, min(c.id), c.depth FROM climbed c JOIN nodes n ON n.id = c.id JOIN best b ON b.id = c.grp WHERE b.kind <> 'route' AND c.depth > 0 AND n.entry_kind IS NOT NULL AND c.depth = (SELECT min(d.depth) FROM climbed d JOIN nodes m ON m.id = d.id WHERE d.grp = c.grp AND d.depth > 0 AND m.entry_kind IS NOT NULL) GROUP BY c.grp, c.depth
UNION ALL SELECT c.grp, 'between', 0, c.id, c.depth FROM climbed c JOIN best b ON b.id = c.id WHERE c.id <> c.grp""", f"{_BEST}, {_UP}, {_DOWN}"))
def explored(spark, sf_dir):
    """An answer to a question in words: best symbols, callers, entries, tables below and shortest ways; sources and texts of paths are left to tests."""
    found = explore(nodes(spark, sf_dir), edges(spark, sf_dir), QUESTION)
    return found.where("section <> 'source'").select("symbol", "section", F.col("place").cast("int").alias("place"), "item", "n")


_NAMES = """l AS (SELECT c_custkey AS k, c_mktsegment AS kind, 'Item' || c_custkey || CASE c_custkey % 4 WHEN 3 THEN 'Model' ELSE 'Screen' END AS name FROM customer),
r AS (SELECT c_custkey AS k, c_mktsegment AS kind, 'item' || c_custkey || '_' || CASE WHEN c_custkey % 4 = 3 THEN 'entity' || (c_custkey % 8) WHEN c_custkey % 50 = 0 THEN 'dialog' ELSE 'page' END AS name FROM customer WHERE c_custkey % 7 <> 0),
given AS (SELECT l.k AS a, r.k AS b FROM l JOIN r USING (k) WHERE k % 5 = 0),
said AS (SELECT CASE WHEN a % 4 = 3 THEN 'model' ELSE 'screen' END AS was, CASE WHEN a % 4 = 3 THEN 'entity' || (a % 8) WHEN a % 50 = 0 THEN 'dialog' ELSE 'page' END AS now FROM given),
counted AS (SELECT was, now, count(*) AS support, sum(count(*)) OVER (PARTITION BY was) AS total FROM said GROUP BY was, now),
rules AS (SELECT was, now FROM counted WHERE support >= 2 AND support * 3 >= total * 2)"""


def _two_sides(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    left = c.select(k.alias("id"), F.col("c_mktsegment").alias("kind"), F.concat(F.lit("Item"), text, F.when(k % 4 == 3, "Model").otherwise("Screen")).alias("name"))
    end = F.when(k % 4 == 3, F.concat(F.lit("entity"), (k % 8).cast("string"))).when(k % 50 == 0, "dialog").otherwise("page")
    right = c.where("c_custkey % 7 <> 0").select(k.alias("id"), F.col("c_mktsegment").alias("kind"), F.concat(F.lit("item"), text, F.lit("_"), end).alias("name"))
    pairs = left.select(F.col("id").alias("a")).join(right.select(F.col("id").alias("b")), F.col("a") == F.col("b")).where("a % 5 = 0")
    return pairs, left, right


@query(f"""WITH {_NAMES} SELECT a, b, 'given' AS how FROM given
UNION ALL SELECT l.k, r.k, 'learned' FROM l JOIN r ON r.k = l.k JOIN rules ON ends_with(l.name, upper(was[1]) || was[2:]) AND ends_with(r.name, '_' || now) WHERE l.k NOT IN (SELECT a FROM given)""")
def learned_renames(spark, sf_dir):
    """Rename rules learned from known pairs match the rest; what rare pairs say isn't learned."""
    return renames.matched(*_two_sides(spark, sf_dir))[0]


@query(f"WITH {_NAMES} SELECT 'tail' AS at, was, now FROM rules")
def rename_rules(spark, sf_dir):
    """The rules themselves, after what they matched was learned from, too."""
    return renames.matched(*_two_sides(spark, sf_dir))[1].select("at", "was", "now")
