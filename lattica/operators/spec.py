"""Finding nodes: specs by tiers, substring and fuzzy search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(nodes: DataFrame, specs: DataFrame) -> DataFrame:
    """spec, id, tier: the nodes of the first tier that has any.

    Tiers: id, `file#name`, file, `kind:glob`, name, and the end of a qualified name after a dot. Each
    tier is an equi-join, globs apart, which are few.
    """
    n = nodes.select("id", "kind", "name", "fqn", "file")
    s = specs.select("spec").distinct()
    by = lambda tier, key: n.select("id", key.alias("spec")).where("spec is not null").join(s, "spec").select("spec", "id", F.lit(tier).alias("tier"))
    parts = F.split("fqn", r"\.")
    ends = n.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, -i, i), "."))).alias("spec"), "fqn").where("spec <> fqn").drop("fqn").join(s, "spec").select("spec", "id", F.lit(6).alias("tier"))
    out = by(1, F.col("id")).unionByName(by(2, F.concat_ws("#", "file", "name"))).unionByName(by(3, F.col("file"))).unionByName(by(5, F.col("name"))).unionByName(ends)
    globs = s.where("spec like '%*%'").select("spec", F.substring_index("spec", ":", 1).alias("kind"), F.concat(F.lit("^"), F.replace(F.regexp_replace("spec", r"([.+?^$(){}|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("$")).alias("rx"))
    out = out.unionByName(n.join(globs, "kind").where(F.regexp_like("id", F.col("rx"))).select("spec", "id", F.lit(4).alias("tier")))
    best = out.groupBy("spec").agg(F.min("tier").alias("best"))
    return out.join(best, "spec").where("tier = best").select("spec", "id", "tier").distinct()


def like_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search(nodes: DataFrame, text: str, limit: int = 20, kind: str | None = None, fuzzy: bool = False) -> DataFrame:
    """Nodes whose name, qualified name or id holds a text in any case, shortest ids first; with fuzzy, its letters in order."""
    if fuzzy:
        pattern = "(?is)" + ".*".join(f"\\Q{c}\\E" for c in text)
        fits: Column = F.col("name").rlike(pattern) | F.col("fqn").rlike(pattern) | F.col("id").rlike(pattern)
    else:
        low = f"%{like_escape(text.lower())}%"
        fits = F.lower("name").like(low) | F.lower("fqn").like(low) | F.lower("id").like(low)
    if kind:
        fits &= F.col("kind") == kind
    return nodes.where(fits).orderBy(F.length("id"), "id").limit(limit)
