"""Calls attributed through symbol tables: imports, modules, classes, receivers' types, inheritance.

A call's name is looked up in turn: in its file and through its imports (`symbols.resolve`), as a method of the class around it where it is
called on the object itself, as a method of the receiver's class where the receiver was given one (a constructor, an annotation, a
parameter's type, an attribute set in the class), each up the base classes, nearest first. Only what is found in none of these ways is
linked by its bare name, and only where that name is defined once.

Two functions of one name in two modules so get their own callers. Base classes are a frontier loop of joins with a visited set, so
circles of inheritance end; bases of other files are found through imports as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import symbols as S
from lattica.operators.languages import KEYWORDS
from lattica.operators.routing import Tree
from lattica.storage import cut

_SELF = r"^(self|this|cls|static|\$this|parent|super)\."
N = S.NAME


def _dots(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"super\(\)", "super"), r"(\?\.|->|::)", "."), r"(?<!\w)\$(?!this)", "")


def within(tree: Tree, rows: DataFrame) -> DataFrame:
    """rows (path, line, indent, ...) with fn (id), fn_name and owner of the function that they stand in; null outside of functions."""
    columns = rows.columns
    asked = rows.withColumn("start", F.col("line")).withColumn("name", F.lit("")).withColumn("qualified", F.lit("")).withColumn("at", F.col("line")).withColumn("level", F.col("indent"))
    defs = tree.defs.where("kind = 'function'").select("path", F.col("start").alias("line"), "indent", "kind", "name")
    met = S.nearest_outer(asked, defs).select(*columns, F.col("o_line").alias("start"))
    return met.join(tree.defs.where("kind = 'function'").select("path", "start", F.col("id").alias("fn"), F.col("qualified").alias("fn_name"), F.col("owner").alias("owner")), ["path", "start"], "left").drop("start")


def bases(tree: Tree) -> DataFrame:
    """path, class, pos, base_path, base: the classes that classes of the tree extend, in the order they name them."""
    heads = tree.lines.join(tree.defs.where("kind = 'class'").select("path", F.col("start").alias("line"), F.col("qualified").alias("class")), ["path", "line"])
    python = F.regexp_extract("s", r"^class\s+\w+\s*\(([^()]*)\)", 1)
    extends = F.concat_ws(",", F.regexp_extract("s", r"\bextends\s+([\w.$\\, ]+?)(?:\s+(?:implements|with)\b|\s*[{<(]|$)", 1), F.regexp_extract("s", r"\bimplements\s+([\w.$\\, ]+?)\s*(?:\{|$)", 1))
    colon = F.regexp_extract("s", r"\bclass\s+\w+(?:\([^)]*\))?\s*:\s*([\w., ()]+?)\s*\{?\s*$", 1)
    said = F.when(F.col("lang") == "python", python).when(F.col("lang").isin("kotlin", "swift"), F.regexp_replace(colon, r"\([^)]*\)", "")).otherwise(extends)
    each = heads.select("path", "class", F.posexplode(F.split(said, r"\s*,\s*")).alias("pos", "name")).withColumn("name", F.trim("name")).where(F.col("name").rlike(rf"^{S.DOTTED}$"))
    led = S.resolve(each.select("path", "name"), tree.defs.where("kind = 'class'").select("path", F.col("qualified").alias("name")), tree.bound)
    return each.join(led, ["path", "name"]).select("path", "class", "pos", F.col("to_path").alias("base_path"), F.col("to_name").alias("base")).where("path <> base_path or class <> base")


def methods(asked: DataFrame, tree: Tree, up: DataFrame) -> DataFrame:
    """key, id: the method that a lookup (key, path, class, method) finds in the class or its nearest base that has one; among equally near ones the first named."""
    own = tree.defs.where("kind = 'function' and owner is not null").select("path", F.col("owner").alias("class"), F.col("name").alias("method"), "id")
    state = cut(asked.select("key", "path", "class", "method").distinct().withColumn("rank", F.array().cast("array<int>")), "method-lookups")
    seen = state.select("key", "path", "class")
    out = None
    for _ in range(S.DEEPEST):
        met = cut(state.join(own, ["path", "class", "method"], "left"), "methods-met")
        hits = met.where("id is not null").groupBy("key").agg(F.min(F.struct("rank", "id"))["id"].alias("id"))
        out = hits if out is None else out.unionByName(hits)
        left = met.where("id is null").drop("id").join(hits, "key", "left_anti")
        fresh = left.join(up, ["path", "class"]).select("key", F.col("base_path").alias("path"), F.col("base").alias("class"), "method", F.array_append("rank", F.col("pos")).alias("rank"))
        state = cut(fresh.groupBy("key", "path", "class", "method").agg(F.min("rank").alias("rank")).join(seen, ["key", "path", "class"], "left_anti"), "method-lookups")
        if state.isEmpty():
            break
        seen = seen.unionByName(state.select("key", "path", "class"))
    return out


def receivers(tree: Tree, placed: DataFrame) -> DataFrame:
    """path, fn, var, class_path, class: classes that names of a function, or attributes `self.x` of a class (fn: its key), are given."""
    T = r"(?:[a-z_]\w*\.)*[A-Z][\w.$]*"
    of = lambda p, k=1: F.regexp_extract("s", p, k)
    made = rf"^(?:(?:const|let|var|val|final|auto)\s+)?(\$?(?:self\.|this\.|\$this->)?{N})\s*(?::\s*[\w.<>\[\]| ]+)?\s*:?=\s*(?:await\s+)?(?:new\s+)?\\?({T})\s*\("
    typed = rf"^(?:(?:const|let|var|val|final)\s+)?((?:self\.|this\.)?{N})\s*:\s*({T})\s*(?:=|;|$)"
    java = rf"^(?:(?:private|public|protected|final|static)\s+)*({T})(?:<[^>]*>)?\s+\$?({N})\s*(?:=|;)"
    body = placed.where("fn is not null")
    given = body.where(F.col("s").rlike(made)).select("path", "fn", "owner", of(made).alias("var"), of(made, 2).alias("type"))
    given = given.unionByName(body.where(F.col("s").rlike(typed)).select("path", "fn", "owner", of(typed).alias("var"), of(typed, 2).alias("type")))
    given = given.unionByName(body.where(F.col("s").rlike(java)).select("path", "fn", "owner", of(java, 2).alias("var"), of(java).alias("type")))
    heads = tree.lines.join(tree.defs.where("kind = 'function'").select("path", F.col("start").alias("line"), F.col("id").alias("fn"), "owner"), ["path", "line"])
    one = rf"(\$?{N}\s*\??:\s*['\"]?{T}|\b{T}(?:<[^>]*>)?\s+\$?{N}\b)"
    params = heads.select("path", "fn", "owner", F.explode(F.regexp_extract_all(F.regexp_extract("s", r"\((.*)\)", 1), F.lit(one), F.lit(1))).alias("s"))
    after = rf"^\$?({N})\s*\??:\s*['\"]?({T})"
    before = rf"^({T})(?:<[^>]*>)?\s+\$?({N})"
    params = params.select("path", "fn", "owner", F.when(F.col("s").rlike(after), of(after)).otherwise(of(before, 2)).alias("var"), F.when(F.col("s").rlike(after), of(after, 2)).otherwise(of(before)).alias("type"))
    # attributes that a class declares outside of its methods, or takes as parameters of its constructor
    attrs = placed.where("fn is null and around is not null")
    declared = attrs.where(F.col("s").rlike(typed)).select("path", F.col("around").alias("owner"), of(typed).alias("var"), of(typed, 2).alias("type")).unionByName(attrs.where(F.col("s").rlike(java)).select("path", F.col("around").alias("owner"), of(java, 2).alias("var"), of(java).alias("type")))
    named = given.unionByName(params).withColumn("var", _dots(F.col("var")))
    onto = named.where(F.col("var").rlike(_SELF) & F.col("owner").isNotNull()).select("path", F.col("owner").alias("fn"), F.regexp_replace("var", _SELF, "").alias("var"), "type")
    onto = onto.unionByName(declared.select("path", F.col("owner").alias("fn"), "var", "type"))
    promoted = heads.where(F.col("s").rlike(r"^(?:constructor|public\s+function\s+__construct)\b|\bfunction\s+__construct\b")).select("path", "owner", F.explode(F.regexp_extract_all("s", F.lit(rf"(?:private|public|protected|readonly)\s+(?:readonly\s+)?({N}\s*:\s*{T}|\\?{T}\s+\${N})"), F.lit(1))).alias("s"))
    onto = onto.unionByName(promoted.where("owner is not null").select("path", F.col("owner").alias("fn"), F.when(F.col("s").rlike(after), of(after)).otherwise(of(before, 2)).alias("var"), F.when(F.col("s").rlike(after), of(after, 2)).otherwise(of(before)).alias("type")))
    every = cut(named.where(~F.col("var").rlike(_SELF)).select("path", "fn", "var", "type").unionByName(onto).distinct(), "receivers")
    led = S.resolve(every.select("path", F.col("type").alias("name")), tree.defs.where("kind = 'class'").select("path", F.col("qualified").alias("name")), tree.bound)
    return every.join(led.withColumnRenamed("name", "type"), ["path", "type"]).select("path", "fn", "var", F.col("to_path").alias("class_path"), F.col("to_name").alias("class"))


def sites(tree: Tree) -> tuple[DataFrame, DataFrame]:
    """Call sites (key, path, line, fn, owner, name) and all statements with the function and class that they stand in."""
    placed = within(tree, tree.lines.select("path", "lang", "line", "indent", "s"))
    classes = tree.defs.where("kind = 'class'").select("path", F.col("start").alias("line"), "indent", "kind", F.col("qualified").alias("name"))
    asked = placed.withColumn("start", F.col("line")).withColumn("name", F.lit("")).withColumn("qualified", F.lit("")).withColumn("at", F.col("line")).withColumn("level", F.col("indent"))
    placed = cut(S.nearest_outer(asked, classes).select(*placed.columns, F.col("o_name").alias("around")), "placed-statements")
    heads = tree.defs.select("path", F.col("start").alias("line"), F.lit(True).alias("head"))
    body = placed.join(heads, ["path", "line"], "left").where("head is null").where(~F.col("s").rlike(r"^(from|import|use|package|namespace)\b"))
    call = rf"((?:new\s+)?[\\$]?(?:super\(\)\.)?[$]?{N}(?:(?:\.|\?\.|->|::)\$?{N})*)\s*\("
    each = body.withColumn("name", F.explode(F.array_distinct(F.regexp_extract_all(S.bare(F.col("s")), F.lit(call), F.lit(1)))))
    each = each.withColumn("name", _dots(F.regexp_replace(F.regexp_replace("name", r"^new\s+", ""), r"^\\", ""))).where(~F.col("name").isin([*KEYWORDS, "super"]))
    return each.select("path", "line", "fn", "owner", "name").distinct().withColumn("key", F.xxhash64("path", "line", F.coalesce("fn", F.lit("")), "name")), placed


def resolved(tree: Tree) -> DataFrame:
    """src, dst, kind, file, line, confidence, conf_rank, gate, how: CALLS edges of a tree.

    how: name (by file and imports, exact), self, receiver, base (found in a base class; all resolved), once (by a bare name that is defined once, heuristic).
    """
    calls, placed = sites(tree)
    calls = cut(calls, "call-sites")
    known = tree.defs.select("path", F.col("qualified").alias("name"), "id")
    named = S.resolve(calls.where(~F.col("name").rlike(_SELF)).select("path", "name"), known.select("path", "name"), tree.bound)
    direct = calls.join(named, ["path", "name"]).join(known.select(F.col("path").alias("to_path"), F.col("name").alias("to_name"), "id"), ["to_path", "to_name"]).select("key", F.col("id").alias("dst"), F.lit("name").alias("how"))
    # a method's bare name isn't called without its class
    rest = calls.join(direct.select("key").distinct(), "key", "left_anti")
    up = cut(bases(tree), "bases")
    on_self = rest.where(F.col("name").rlike(rf"{_SELF}{N}$") & F.col("owner").isNotNull())
    begin = on_self.withColumn("method", F.regexp_replace("name", _SELF, ""))
    inherited = begin.where(F.col("name").rlike(r"^(super|parent)\.")).join(up, (begin["path"] == up["path"]) & (begin["owner"] == up["class"])).select("key", up["base_path"].alias("path"), up["base"].alias("class"), "method")
    lookups = begin.where(~F.col("name").rlike(r"^(super|parent)\.")).select("key", "path", F.col("owner").alias("class"), "method").unionByName(inherited).withColumn("by", F.lit("self"))
    held = receivers(tree, placed)
    dotted = rest.where(F.col("name").contains(".")).withColumn("method", F.element_at(F.split("name", r"\."), -1)).withColumn("var", F.regexp_replace("name", r"\.[^.]+$", ""))
    local = dotted.where(~F.col("var").rlike(_SELF)).join(held, ["path", "fn", "var"])
    attribute = dotted.where(F.col("var").rlike(_SELF) & F.col("owner").isNotNull()).withColumn("var", F.regexp_replace("var", _SELF, "")).join(held.select("path", F.col("fn").alias("owner"), "var", "class_path", "class"), ["path", "owner", "var"])
    # a class named by itself: its static methods, also those of its bases
    of_class = S.resolve(dotted.select("path", F.col("var").alias("name")), tree.defs.where("kind = 'class'").select("path", F.col("qualified").alias("name")), tree.bound)
    static = dotted.join(of_class.select("path", F.col("name").alias("var"), F.col("to_path").alias("class_path"), F.col("to_name").alias("class")), ["path", "var"])
    typed = local.select("key", F.col("class_path").alias("path"), "class", "method").unionByName(attribute.select("key", F.col("class_path").alias("path"), "class", "method")).unionByName(static.select("key", F.col("class_path").alias("path"), "class", "method"))
    lookups = cut(lookups.unionByName(typed.withColumn("by", F.lit("receiver"))).withColumn("call", F.col("key")).withColumn("key", F.xxhash64("call", "path", "class", "method")), "lookups")
    found = methods(lookups, tree, up).withColumnRenamed("id", "dst")
    at = tree.defs.select(F.col("id").alias("dst"), F.col("path").alias("dst_path"), F.col("owner").alias("dst_owner"))
    by_type = lookups.join(found, "key").join(at, "dst").select(F.col("call").alias("key"), "dst", F.when((F.col("dst_path") == F.col("path")) & (F.col("dst_owner") == F.col("class")), F.col("by")).otherwise("base").alias("how"))
    once = tree.defs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("dst")).where("n = 1").select(F.col("name").alias("last"), "dst")
    open_ = rest.join(by_type.select("key").distinct(), "key", "left_anti").withColumn("last", F.element_at(F.split("name", r"\."), -1))
    guessed = open_.join(once, "last").select("key", "dst", F.lit("once").alias("how"))
    met = calls.join(direct.unionByName(by_type).unionByName(guessed), "key").withColumn("src", F.coalesce("fn", F.concat(F.lit("file:"), "path"))).where("src <> dst")
    confidence = F.when(F.col("how") == "name", "exact").when(F.col("how") == "once", "heuristic").otherwise("resolved")
    rank = F.when(F.col("how") == "name", 3).when(F.col("how") == "once", 1).otherwise(2)
    return met.select("src", "dst", F.lit("CALLS").alias("kind"), F.col("path").alias("file"), "line", confidence.alias("confidence"), rank.alias("conf_rank"), F.lit(None).cast("string").alias("gate"), "how").distinct()


def overrides(tree: Tree) -> DataFrame:
    """src, dst, kind: OVERRIDDEN_BY edges from the nearest base's method to the one that replaces it."""
    up = cut(bases(tree), "bases")
    own = tree.defs.where("kind = 'function' and owner is not null").select("path", F.col("owner").alias("class"), F.col("name").alias("method"), "id")
    asked = own.join(up, ["path", "class"]).select(F.col("id").alias("key"), F.col("base_path").alias("path"), F.col("base").alias("class"), "method")
    return methods(asked, tree, up).select(F.col("id").alias("src"), F.col("key").alias("dst"), F.lit("OVERRIDDEN_BY").alias("kind")).where("src <> dst")
