"""Scoped symbol tables: what a name in a file stands for, through imports, aliases, re-exports, types and constants.

Everything is rows and joins. Source text is cut into statements (a call over many lines is one), statements give
definitions with the class they belong to, bindings (a name of a file that stands for a name of another), assignments and
calls. `resolve` follows bindings by a frontier loop of equi-joins until a definition is met, so aliases of aliases,
re-exports and `*` are a fixpoint; what it has seen it leaves out, so cycles of imports end. The loops write each
step to the shared folder.

Python, JavaScript/TypeScript, PHP, Java and Kotlin are read; statements are told by brackets and indents, so a file
that isn't laid out in the usual way gives less, never wrong owners across files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.operators.joins import as_of
from lattica.operators.languages import DEFINITIONS, Rule, facts, language
from lattica.storage import cut

#: Steps of aliases that are followed at most; longer chains than a program has.
DEEPEST = 64
NAME = r"[A-Za-z_$][\w$]*"
DOTTED = rf"{NAME}(?:\.{NAME})*"
#: What stands for a part of a text that isn't known.
HOLE = "{?}"

#: Methods of a script's class, which have no word before them.
METHODS = [Rule("definition", "function", "typescript", rf"^\s+(?:(?:async|static|public|private|protected|get|set|override)\s+)*(?!(?:if|for|while|switch|catch|function|return|await|else|do|new|typeof|super)\b)({NAME})\s*\((?:[^()]|\([^()]*\))*\)\s*(?::\s*[^{{=]+)?\{{\s*\}}?\s*$")]

_STRING = r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`)"""


def bare(text: Column) -> Column:
    """A line without the contents of its strings and without its comment."""
    return F.regexp_replace(F.regexp_replace(text, _STRING, '""'), r"(^|\s)(#|//).*$", "")


def statements(sources: DataFrame) -> DataFrame:
    """path, lang, line, indent, depth, s: logical lines of the sources (path, text).

    A statement goes on while round or square brackets are open, but ends where a block opens (`... => {`, `) {`): the
    block's lines are statements of their own. `depth` is the number of braces open before it.
    """
    lines = sources.withColumn("lang", language(F.col("path"))).where("lang is not null").select("path", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n", -1)).alias("at", "l"))
    code = lines.select("path", "lang", (F.col("at") + 1).alias("line"), "l", bare(F.col("l")).alias("b")).where(~F.col("b").rlike(r"^\s*(\*.*|/\*.*)?$"))
    count = lambda signs: F.length(F.regexp_replace("b", f"[^{signs}]", ""))
    net = count(r"(\[") - count(r")\]")
    opens = F.col("b").rlike(r"(=>|\)|[\w$>])\s*\{\s*$") & (F.col("lang") != "python")
    marked = code.withColumn("net", F.when(opens, F.least(net, F.lit(0))).otherwise(net)).withColumn("braces", count("{") - count("}"))
    so_far = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    level = marked.withColumn("sum", F.sum("net").over(so_far)).withColumn("depth", F.coalesce(F.sum("braces").over(before), F.lit(0)))
    level = level.withColumn("open", F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far)))  # a sum that never falls below 0
    starts = level.withColumn("first", F.coalesce(F.lag("open").over(Window.partitionBy("path").orderBy("line")), F.lit(0)) == 0)
    held = starts.withColumn("begin", F.last(F.when(F.col("first"), F.col("line")), ignorenulls=True).over(so_far))
    indent = F.length(F.regexp_extract("l", r"^(\s*)", 1))
    parts = held.groupBy("path", "lang", F.col("begin").alias("line")).agg(F.array_sort(F.collect_list(F.struct("line", "l", indent.alias("indent"), "depth"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda x: F.trim(x["l"])), " ")
    return parts.select("path", "lang", "line", F.col("parts")[0]["indent"].alias("indent"), F.col("parts")[0]["depth"].alias("depth"), F.when(F.size("parts") > 1, joined).otherwise(F.trim(F.col("parts")[0]["l"])).alias("s"))


def _module(path: Column) -> Column:
    """How other files name a file: its path without ending, an index or initialiser by its folder."""
    return F.regexp_replace(F.regexp_replace(path, r"\.[A-Za-z]+$", ""), r"/(__init__|index|mod)$", "")


def python_modules(path: Column) -> Column:
    """The dotted names of a Python file: from the tree's root, and from a source folder at its top."""
    whole = F.regexp_replace(_module(path), "/", ".")
    return F.array_distinct(F.array(whole, F.regexp_replace(whole, r"^(?:src|lib)\.", "")))


def definitions(sources: DataFrame) -> DataFrame:
    """id, path, lang, kind, name, qualified, owner, start, indent of classes and functions.

    The owner is the class at the next smaller indent before it; `qualified` is the name behind its owner's.
    """
    lines = sources.withColumn("lang", language(F.col("path"))).where("lang is not null").select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n", -1)).alias("at", "l"))
    indents = lines.select("path", (F.col("at") + 1).alias("line"), F.length(F.regexp_extract("l", r"^(\s*)", 1)).alias("indent"))
    found = facts(sources, DEFINITIONS + METHODS).where("name <> ''").groupBy("path", "lang", "line").agg(F.min(F.struct("kind", "name")).alias("d")).select("path", "lang", "line", "d.*").join(indents, ["path", "line"])
    return _owned(cut(found, "definitions-found"))


def _owned(found: DataFrame) -> DataFrame:
    """Definitions with the chain of classes around them: a step finds the definition at the next smaller indent, one step a level."""
    base = found.withColumnRenamed("line", "start").withColumn("qualified", F.col("name")).withColumn("owner", F.lit(None).cast("string")).withColumn("at", F.col("start")).withColumn("level", F.col("indent"))
    done = None
    state = base
    for _ in range(DEEPEST):
        outer = nearest_outer(state, found)
        up = outer.where("o_line is not null")
        finished = outer.where("o_line is null").drop("o_line", "o_indent", "o_kind", "o_name")
        done = finished if done is None else done.unionByName(finished)
        is_class = F.col("o_kind") == "class"
        state = cut(
            up.select(
                "path", "lang", "start", "kind", "name", "indent",
                F.when(is_class, F.concat_ws(".", "o_name", "qualified")).otherwise(F.col("qualified")).alias("qualified"),
                F.when(is_class, F.when(F.col("owner").isNull(), F.col("o_name")).otherwise(F.concat_ws(".", "o_name", "owner"))).otherwise(F.col("owner")).alias("owner"),
                F.col("o_line").alias("at"), F.col("o_indent").alias("level"),
            ),
            "definitions-owned",
        )
        if state.isEmpty():
            break
    return done.select(F.concat("kind", F.lit(":"), "path", F.lit("#"), "qualified").alias("id"), "path", "lang", "kind", "name", "qualified", "owner", "start", "indent")


def nearest_outer(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (path, at, level) with o_line, o_indent, o_kind, o_name of the last definition before them at a smaller indent; null where there is none.

    Each row asks at every indent that definitions of its file have and that is smaller: one as-of join by (path, indent).
    """
    levels = found.groupBy("path").agg(F.collect_set("indent").alias("levels"))  # a few numbers a file
    asked = rows.withColumn("row", F.xxhash64("path", "start", "name", "qualified")).join(levels, "path", "left").withColumn("ask", F.explode_outer(F.filter("levels", lambda x: x < F.col("level")))).drop("levels")
    key = F.concat_ws("\0", "path", F.col("ask").cast("string"))
    offered = found.select(F.concat_ws("\0", "path", F.col("indent").cast("string")).alias("key"), F.col("line").alias("o_line"), F.col("indent").alias("o_indent"), F.col("kind").alias("o_kind"), F.col("name").alias("o_name"))
    met = as_of(asked.withColumn("key", key).withColumn("until", F.col("at") - 1), offered, "key", "until", "o_line", ["o_line", "o_indent", "o_kind", "o_name"])
    columns = rows.columns
    best = met.groupBy("row", *columns).agg(F.max(F.struct("o_line", "o_indent", "o_kind", "o_name")).alias("o"))
    return best.select(*columns, "o.o_line", "o.o_indent", "o.o_kind", "o.o_name")


def _folded(path: Column) -> Column:
    """A path without `.` and `..`."""
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))), "/")


def _pairs(listed: Column, between: str) -> Column:
    """Rows (target, alias) of a list such as `a, b as c`; comments and types' marks fall away."""
    items = F.filter(F.transform(F.split(F.regexp_replace(listed, r"[(){}]", ""), ","), lambda x: F.regexp_replace(F.trim(x), r"^type\s+", "")), lambda x: x != "")
    return F.transform(items, lambda x: F.struct(F.trim(F.element_at(F.split(x, between), 1)).alias("target"), F.trim(F.element_at(F.split(x, between), -1)).alias("alias")))


def bindings(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """path, alias, to_path, to_name: names of a file that stand for a name of another file, or for the file (to_name null).

    Alias `*` passes on all names of the other file. Targets are files of the tree; what is imported from elsewhere has no row.
    """
    files = sources.withColumn("lang", language(F.col("path"))).where("lang is not null")
    module = F.explode(F.when(F.col("lang") == "python", python_modules(F.col("path"))).otherwise(F.array(_module(F.col("path")))))
    package = F.regexp_extract("text", r"(?m)^\s*(?:package|namespace)\s+([\w.\\]+)", 1)
    by_package = files.where(F.col("lang").isin("java", "kotlin", "php")).select(F.col("path").alias("to_path"), F.concat_ws(".", F.when(package != "", F.translate(package, "\\", ".")), F.regexp_extract("path", r"([^/]+)\.\w+$", 1)).alias("key"))
    known = files.where("lang in ('python', 'typescript')").select(F.col("path").alias("to_path"), module.alias("key")).unionByName(by_package).groupBy("key").agg(F.min("to_path").alias("to_path"))
    here = F.regexp_replace(F.regexp_replace("path", r"/?[^/]+$", ""), "/", ".")
    got = lambda p, k=1: F.regexp_extract("s", p, k)
    python = lines.where("lang = 'python'")
    from_ = r"^from\s+([\w.]+)\s+import\s+(.+)$"
    dots = F.length(F.regexp_extract(got(from_), r"^(\.*)", 1))
    base = F.when(dots == 0, F.regexp_replace(got(from_), r"^\.+", "")).otherwise(F.concat_ws(".", F.expr("nullif(array_join(slice(split(here, '[.]'), 1, greatest(size(split(here, '[.]')) - dots + 1, 0)), '.'), '')"), F.expr("nullif(regexp_replace(spec, '^[.]+', ''), '')")))
    p1 = python.where(F.col("s").rlike(from_)).withColumn("here", here).withColumn("spec", got(from_)).withColumn("dots", dots).withColumn("module", base).withColumn("pair", F.explode(_pairs(got(from_, 2), r"\s+as\s+")))
    p1 = p1.select("path", F.col("pair.alias").alias("alias"), "module", F.col("pair.target").alias("target"))
    p2 = python.where(F.col("s").rlike(r"^import\s+")).withColumn("pair", F.explode(_pairs(got(r"^import\s+(.+)$"), r"\s+as\s+"))).select("path", F.col("pair.alias").alias("alias"), F.col("pair.target").alias("module"), F.lit(None).cast("string").alias("target"))
    script = lines.where("lang = 'typescript'")
    folder = F.regexp_extract("path", r"^(.*/)?[^/]+$", 1)
    spec = got(r"""(?:from|require\(|import\()\s*["']([^"']+)["']""")
    target = F.regexp_replace(F.when(spec.startswith("."), _folded(F.concat(folder, spec))).when(spec.startswith("@/"), F.concat(F.lit("src/"), F.expr("substring(spec, 3)"))), r"(\.(js|ts|tsx|jsx|mjs|vue)|/index)$", "")
    j = script.where(F.col("s").rlike(r"""\b(?:from|require\(|import\()\s*["']""")).withColumn("spec", spec).withColumn("module", target).where("module is not null")
    braces = r"(?:import|export)\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{([^}]*)\}"
    j1 = j.where(F.col("s").rlike(braces)).withColumn("pair", F.explode(_pairs(got(braces), r"\s+as\s+"))).select("path", F.col("pair.alias").alias("alias"), "module", F.col("pair.target").alias("target"))
    j2 = j.where(F.col("s").rlike(rf"^import\s+{NAME}\b(?!\s*=)")).select("path", got(rf"^import\s+({NAME})").alias("alias"), "module", F.lit("default").alias("target"))
    j3 = j.where(F.col("s").rlike(r"\*\s+as\s+")).select("path", got(rf"\*\s+as\s+({NAME})").alias("alias"), "module", F.lit(None).cast("string").alias("target"))
    j4 = j.where(F.col("s").rlike(r"^export\s+\*\s+from")).select("path", F.lit("*").alias("alias"), "module", F.lit("*").alias("target"))
    unpack = r"^(?:const|let|var)\s+\{([^}]*)\}\s*="
    j5 = j.where(F.col("s").rlike(unpack)).withColumn("pair", F.explode(_pairs(got(unpack), r"\s*:\s*"))).select("path", F.col("pair.alias").alias("alias"), "module", F.col("pair.target").alias("target"))
    whole = rf"^(?:const|let|var)\s+({NAME})\s*=\s*require\("
    j6 = j.where(F.col("s").rlike(whole)).select("path", got(whole).alias("alias"), "module", F.lit("default").alias("target"))
    use = r"^(?:use|import)\s+(?:static\s+)?([\w.\\]+?)(?:\s+as\s+(\w+))?\s*;?$"
    dotted = F.translate(got(use), "\\", ".")
    other = lines.where(F.col("lang").isin("php", "java", "kotlin") & F.col("s").rlike(use)).select("path", F.when(got(use, 2) != "", got(use, 2)).otherwise(F.element_at(F.split(dotted, r"\."), -1)).alias("alias"), dotted.alias("module"), F.element_at(F.split(dotted, r"\."), -1).alias("target"))
    wanted = p1.unionByName(p2).unionByName(j1).unionByName(j2).unionByName(j3).unionByName(j4).unionByName(j5).unionByName(j6).unionByName(other).where("alias <> '' and module <> ''")
    # `from package import module`: the file of that name, if there is one
    inner = wanted.where("target is not null").join(known.select(F.col("key").alias("inner_key"), F.col("to_path").alias("inner_path")), F.concat_ws(".", "module", "target") == F.col("inner_key"), "left")
    inner = inner.unionByName(wanted.where("target is null"), allowMissingColumns=True)
    met = inner.join(known.withColumnRenamed("key", "module"), "module", "left").where("inner_path is not null or to_path is not null")
    rows = met.select("path", "alias", F.coalesce("inner_path", "to_path").alias("to_path"), F.when(F.col("inner_path").isNull(), F.col("target")).alias("to_name"))
    # `import a.b` is named a.b in the text: its head stands for nothing by itself, so the whole is the alias
    return rows.withColumn("alias", F.when((F.col("alias") == "*") | (F.col("to_name") == "*"), "*").otherwise(F.col("alias"))).distinct()


def defaults(lines: DataFrame, defs: DataFrame) -> DataFrame:
    """path, alias, to_path, to_name: what a script's default export is: `export default x`, `module.exports = x`, `exports.a = b`."""
    got = lambda p, k=1: F.regexp_extract("s", p, k)
    script = lines.where("lang = 'typescript'")
    made = rf"^export\s+default\s+(?:async\s+)?(?:abstract\s+)?(?:class\s+|function\s*\*?\s*)?({NAME})"
    given = rf"^module\.exports\s*=\s*({NAME})\s*;?$"
    one = rf"^(?:module\.)?exports\.({NAME})\s*=\s*({NAME})\s*;?$"
    listed = r"^module\.exports\s*=\s*\{([^}]*)\}"
    a = script.where(F.col("s").rlike(made)).select("path", F.lit("default").alias("alias"), F.col("path").alias("to_path"), got(made).alias("to_name"))
    b = script.where(F.col("s").rlike(given)).select("path", F.lit("default").alias("alias"), F.col("path").alias("to_path"), got(given).alias("to_name"))
    c = script.where(F.col("s").rlike(one)).select("path", got(one).alias("alias"), F.col("path").alias("to_path"), got(one, 2).alias("to_name")).where("alias <> to_name")
    d = script.where(F.col("s").rlike(listed)).withColumn("pair", F.explode(_pairs(got(listed), r"\s*:\s*"))).select("path", F.col("pair.target").alias("alias"), F.col("path").alias("to_path"), F.col("pair.alias").alias("to_name")).where("alias <> to_name")
    return a.unionByName(b).unionByName(c).unionByName(d).where("to_name not in ('class', 'function', 'new', 'async')").distinct()


def resolve(wanted: DataFrame, known: DataFrame, bound: DataFrame) -> DataFrame:
    """key, path, name, to_path, to_name: names (path, name; dotted ones by their heads) that bindings lead to known ones (path, name).

    A name that its own file knows is found at once; else its longest bound head is replaced by what that stands for, and `*` passes the
    whole name on, until a known name is met. A pair that was asked for before is left out, so cycles end. A name with several answers has several rows.
    """
    known = known.select("path", "name").distinct()
    todo = cut(wanted.select("path", "name").distinct().select(F.col("path").alias("from_path"), F.col("name").alias("from_name"), "path", "name"), "names-asked")
    seen, found = todo, []
    passed = bound.where("alias = '*'").select("path", F.col("to_path").alias("next_path"))
    plain = bound.where("alias <> '*'").select("path", F.col("alias").alias("head"), "to_path", "to_name")
    for _ in range(DEEPEST):
        met = cut(todo.join(known.withColumn("hit", F.lit(True)), ["path", "name"], "left"), "names-met")
        found.append(met.where("hit").select("from_path", "from_name", F.col("path").alias("to_path"), F.col("name").alias("to_name")))
        rest = met.where("hit is null").drop("hit")
        # every head of a dotted name asks; the longest that is bound counts
        heads = rest.withColumn("parts", F.split("name", r"\.")).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("parts")))).withColumn("head", F.expr("array_join(slice(parts, 1, n), '.')")).withColumn("tail", F.expr("nullif(array_join(slice(parts, n + 1, size(parts)), '.'), '')"))
        hops = heads.join(plain, ["path", "head"])
        longest = hops.groupBy("from_path", "from_name", "path", "name").agg(F.max("n").alias("n"))
        hops = hops.join(longest, ["from_path", "from_name", "path", "name", "n"]).select("from_path", "from_name", F.col("to_path").alias("path"), F.concat_ws(".", "to_name", "tail").alias("name"))
        on = rest.join(passed, "path").select("from_path", "from_name", F.col("next_path").alias("path"), "name")
        fresh = cut(hops.unionByName(on).distinct().join(seen, ["from_path", "from_name", "path", "name"], "left_anti"), "names-asked")
        if fresh.isEmpty():
            break
        seen, todo = seen.unionByName(fresh), fresh
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("from_path").alias("path"), F.col("from_name").alias("name"), "to_path", "to_name").distinct()


# ---- constants

_PART = rf"""({_STRING[1:-1]}|\$?{NAME}(?:(?:\.|::|->){NAME})*(?:\([^()]*\))?|[^\s+.]+)"""


def parts(expression: Column) -> Column:
    """An expression's pieces from left to right, as struct(literal, ref): texts, names, and holes for what is neither.

    Texts with names in them (`f"{a}/x"`, `${a}/x`, "{$a}/x") are read as sums.
    """
    e = F.regexp_replace(F.trim(F.regexp_replace(expression, r";\s*$", "")), r"""(^|[+(,]\s*)[rRbBuU]{1,2}(?=["'])""", "$1")
    python = F.regexp_replace(F.regexp_replace(e, r"""^[fF](["'])(.*)\1$""", r"$1$2$1"), r"\{([A-Za-z_][\w.]*)\}", '" + $1 + "')
    python = F.regexp_replace(F.regexp_replace(python, r"^'", '"'), r"'$", '"')
    script = F.regexp_replace(F.regexp_replace(e, r"\$\{([A-Za-z_$][\w$.]*)\}", '" + $1 + "'), "`", '"')
    script = F.regexp_replace(script, r"\$\{[^}]*\}", '" + (?) + "')
    php = F.regexp_replace(e, r"\{?\$(\w+)\}?", '" + \\$$1 + "')
    sum_ = F.when(e.rlike(r"^[fF][\"']"), python).when(e.rlike("^`"), script).when(e.rlike(r'^"[^"]*\$\w'), php).otherwise(e)
    pieces = F.filter(F.regexp_extract_all(sum_, F.lit(_PART), F.lit(1)), lambda x: ~x.isin("+", ".", "(", ")"))
    literal = lambda x: x.rlike(r"""^["'`]""")
    whole = lambda x: F.regexp_replace(x, r"""^["'`]|["'`]$""", "")
    return F.transform(pieces, lambda x: F.struct(F.when(literal(x), whole(x)).when(x.rlike(rf"^\$?{NAME}(?:(?:\.|::|->){NAME})*$"), F.lit(None)).otherwise(F.lit(HOLE)).alias("literal"), F.when(~literal(x) & x.rlike(rf"^\$?{NAME}(?:(?:\.|::|->){NAME})*$"), F.regexp_replace(F.regexp_replace(x, "::|->", "."), r"^\$", "")).alias("ref")))


ASSIGNED = rf"^(?:export\s+)?(?:(?:public|private|protected|internal|static|final|readonly|const|let|var|val|define)\s+)*(?:[A-Z][\w<>\[\]]*\s+)?\$?({NAME}(?:\.{NAME})?)(?:\s*:\s*[\w.<>\[\]| ]+?)?\s*=\s*(?![=>])(.+?)\s*[;,]?$"


def assignments(lines: DataFrame, defs: DataFrame) -> DataFrame:
    """path, name, line, expression: values given to names of a file or of a class (`Class.NAME`); names within functions aren't seen from outside and are left out."""
    given = lines.where(F.col("s").rlike(ASSIGNED) & F.col("s").rlike(r"""["'`]|=\s*[\w$.]+\s*;?$""")).withColumn("at", F.col("line")).withColumn("level", F.col("indent"))
    given = given.select("path", "lang", F.col("line").alias("start"), F.regexp_extract("s", ASSIGNED, 1).alias("name"), F.lit("").alias("qualified"), "at", "level", F.regexp_extract("s", ASSIGNED, 2).alias("expression"))
    found = defs.select("path", F.col("start").alias("line"), "indent", "kind", F.col("qualified").alias("name"))
    outer = nearest_outer(given, found)
    return outer.where("o_kind is null or o_kind = 'class'").select("path", F.when(F.col("o_kind") == "class", F.concat_ws(".", "o_name", "name")).otherwise(F.col("name")).alias("name"), F.col("start").alias("line"), "expression")


def evaluate(asked: DataFrame, given: DataFrame, bound: DataFrame) -> DataFrame:
    """key, value: every text that expressions (key, path, owner, expression) can have, with `{?}` for what isn't known.

    The state of the fixpoint is the set of values of each name. A name is settled when all its assignments are read, whose names are settled
    before; a sum over names with several values has all their combinations. Names that lead round in a circle never settle; when
    nothing new does, they count as unknown. So values are exact, and the loop ends after as many rounds as constants build on each other.
    """
    sides = given.select(F.concat_ws("\0", F.lit("given"), "path", "name", F.col("line").cast("string")).alias("key"), "path", F.col("name").alias("whole"), F.when(F.col("name").contains("."), F.regexp_replace("name", r"\.[^.]*$", "")).alias("owner"), "expression")
    every = sides.unionByName(asked.select(F.col("key"), "path", F.lit(None).cast("string").alias("whole"), "owner", "expression"))
    pieces = cut(every.select("key", "path", "owner", F.posexplode_outer(parts(F.col("expression"))).alias("pos", "p")).select("key", "path", "owner", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("p.literal", F.when(F.col("p.ref").isNull(), "")).alias("literal"), F.regexp_replace(F.regexp_replace("p.ref", r"^(self|this|static|cls)\.", "\0"), "^\0", "\0").alias("ref")), "constant-parts")
    # self.X and static::X are the owner's X
    pieces = pieces.withColumn("ref", F.when(F.col("ref").startswith("\0"), F.concat_ws(".", "owner", F.expr("substring(ref, 2)"))).otherwise(F.col("ref")))
    known = given.select("path", "name")
    # within a class a name is first the class's own
    own = known.select(F.col("path"), F.col("name").alias("of_class")).distinct()
    pieces = pieces.withColumn("of_class", F.concat_ws(".", "owner", "ref")).join(own.withColumn("is_own", F.lit(True)), ["path", "of_class"], "left").withColumn("ref", F.when(F.col("is_own") & F.col("owner").isNotNull(), F.col("of_class")).otherwise(F.col("ref"))).drop("of_class", "is_own")
    refs = pieces.where("ref is not null")
    led = resolve(refs.select("path", F.col("ref").alias("name")), known, bound)
    links = refs.join(led.withColumnRenamed("name", "ref"), ["path", "ref"], "left").select("key", "pos", F.concat_ws("\0", "to_path", "to_name").alias("target"))
    flat = cut(pieces.join(links, ["key", "pos"], "left").select("key", "pos", F.when(F.col("ref").isNull(), F.col("literal")).when(F.coalesce("target", F.lit("")) == "", F.lit(HOLE)).alias("literal"), F.when(F.col("ref").isNotNull() & (F.coalesce("target", F.lit("")) != ""), F.col("target")).alias("target")), "constant-links")
    names = cut(sides.select("key", F.concat_ws("\0", "path", "whole").alias("target")).distinct(), "constant-names")
    settled = flat.where(F.lit(False)).select(F.col("key").alias("target"), F.col("key").alias("value"))
    done = flat.where(F.lit(False)).select("key", F.col("key").alias("value"))
    circles = False
    for _ in range(10 * DEEPEST):
        ready_names = settled.select("target").distinct()
        left = flat.join(done.select("key").distinct(), "key", "left_anti")
        open_ = left.where("target is not null").join(ready_names, "target", "left_anti").select("key").distinct()
        ready = left if circles else left.join(open_, "key", "left_anti")
        fresh = cut(_sums(ready, settled), "constant-values")
        if fresh.isEmpty():
            if circles or left.isEmpty():
                break
            circles = True  # what is left waits for itself
            continue
        done = done.unionByName(fresh)
        complete = names.join(done.select("key", F.lit(1).alias("is")).distinct(), "key", "left").groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count("is").alias("m")).where("n = m").select("target")
        settled = cut(names.join(complete, "target", "left_semi").join(done, "key").select("target", "value").distinct(), "constants-settled")
    return done.join(asked.select("key").distinct(), "key", "left_semi")


def _sums(flat: DataFrame, settled: DataFrame) -> DataFrame:
    """key, value: the pieces of each key put together, in all combinations of their values; pieces that aren't settled are holes."""
    choices = flat.join(settled, "target", "left").select("key", "pos", F.coalesce("literal", "value", F.lit(HOLE)).alias("v")).groupBy("key", "pos").agg(F.collect_set("v").alias("vs"))
    ordered = choices.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "vs"))).alias("all"))
    combined = F.aggregate("all", F.array(F.lit("")), lambda acc, x: F.array_distinct(F.flatten(F.transform(acc, lambda a: F.transform(x["vs"], lambda v: F.concat(a, v))))))
    return ordered.select("key", F.explode(combined).alias("value"))
