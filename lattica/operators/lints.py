"""Cache keys that leave out what the cached value depends on.

A store of a cache (`cache[key] = value`, `cache.set(key, value)`) has two sides. Each side's names are followed back through the
assignments that reach the store (an as-of join by function and name, to a fixpoint), down to parameters and fields of the object. Where the value
calls methods of the object itself, the fields that these read, and those that they call read, are carried up the calls as well. What the
value depends on and the key doesn't is missing.

Not inputs: objects whose methods are called (a client, a loader), elements that are picked by a part of the key, names that only say what is stored
(`data`, `value` ...), parameters of functions that are setters, and values that are passed through as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.operators import calls as C
from lattica.operators import symbols as S
from lattica.operators.joins import as_of
from lattica.operators.languages import KEYWORDS
from lattica.operators.routing import Tree
from lattica.operators.taint import TEST_PATH, parameters
from lattica.storage import cut

# Names of caches, of stored things and of setters.
CACHE = r"[\w$.>-]*(?:[cC]ache|[mM]emo\w*|lru\w*|LRU\w*)[\w$]*"
STORED = r"^\$?(?:data|response|resp|res|result|value|payload|body|json|item|entry|element|model|obj|object)$"
SETTER = r"^(?:set|put|insert|store|save|cache|add|update|write|remember|record)(?![a-z])"
_NO_NAMES = [*KEYWORDS, "let", "var", "val", "const", "else", "guard", "self", "this", "str", "int", "len", "f", "func", "try", "async", "null", "None", "true", "false"]


def names_of(expression: Column) -> Column:
    """Names that an expression reads: variables, and fields as `self_x`; not what it calls, members of others, labels and texts, but what texts interpolate."""
    e = F.regexp_replace(expression, r"\$\{([^{}]*)\}", "` + ($1) + `")
    e = F.when(e.rlike(r"\bf[\"']"), F.regexp_replace(F.regexp_replace(e, r"\bf([\"'])", "$1"), r"\{([^{}\"']*)\}", '" + ($1) + "')).otherwise(e)
    e = F.regexp_replace(e, r"""("[^"]*"|'[^']*'|`[^`]*`)""", "''")
    e = F.regexp_replace(e, r"\$this\s*->\s*|\b(?:this|self)\s*\.\s*", " self_")
    e = F.regexp_replace(e, r"\bself_\w+(?=\s*(?:\.|->)\s*\w+\s*\()", " ")  # an object that is called is no input
    e = F.regexp_replace(e, r"(?<![\w$])[A-Za-z_$][\w$]*\s*\(", " (")
    e = F.regexp_replace(e, r"(?:\.|->|::)\s*[A-Za-z_$][\w$]*", " ")
    e = F.regexp_replace(e, r"(?<![\w?])[A-Za-z_$][\w$]*\s*:(?!:)", " ")
    found = F.regexp_extract_all(e, F.lit(r"(?<![\w.])(\$?[a-z_][\w$]*)"), F.lit(1))
    return F.array_except(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"^\$", ""))), F.array(*(F.lit(k) for k in _NO_NAMES)))


def _sides(s: str = "s") -> Column:
    """struct(cache, key, value) of a store; null where a statement is none."""
    arg = r"((?:[^,()\[\]\"'`]|\"[^\"]*\"|'[^']*'|`[^`]*`|\((?:[^()]|\([^()]*\))*\)|\[[^\[\]]*\])+)"
    call = rf"({CACHE})\s*(?:\.|->)\s*(?:set|put|store|setItem|setObject|setValue)\s*\(\s*{arg},\s*{arg}"
    index = rf"({CACHE})\s*\[([^\]]+)\]\s*=(?!=)\s*(.+)$"
    pick = lambda p: F.struct(*(F.trim(F.regexp_extract(s, p, k)).alias(n) for k, n in enumerate(("cache", "key", "value"), 1)))
    return F.when(F.col(s).rlike(call), pick(call)).when(F.col(s).rlike(index), pick(index))


def incomplete_cache_keys(sources: DataFrame, tree: Tree | None = None) -> DataFrame:
    """id, file, line, cache, missing, via: inputs of a cached value that its key leaves out; via is value, or call for fields that methods called by it read."""
    tree = tree or Tree.of(sources)
    _, placed = C.sites(tree)
    body = placed.where(F.col("fn").isNotNull() & ~F.col("path").rlike(TEST_PATH))
    stores = body.withColumn("store", _sides()).where("store is not null").select(F.xxhash64("fn", "line").alias("key"), "path", "fn", "line", F.col("store.cache").alias("cache"), F.col("store.key").alias("key_side"), F.regexp_replace("store.value", r";\s*$", "").alias("value_side"))
    stores = cut(stores, "cache-stores")
    given = rf"^(?:(?:const|let|var|val)\s+)?\$?({S.NAME})\s*(?::\s*[\w.<>\[\]| ]+)?\s*=(?![=>])\s*(.+?);?$"
    assigned = cut(body.where(F.col("s").rlike(given)).select("fn", F.regexp_extract("s", given, 1).alias("var"), F.col("line").alias("def_line"), F.regexp_extract("s", given, 2).alias("rhs")), "cache-assignments")
    # a value that is a name without an assignment is passed through
    through = stores.where(F.col("value_side").rlike(rf"^\$?{S.NAME}$")).withColumn("var", F.regexp_replace("value_side", r"^\$", "")).join(assigned.select("fn", "var").distinct(), ["fn", "var"], "left_anti").select("key")
    stores = stores.join(through, "key", "left_anti")
    side = lambda column, label: stores.select("key", "fn", "line", F.lit(label).alias("side"), F.explode(names_of(F.col(column))).alias("var"))
    state = cut(side("key_side", "key").unionByName(side("value_side", "value")).distinct(), "cache-names")
    seen = state
    touched = [stores.select("key", "fn", "line")]
    leaves = None
    for _ in range(S.DEEPEST):
        asked = state.withColumn("slot", F.concat_ws("\0", "fn", "var")).withColumn("until", F.col("line") - 1)
        met = cut(as_of(asked, assigned.select(F.concat_ws("\0", "fn", "var").alias("slot"), "def_line", "rhs"), "slot", "until", "def_line", ["def_line", "rhs"]).drop("slot", "until"), "cache-reached")
        ends = met.where("def_line is null").select("key", "fn", "side", "var")
        leaves = ends if leaves is None else leaves.unionByName(ends)
        onward = met.where("def_line is not null").select("key", "fn", "side", F.col("def_line").alias("line"), F.explode(names_of(F.col("rhs"))).alias("var"))
        touched.append(met.where("def_line is not null and side = 'value'").select("key", "fn", F.col("def_line").alias("line")))
        state = cut(onward.distinct().join(seen, ["key", "fn", "side", "line", "var"], "left_anti"), "cache-names")
        if state.isEmpty():
            break
        seen = seen.unionByName(state)
    # fields that methods of the object read, carried up its calls
    edges = cut(C.resolved(tree).where(F.col("how").isin("self", "base")).select("src", "dst", "line").distinct(), "self-calls")
    reads = cut(body.where(F.col("owner").isNotNull()).select("fn", F.explode(names_of(F.col("s"))).alias("var")).where(F.col("var").startswith("self_")).distinct(), "field-reads")
    carried, fresh = reads, reads
    for _ in range(S.DEEPEST):
        fresh = cut(edges.select(F.col("src").alias("up"), F.col("dst").alias("fn")).distinct().join(fresh, "fn").select(F.col("up").alias("fn"), "var").distinct().join(carried, ["fn", "var"], "left_anti"), "field-reads")
        if fresh.isEmpty():
            break
        carried = carried.unionByName(fresh)
    spots = touched[0]
    for more in touched[1:]:
        spots = spots.unionByName(more)
    of_calls = spots.distinct().join(edges, (F.col("fn") == F.col("src")) & (spots["line"] == edges["line"])).select("key", F.col("dst").alias("callee")).distinct()
    by_call = of_calls.join(carried.withColumnRenamed("fn", "callee"), "callee").select("key", "var").distinct()
    leaves = cut(leaves.distinct(), "cache-leaves")
    params = parameters(tree).select("fn", F.col("name").alias("var"), F.lit(True).alias("is_param")).distinct()
    setter = F.regexp_extract("fn", r"([^.#]+)$", 1).rlike(SETTER)
    values = leaves.where("side = 'value'").join(params, ["fn", "var"], "left").where(F.col("var").startswith("self_") | (F.col("is_param") & ~setter & ~F.col("var").rlike(STORED))).select("key", "var", F.lit("value").alias("via"))
    inputs = values.unionByName(by_call.join(values.select("key", "var"), ["key", "var"], "left_anti").withColumn("via", F.lit("call")))
    keys = leaves.where("side = 'key'").select("key", F.regexp_replace("var", "^self_", "").alias("bare")).distinct()
    missing = inputs.withColumn("bare", F.regexp_replace("var", "^self_", "")).join(keys, ["key", "bare"], "left_anti")
    # elements that a part of the key picks
    picked = r"(\w+)\s*(?:\[\s*\$?(\w+)\s*\]|\??\.\s*(?:get\w*|elementAt\w*|at|item)\s*\(\s*(\w+)\b)"
    picks = body.where(F.col("s").rlike(picked)).withColumn("one", F.explode(F.regexp_extract_all("s", F.lit(f"({picked})"), F.lit(1)))).select("fn", F.regexp_extract("one", picked, 1).alias("bare"), F.when(F.regexp_extract("one", picked, 2) != "", F.regexp_extract("one", picked, 2)).otherwise(F.regexp_extract("one", picked, 3)).alias("by"))
    by_key = stores.select("key", "fn").join(picks, "fn").join(keys.withColumnRenamed("bare", "by"), ["key", "by"]).select("key", "bare").distinct()
    found = missing.join(by_key, ["key", "bare"], "left_anti").join(keys.select("key").distinct(), "key", "left_semi")
    return found.join(stores, "key").select(F.col("fn").alias("id"), F.col("path").alias("file"), "line", "cache", F.regexp_replace("var", "^self_", "self.").alias("missing"), "via").distinct()


# Names of fields that guard programmatic writes, and values that lift a guard.
ECHO_GUARD = r"(?i)^(?:last(?:written|sent|saved|synced|applied|pushed|emitted|published|local)\w*|isupdating(?:from|programmatic|internal|selection|text|value)\w*|is(?:applying|programmatic|syncing|internal|setting|restoring)\w*|(?:suppress|ignorenext|skipnext|mutenext|ignoring|suppressing)\w*)$"
LIFTED = r"=\s*(?:false|False|nil|None|null|undefined|0)\s*;?$"
_EARLY = r"\b(?:return|continue|break)\b"
_FIELD = r"(?:\bself\.|\bthis\.|\$this->)"
#: Lines between a guard's set and the write that it covers.
NEAR = 4


def _fields(rows: DataFrame, pattern: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit(pattern), F.lit(1)))))


def unguarded_echoes(sources: DataFrame, tree: Tree | None = None) -> DataFrame:
    """guard, state, id, file, line: asynchronous writes of a class's state that reach its observer without the guard that other writes set.

    A guard is a field that some method checks to leave early (the observer) and that others set close to a write of the
    state. A write elsewhere is asynchronous where its method is, waits before it, or is a callback. It is covered where on every
    path to it a caller set the guard before: uncovered are the methods that can be reached from one without callers over calls that no set precedes (what holds on
    all paths is what no such path breaks).
    """
    tree = tree or Tree.of(sources)
    _, placed = C.sites(tree)
    body = cut(placed.where(F.col("fn").isNotNull() & F.col("owner").isNotNull() & ~F.col("path").rlike(TEST_PATH)).select("path", "fn", "owner", "line", "s"), "echo-lines")
    is_guard = lambda c: F.regexp_replace(c, "_", "").rlike(ECHO_GUARD)
    nxt = F.lead("s").over(Window.partitionBy("fn").orderBy("line"))
    checks = _fields(body.withColumn("after", nxt).where(F.col("s").rlike(r"\b(?:if|guard|unless|when)\b") & (F.col("s").rlike(_EARLY) | F.col("after").rlike(_EARLY))), rf"{_FIELD}(\w+)", "guard").where(is_guard("guard")).select("path", "owner", "guard", "fn").distinct()
    written = cut(_fields(body, rf"{_FIELD}(\w+)\s*=(?!=)", "field"), "echo-writes")
    sets = cut(written.where(is_guard("field") & ~F.col("s").rlike(LIFTED)).select("path", "owner", F.col("field").alias("guard"), "fn", F.col("line").alias("set_line")).join(checks.select("path", "owner", "guard").distinct(), ["path", "owner", "guard"], "left_semi"), "echo-sets")
    state = written.where(~is_guard("field")).select("path", "owner", F.col("field").alias("state"), "fn", "line")
    guarded = sets.join(state, ["path", "owner", "fn"]).where(F.abs(F.col("line") - F.col("set_line")) <= NEAR).select("path", "owner", "guard", "state").distinct()
    # calls among a class's methods, and for each guard the methods that a call without it reaches
    edges = C.resolved(tree).where(F.col("how").isin("self", "base")).select("src", "dst", "line").distinct()
    guards = guarded.select("path", "owner", "guard").distinct()
    methods = tree.defs.where("kind = 'function' and owner is not null").select("path", "owner", "id").join(guards, ["path", "owner"])
    first = sets.groupBy("guard", "fn").agg(F.min("set_line").alias("set_line"))
    within = cut(edges.join(methods.select(F.col("id").alias("src"), "guard"), "src").join(first.withColumnRenamed("fn", "src"), ["src", "guard"], "left"), "echo-calls")
    open_calls = within.where("set_line is null or set_line > line").select("guard", "src", "dst").distinct()
    reached = cut(methods.select("guard", "id").join(within.select("guard", F.col("dst").alias("id")).distinct(), ["guard", "id"], "left_anti"), "echo-open")
    fresh = reached
    for _ in range(S.DEEPEST):
        fresh = cut(fresh.join(open_calls, (fresh["id"] == open_calls["src"]) & (fresh["guard"] == open_calls["guard"])).select(open_calls["guard"], F.col("dst").alias("id")).distinct().join(reached, ["guard", "id"], "left_anti"), "echo-open")
        if fresh.isEmpty():
            break
        reached = reached.unionByName(fresh)
    heads = tree.lines.join(tree.defs.where("kind = 'function'").select("path", F.col("start").alias("line"), F.col("id").alias("fn")), ["path", "line"]).select("fn", F.col("s").rlike(r"\basync\b|\bsuspend\b").alias("is_async"))
    waits = body.where(F.col("s").rlike(r"\bawait\b|\.then\(|\b(?:setTimeout|setInterval|requestAnimationFrame)\(|\b(?:addListener|addEventListener|subscribe|on[A-Z]\w*)\(")).groupBy("fn").agg(F.min("line").alias("waits"))
    late = state.join(guarded, ["path", "owner", "state"]).join(heads, "fn").join(waits, "fn", "left").where("is_async or waits <= line")
    others = late.join(sets.select("guard", "fn").distinct(), ["guard", "fn"], "left_anti").join(checks.select("guard", "fn").distinct(), ["guard", "fn"], "left_anti")
    return others.join(reached.withColumnRenamed("id", "fn"), ["guard", "fn"], "left_semi").select("guard", "state", F.col("fn").alias("id"), F.col("path").alias("file"), "line").distinct()
