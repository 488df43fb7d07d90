"""Served paths of routes: prefixes of routers, blueprints, groups, includes, modules and controllers put together.

A framework's text gives three kinds of rows. A scope is what routes are written in: an application, a router, a
file of url patterns, a group of routes, a controller, with the prefix it has by itself. A mount puts an inner
scope into an outer one under a prefix. A route is a verb and path in a scope. `compose` then walks the mounts down
from the scopes that nothing mounts; its state is (scope, prefix so far), so a scope that is mounted twice has both
prefixes, and the scopes passed go along, so a circle of mounts ends and adds nothing.

Prefixes and paths are expressions: constants, also of other files, and sums are evaluated (`symbols.evaluate`), and each value is a path;
`{?}` stands for what isn't known. Routers, views and included files are found through imports (`symbols.resolve`).

Read are Django (with DRF routers), FastAPI, Flask, Express and its kind, NestJS and Laravel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.operators import symbols as S
from lattica.operators.joins import as_of
from lattica.storage import cut

VERBS = ["get", "post", "put", "patch", "delete", "head", "options"]
_VERB = "|".join(VERBS)
_E = r"""((?:[rfbRFB]*(?:"[^"]*"|'[^']*')|`[^`]*`|[A-Za-z_$][\w$.:]*)(?:\s*[+.]\s*(?:[rfbRFB]*(?:"[^"]*"|'[^']*')|`[^`]*`|[A-Za-z_$][\w$.:]*))*)"""
N = S.NAME

SCOPES = "scope string, framework string, path string, owner string, expression string, app boolean"
MOUNTS = "outer string, inner string, path string, owner string, expression string, replaces boolean"
ROUTES = "scope string, framework string, verb string, path string, owner string, line int, expression string, handler string"


@dataclass
class Layout:
    """scopes, mounts and routes of a tree, by all frameworks."""

    scopes: DataFrame
    mounts: DataFrame
    routes: DataFrame

    def __add__(self, other: Layout) -> Layout:
        return Layout(self.scopes.unionByName(other.scopes), self.mounts.unionByName(other.mounts), self.routes.unionByName(other.routes))


@dataclass
class Tree:
    """A source tree's statements, definitions and bindings, read once."""

    sources: DataFrame
    lines: DataFrame
    defs: DataFrame
    bound: DataFrame

    @classmethod
    def of(cls, sources: DataFrame) -> Tree:
        lines = cut(S.statements(sources), "statements")
        defs = cut(S.definitions(sources), "definitions")
        return cls(sources, lines, defs, cut(S.bindings(lines, sources).unionByName(S.defaults(lines, defs)), "bindings"))


def _got(pattern: str, k: int = 1, c: str = "s") -> Column:
    return F.regexp_extract(c, pattern, k)


def _key(path: str | Column, name: str | Column) -> Column:
    return F.concat_ws("\0", path, name)


def _shape(df: DataFrame, schema: str, **columns: Column | str | None) -> DataFrame:
    fields = [f.split(" ") for f in schema.split(", ")]
    return df.select(*((F.col(columns[n]) if isinstance(columns.get(n), str) else columns[n] if columns.get(n) is not None else F.lit(None)).cast(t).alias(n) for n, t in fields))


def _some(expression: Column) -> Column:
    """An expression, or the empty text where there is none."""
    return F.when(expression == "", F.lit('""')).otherwise(expression)


def _leads(tree: Tree, known: DataFrame, *asked: tuple[DataFrame, str]) -> DataFrame:
    """path, name, scope_of: the keys of the known scopes (path, name) that the names in columns of frames lead to, through imports and default exports; all in one walk."""
    names = None
    for df, column in asked:
        own = df.select("path", F.col(column).alias("name"))
        names = own if names is None else names.unionByName(own)
    return cut(S.resolve(names, known, tree.bound).select("path", "name", _key("to_path", "to_name").alias("scope_of")), "scope-names")


def _named(led: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """rows (path, ...) with scope_of, the scope that the name in `column` leads to; rows without one fall away."""
    return rows.join(led.withColumnRenamed("name", column), ["path", column])


def _following(tree: Tree, rows: DataFrame, kind: str) -> DataFrame:
    """rows (path, line) with qualified, owner of the next definition of a kind behind them, which a decorator stands before."""
    return as_of(rows, tree.defs.where(F.col("kind") == kind).select("path", "start", F.col("qualified"), F.col("owner").alias("of")), "path", "line", "start", ["qualified", "of"], direction="forward")


def python_web(tree: Tree) -> Layout:
    """FastAPI and Flask: routers and blueprints by name, `include_router`, `register_blueprint`, `mount`, decorators. A blueprint's prefix is replaced by that of its registration."""
    lines = tree.lines.where("lang = 'python'")
    made = rf"^({N})\s*(?::\s*\w+\s*)?=\s*(?:[\w.]+\.)?(FastAPI|APIRouter|Flask|Blueprint|Starlette)\((.*)\)$"
    own = lines.where(F.col("s").rlike(made)).withColumn("name", _got(made)).withColumn("what", _got(made, 2)).withColumn("given", _got(rf"\b(?:url_)?prefix\s*=\s*{_E}"))
    framework = F.when(F.col("what").isin("Flask", "Blueprint"), "flask").otherwise("fastapi")
    scopes = _shape(own, SCOPES, scope=_key("path", "name"), framework=framework, path="path", expression=_some(F.col("given")), app=F.col("what").isin("FastAPI", "Flask", "Starlette"))
    known = own.select("path", "name")
    put = rf"^({S.DOTTED})\.(include_router|register_blueprint|mount)\(\s*(.*)\)$"
    calls = lines.where(F.col("s").rlike(put)).withColumn("outer_name", _got(put)).withColumn("how", _got(put, 2)).withColumn("args", _got(put, 3))
    calls = calls.withColumn("inner_name", F.when(F.col("how") == "mount", _got(rf",\s*(?:app\s*=\s*)?({S.DOTTED})", c="args")).otherwise(_got(rf"^(?:router\s*=\s*|blueprint\s*=\s*)?({S.DOTTED})", c="args")))
    calls = calls.withColumn("given", F.when(F.col("how") == "mount", _got(rf"^{_E}", c="args")).otherwise(_got(rf"\b(?:url_)?prefix\s*=\s*{_E}", c="args")))
    deco = rf"^@({S.DOTTED})\.({_VERB}|route|websocket|api_route)\(\s*(?:path\s*=\s*|rule\s*=\s*)?{_E}(.*)\)$"
    decorated = lines.where(F.col("s").rlike(deco)).withColumn("name", _got(deco))
    led = _leads(tree, known, (calls, "outer_name"), (calls, "inner_name"), (decorated, "name"))
    met = _named(led, calls.select("path", "outer_name", "inner_name", "how", "given"), "outer_name").withColumnRenamed("scope_of", "outer")
    met = _named(led, met, "inner_name").withColumnRenamed("scope_of", "inner")
    mounts = _shape(met, MOUNTS, outer="outer", inner="inner", path="path", expression=_some(F.col("given")), replaces=(F.col("how") == "register_blueprint") & (F.col("given") != ""))
    found = _following(tree, decorated, "function")
    found = _named(led, found.withColumn("verb", F.upper(_got(deco, 2))).withColumn("expression", _got(deco, 3)).withColumn("rest", _got(deco, 4)), "name")
    listed = F.transform(F.regexp_extract_all("rest", F.lit(r"""["'](GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)["']""")), lambda x: x)
    verbs = F.when(~F.col("verb").isin("ROUTE", "API_ROUTE", "WEBSOCKET"), F.array("verb")).when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("GET")))
    found = found.withColumn("one", F.explode(verbs))
    own_framework = found.join(scopes.select(F.col("scope").alias("scope_of"), F.col("framework").alias("fw")).distinct(), "scope_of")
    return Layout(scopes, mounts, _shape(own_framework, ROUTES, scope="scope_of", framework="fw", verb="one", path="path", line="line", expression="expression", handler="qualified"))


def django(tree: Tree) -> Layout:
    """Lists of `path` and `re_path`, nested by `include` of modules, lists and routers; `router.register` of DRF. Roots are lists that nothing includes."""
    lines = tree.lines.where("lang = 'python'")
    patterns = rf"^({N})\s*(?::\s*[\w\[\].]+\s*)?\+?=\s*(?:\w+\()?\[?.*\b(?:re_)?(?:path|url)\("
    routers = rf"^({N})\s*=\s*(?:[\w.]+\.)?(?:DefaultRouter|SimpleRouter|Router|NestedSimpleRouter)\("
    lists = lines.where(F.col("s").rlike(patterns) & F.col("s").rlike(r"^\w+\s*(?::[^=]+)?\+?=\s*(?:\w+\()?\[")).withColumn("name", _got(patterns))
    made = lines.where(F.col("s").rlike(routers)).withColumn("name", _got(routers))
    known = lists.select("path", "name").unionByName(made.select("path", "name")).distinct()
    scopes = _shape(known, SCOPES, scope=_key("path", "name"), framework=F.lit("django"), path="path", expression=F.lit('""'), app=F.col("name") == "urlpatterns")
    item = rf"""\b((?:re_)?(?:path|url))\(\s*{_E}\s*,\s*(include\(\s*\(?\s*(?:"[^"]*"|'[^']*'|[\w.]+)|[\w.]+)"""
    each = lists.select("path", "line", F.col("name").alias("scope_name"), F.explode(F.regexp_extract_all("s", F.lit(f"({item})"), F.lit(1))).alias("s"))
    each = each.select("path", "line", "scope_name", _got(item).alias("how"), _got(item, 2).alias("given"), _got(item, 3).alias("target"))
    # ^ and $ of a pattern say nothing of the path; named groups are its holes
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("given", r"\^|\$|\\Z|\\A", ""), r"\(\?P<(\w+)>(?:[^()]|\([^()]*\))*\)", r"{$1}"), "^r", "")
    each = each.withColumn("expression", F.when(F.col("how") == "path", F.col("given")).otherwise(plain))
    inside = each.where(F.col("target").startswith("include("))
    text = _got(r"""^include\(\s*\(?\s*["']([^"']+)["']""", c="target")
    files = tree.sources.where(S.language(F.col("path")) == "python").select(F.explode(S.python_modules(F.col("path"))).alias("module"), F.col("path").alias("to_path"))
    by_module = inside.withColumn("module", text).where("module <> ''").join(files, "module").withColumn("inner", _key("to_path", F.lit("urlpatterns")))
    bare = _got(r"^include\(\s*\(?\s*([\w.]+)$", c="target")
    # a name is a list, a router's `urls`, or an imported module whose list is meant
    wanted = inside.where(bare != "").withColumn("name", F.explode(F.array(F.regexp_replace(bare, r"\.urls$", ""), F.concat(bare, F.lit(".urlpatterns")))))
    register = rf"^({N})\.register\(\s*{_E}\s*,\s*({S.DOTTED})"
    sets = lines.where(F.col("s").rlike(register)).withColumn("name", _got(register)).withColumn("given", _got(register, 2)).withColumn("handler", _got(register, 3))
    led = _leads(tree, known, (wanted, "name"), (sets, "name"))
    by_name = _named(led, wanted, "name").withColumnRenamed("scope_of", "inner")
    columns = ["path", "scope_name", "expression", "inner"]
    included = by_module.select(*columns).unionByName(by_name.select(*columns)).distinct()
    mounts = _shape(included, MOUNTS, outer=_key("path", "scope_name"), inner="inner", path="path", expression="expression", replaces=F.lit(False))
    views = each.where(~F.col("target").startswith("include(")).withColumn("handler", F.regexp_replace("target", r"\.as_view$", ""))
    plain_routes = _shape(views, ROUTES, scope=_key("path", "scope_name"), framework=F.lit("django"), verb=F.lit("ANY"), path="path", line="line", expression="expression", handler="handler")
    verbs = F.explode(F.array(*(F.struct(F.lit(v).alias("verb"), F.lit(tail).alias("tail"), F.lit(action).alias("action")) for v, tail, action in (("GET", "", "list"), ("POST", "", "create"), ("GET", "/{pk}", "retrieve"), ("PUT", "/{pk}", "update"), ("PATCH", "/{pk}", "partial_update"), ("DELETE", "/{pk}", "destroy")))))
    sets = _named(led, sets, "name").withColumn("v", verbs)
    expression = F.when(F.col("v.tail") == "", F.col("given")).otherwise(F.concat("given", F.lit(' + "'), "v.tail", F.lit('"')))
    drf = _shape(sets, ROUTES, scope="scope_of", framework=F.lit("drf"), verb=F.col("v.verb"), path="path", line="line", expression=expression, handler=F.concat_ws(".", "handler", "v.action"))
    return Layout(scopes, mounts, plain_routes.unionByName(drf))


def express(tree: Tree) -> Layout:
    """Express, Koa routers, Hono and the like: factories by name, `use` and `route` with a prefix, routers of other files by `require` and `import`, `route(p).get(..).post(..)`."""
    lines = tree.lines.where("lang = 'typescript'")
    made = rf"^(?:export\s+)?(?:const|let|var)\s+({N})\s*(?::\s*[\w.<>]+\s*)?=\s*(?:new\s+)?(express|Express|(?:\w+\.)?Router|fastify|Fastify|Koa|Hono)\((.*)\)"
    own = lines.where(F.col("s").rlike(made)).withColumn("name", _got(made)).withColumn("what", _got(made, 2)).withColumn("given", _got(rf"\bprefix\s*:\s*{_E}"))
    scopes = _shape(own, SCOPES, scope=_key("path", "name"), framework=F.lit("express"), path="path", expression=_some(F.col("given")), app=~F.col("what").rlike("Router$"))
    known = own.select("path", "name")
    put = rf"^({N})\.(?:use|route)\(\s*(.+)\)\s*;?$"
    required = r"""require\(\s*["']([^"']+)["']\s*\)"""
    calls = lines.where(F.col("s").rlike(put) & ~F.col("s").rlike(rf"\)\s*\.(?:{_VERB}|all)\(")).withColumn("outer_name", _got(put)).withColumn("args", F.regexp_replace(_got(put, 2), r"\.(?:routes|middleware)\(\)\s*$", ""))
    calls = calls.withColumn("given", F.when(F.col("args").rlike(r"^[^,]+,"), _got(rf"^{_E}\s*,", c="args")).otherwise(F.lit("")))
    last = F.element_at(F.split("args", r",\s*(?![^(\[{]*[)\]}])"), -1)
    inline = calls.where(last.rlike(rf"^{required}$")).withColumn("module", S._module(S._folded(F.concat(_got(r"^(.*/)?[^/]+$", c="path"), F.regexp_extract(last, required, 1)))))
    named = calls.where(last.rlike(rf"^{S.DOTTED}$")).withColumn("inner_name", last)
    files = tree.sources.where(S.language(F.col("path")) == "typescript").select(S._module(F.col("path")).alias("module"), F.col("path").alias("its_path"))
    of_file = inline.join(files, "module").select(F.col("path").alias("from"), "outer_name", "given", F.col("its_path").alias("path"), F.lit("default").alias("inner_name"))
    call = rf"^({N})\.({_VERB}|all|del)\(\s*{_E}\s*,\s*(.*)$"
    plain = lines.where(F.col("s").rlike(call)).withColumn("name", _got(call)).withColumn("verb", _got(call, 2)).withColumn("expression", _got(call, 3)).withColumn("handler", _got(rf"({S.DOTTED})\s*\)\s*;?$", c="s"))
    chained = rf"^({N})\.route\(\s*{_E}\s*\)((?:\s*\.(?:{_VERB}|all)\(.*)+)$"
    several = lines.where(F.col("s").rlike(chained)).withColumn("name", _got(chained)).withColumn("expression", _got(chained, 2)).withColumn("one", F.explode(F.regexp_extract_all(_got(chained, 3), F.lit(rf"(\.(?:{_VERB}|all)\([^()]*)"), F.lit(1))))
    several = several.withColumn("verb", _got(r"^\.(\w+)", c="one")).withColumn("handler", _got(rf"({S.DOTTED})\s*$", c="one"))
    columns = ["path", "line", "name", "verb", "expression", "handler"]
    direct = plain.select(*columns).unionByName(several.select(*columns))
    led = _leads(tree, known, (named, "inner_name"), (of_file, "inner_name"), (calls, "outer_name"), (direct, "name"))
    by_name = _named(led, named, "inner_name").withColumnRenamed("scope_of", "inner")
    by_file = _named(led, of_file, "inner_name").withColumnRenamed("scope_of", "inner").drop("path").withColumnRenamed("from", "path")
    both = _named(led, by_name.select("path", "outer_name", "given", "inner").unionByName(by_file.select("path", "outer_name", "given", "inner")), "outer_name").where("scope_of <> inner")
    mounts = _shape(both, MOUNTS, outer="scope_of", inner="inner", path="path", expression=_some(F.col("given")), replaces=F.lit(False))
    found = _named(led, direct, "name")
    verb = F.when(F.col("verb") == "all", "ANY").when(F.col("verb") == "del", "DELETE").otherwise(F.upper("verb"))
    return Layout(scopes, mounts, _shape(found, ROUTES, scope="scope_of", framework=F.lit("express"), verb=verb, path="path", line="line", expression="expression", handler=F.when(F.col("handler") != "", F.col("handler"))))


def nest(tree: Tree) -> Layout:
    """NestJS: controllers with their prefix, methods' decorators, the global prefix, and paths of modules by nested `RouterModule.register`."""
    lines = tree.lines.where("lang = 'typescript'")
    deco = rf"""^@Controller\(\s*(?:\{{.*\bpath\s*:\s*)?{_E}?"""
    own = _following(tree, lines.where(F.col("s").rlike(r"^@Controller\(")).withColumn("given", _got(deco)), "class").where("qualified is not null")
    root = F.lit("nest\0app")
    controllers = _shape(own, SCOPES, scope=_key("path", "qualified"), framework=F.lit("nestjs"), path="path", expression=_some(F.col("given")), app=F.lit(False))
    prefix = rf"\.setGlobalPrefix\(\s*{_E}"
    apps = lines.where(F.col("s").rlike(prefix)).select("path", _got(prefix).alias("given"))
    app = _shape(apps, SCOPES, scope=root, framework=F.lit("nestjs"), path="path", expression="given", app=F.lit(True))
    bare = _shape(own.select(F.lit("").alias("path")).distinct(), SCOPES, scope=root, framework=F.lit("nestjs"), path="path", expression=F.lit('""'), app=F.lit(True)).join(app.select("scope").distinct(), "scope", "left_anti")
    module = _following(tree, lines.where(F.col("s").rlike(r"^@Module\(")), "class").where("qualified is not null")
    held = module.withColumn("name", F.explode(F.split(F.regexp_replace(_got(r"\bcontrollers\s*:\s*\[([^\]]*)\]"), r"\s", ""), ","))).where("name <> ''").select("path", F.col("qualified").alias("module"), "name")
    known = own.select("path", F.col("qualified").alias("name")).distinct()
    inside = _named(_leads(tree, known, (held, "name")), held, "name").select(_key("path", "module").alias("module"), F.col("scope_of").alias("inner"), "path")
    # the nested objects of RouterModule.register: tokens in order, an object for each opening brace
    token = rf"(\bpath\s*:\s*{_E}|\bmodule\s*:\s*{N}|[{{}}])"
    tokens = lines.where(F.col("s").rlike(r"\bRouterModule\.register\(")).select("path", "line", F.posexplode(F.regexp_extract_all("s", F.lit(token), F.lit(1))).alias("pos", "t"))
    order = Window.partitionBy("path", "line").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deep = tokens.withColumn("depth", F.sum(F.when(F.col("t") == "{", 1).when(F.col("t") == "}", -1).otherwise(0)).over(order))
    opened = deep.where("t = '{'").select(F.concat_ws("\0", "path", F.col("line").cast("string"), F.col("depth").cast("string")).alias("key"), F.col("pos").alias("object"))
    asks = deep.where("t <> '}'").withColumn("key", F.concat_ws("\0", "path", F.col("line").cast("string"), F.col("depth").cast("string")))
    parents = as_of(deep.where("t = '{' and depth > 1").withColumn("key", F.concat_ws("\0", "path", F.col("line").cast("string"), (F.col("depth") - 1).cast("string"))), opened, "key", "pos", "object", ["object"]).select("path", "line", F.col("pos").alias("object"), F.col("object").alias("parent"))
    fields = as_of(asks.where("t <> '{'"), opened, "key", "pos", "object", ["object"])
    objects = fields.groupBy("path", "line", "object").agg(F.max(F.when(F.col("t").startswith("path"), F.regexp_extract("t", rf"^path\s*:\s*{_E}", 1))).alias("given"), F.max(F.when(F.col("t").startswith("module"), F.regexp_extract("t", rf"({N})$", 1))).alias("module"))
    objects = objects.join(parents.join(objects.select("path", "line", F.col("object").alias("parent")), ["path", "line", "parent"], "left_semi"), ["path", "line", "object"], "left")  # the object around the call itself is no parent
    at = lambda o: F.concat_ws("\0", "path", F.lit("routes"), F.col("line").cast("string"), F.col(o).cast("string"))
    nested = _shape(objects, SCOPES, scope=at("object"), framework=F.lit("nestjs"), path="path", expression=F.lit('""'), app=F.lit(False))
    down = _shape(objects, MOUNTS, outer=F.when(F.col("parent").isNull(), root).otherwise(at("parent")), inner=at("object"), path="path", expression=_some(F.coalesce("given", F.lit(""))), replaces=F.lit(False))
    modules = module.select("path", F.col("qualified").alias("name")).distinct()
    with_module = objects.where("module is not null").withColumn("scope", at("object"))
    placed = _named(_leads(tree, modules, (with_module, "module")), with_module, "module").select("path", "scope", F.col("scope_of").alias("module"))
    of_modules = placed.select("path", "scope", "module").join(inside.select("module", "inner"), "module")
    put = _shape(of_modules, MOUNTS, outer="scope", inner="inner", path="path", expression=F.lit('""'), replaces=F.lit(False))
    free = controllers.select(F.col("scope").alias("inner"), "path").distinct().join(put.select("inner").distinct(), "inner", "left_anti")
    top = _shape(free, MOUNTS, outer=root, inner="inner", path="path", expression=F.lit('""'), replaces=F.lit(False))
    method = rf"^@(Get|Post|Put|Patch|Delete|Head|Options|All)\(\s*{_E}?"
    routes = _following(tree, lines.where(F.col("s").rlike(method)), "function").where("of is not null")
    routes = routes.join(known.select("path", F.col("name").alias("of")), ["path", "of"])
    verb = F.when(_got(method) == "All", "ANY").otherwise(F.upper(_got(method)))
    found = _shape(routes, ROUTES, scope=_key("path", "of"), framework=F.lit("nestjs"), verb=verb, path="path", line="line", owner="of", expression=_some(_got(method, 2)), handler="qualified")
    return Layout(controllers.unionByName(app).unionByName(bare).unionByName(nested), down.unionByName(put).unionByName(top), found)


def laravel(tree: Tree) -> Layout:
    """Laravel: `Route::` calls within nested groups, groups that load another file, `apiPrefix`, resources. `routes/api.php` is served below `api` unless something mounts it."""
    lines = tree.lines.where("lang = 'php'")
    e = r"""((?:"[^"]*"|'[^']*'|[A-Za-z_$][\w$:]*)(?:\s*\.\s*(?:"[^"]*"|'[^']*'|[A-Za-z_$][\w$:]*))*)"""
    prefix = F.coalesce(F.expr("nullif(p1, '')"), F.expr("nullif(p2, '')"), F.lit('""'))
    calls = lines.where(F.col("s").rlike(r"\bRoute::")).withColumn("p1", _got(rf"(?:::|->)prefix\(\s*{e}\s*\)")).withColumn("p2", _got(rf"""["']prefix["']\s*=>\s*{e}""")).withColumn("prefix", prefix)
    opens = F.col("s").rlike(r"(?:->|::)group\(.*\bfunction\b.*\{\s*$|(?:->|::)group\(.*=>\s*\{\s*$")
    groups = calls.where(opens)
    asked = calls.withColumn("level", F.explode(F.sequence(F.lit(0), F.greatest(F.col("depth") - 1, F.lit(0))))).where("level < depth").withColumn("key", F.concat_ws("\0", "path", F.col("level").cast("string"))).withColumn("until", F.col("line") - 1)
    every = lines.join(groups.select("path", "line", F.lit(True).alias("group")), ["path", "line"], "left").select(F.concat_ws("\0", "path", F.col("depth").cast("string")).alias("key"), F.col("line").alias("o_line"), "group")
    around = as_of(asked, every, "key", "until", "o_line", ["o_line", "group"]).where("group").groupBy("path", "line").agg(F.max(F.struct("level", "o_line"))["o_line"].alias("outer_line"))
    at = lambda c: F.concat_ws("\0", "path", F.lit("group"), F.col(c).cast("string"))
    whole = _key("path", F.lit("file"))
    scope_of = F.when(F.col("outer_line").isNull(), whole).otherwise(at("outer_line"))
    files = calls.select("path").distinct()
    loads = r"""(?:->|::)group\(\s*(?:base_path\(\s*["']([^"']+)["']|__DIR__\s*\.\s*["']/?(?:\.\./)?([^"']+)["'])"""
    placed = calls.join(around, ["path", "line"], "left")
    loaded = placed.where(F.col("s").rlike(loads)).withColumn("file", F.concat(_got(loads), _got(loads, 2)))
    with_routing = lines.where(F.col("s").rlike(r"withRouting\(")).withColumn("api_prefix", F.coalesce(F.expr(r"""nullif(regexp_extract(s, 'apiPrefix\\s*:\\s*("[^"]*"|\'[^\']*\')', 1), '')"""), F.lit('"api"'))).withColumn("file", _got(r"""\bapi\s*:\s*__DIR__\s*\.\s*["']/?(?:\.\./)?([^"']+)["']"""))
    tail = lambda c: F.regexp_extract(c, r"([^/]+/[^/]+)$", 1)
    target = files.select(F.col("path").alias("to_path"), tail("path").alias("tail"))
    by_group = loaded.withColumn("tail", tail("file")).join(target, "tail").select("path", scope_of.alias("outer"), _key("to_path", F.lit("file")).alias("inner"), F.col("prefix").alias("expression"))
    by_boot = with_routing.withColumn("tail", tail("file")).join(target, "tail").select("path", F.lit("laravel\0app").alias("outer"), _key("to_path", F.lit("file")).alias("inner"), F.col("api_prefix").alias("expression"))
    mounted = by_group.unionByName(by_boot)
    usual = files.where(F.col("path").rlike(r"(^|/)routes/api\.php$")).withColumn("inner", whole).join(mounted.select("inner").distinct(), "inner", "left_anti").select("path", F.lit("laravel\0app").alias("outer"), "inner", F.lit('"api"').alias("expression"))
    nested = placed.where(opens).select("path", scope_of.alias("outer"), at("line").alias("inner"), F.col("prefix").alias("expression"))
    mounts = _shape(mounted.unionByName(usual).unionByName(nested), MOUNTS, outer="outer", inner="inner", path="path", expression="expression", replaces=F.lit(False))
    scopes = _shape(files.select("path", whole.alias("scope")).unionByName(placed.where(opens).select("path", at("line").alias("scope"))).unionByName(files.limit(1).select(F.lit("").alias("path"), F.lit("laravel\0app").alias("scope"))), SCOPES, scope="scope", framework=F.lit("laravel"), path="path", expression=F.lit('""'), app=F.lit(True))
    plain = placed.where(F.col("s").rlike(rf"(?:::|->)(?:{_VERB}|any|match)\(") & ~opens).withColumn("verb", _got(rf"(?:::|->)({_VERB}|any|match)\(")).withColumn("expression", F.when(F.col("verb") == "match", _got(rf"(?:::|->)match\(\s*\[[^\]]*\]\s*,\s*{e}")).otherwise(_got(rf"(?:::|->)(?:{_VERB}|any)\(\s*{e}")))
    verbs = F.when(F.col("verb") == "match", F.transform(F.regexp_extract_all(_got(r"(?:::|->)match\(\s*\[([^\]]*)\]"), F.lit(rf"(?i)\b({_VERB})\b"), F.lit(1)), F.upper)).when(F.col("verb") == "any", F.array(F.lit("ANY"))).otherwise(F.array(F.upper("verb")))
    action = F.when(F.col("s").rlike(r"\[\s*[\w\\]+::class\s*,"), F.concat_ws(".", _got(r"\[\s*\\?(?:\w+\\)*(\w+)::class\s*,"), _got(r"""::class\s*,\s*["'](\w+)["']"""))).when(F.col("s").rlike(r",\s*[\w\\]+::class\s*\)"), F.concat(_got(r",\s*\\?(?:\w+\\)*(\w+)::class\s*\)"), F.lit(".__invoke")))
    one = plain.withColumn("handler", action).withColumn("one", F.explode(verbs)).where("expression <> ''")
    # a prefix in a single route's chain stands before its path
    full = F.when(F.col("prefix") == '""', F.col("expression")).otherwise(F.concat("prefix", F.lit(' . "/" . '), "expression"))
    singles = _shape(one, ROUTES, scope=scope_of, framework=F.lit("laravel"), verb="one", path="path", line="line", expression=full, handler="handler")
    resource = rf"(?:::|->)(resource|apiResource)\(\s*{e}\s*,\s*\\?(?:\w+\\)*(\w+)::class"
    sets = placed.where(F.col("s").rlike(resource)).withColumn("how", _got(resource)).withColumn("given", _got(resource, 2)).withColumn("class", _got(resource, 3))
    hole = F.concat(F.lit("/{"), F.regexp_replace(F.regexp_replace(F.regexp_extract("given", r"""([\w-]+)["']$""", 1), "ies$", "y"), r"(?<=[^s])s$", ""), F.lit("}"))
    rows = [("GET", 0, "index", 0), ("POST", 0, "store", 0), ("GET", 2, "create", 1), ("GET", 1, "show", 0), ("PUT", 1, "update", 0), ("PATCH", 1, "update", 0), ("DELETE", 1, "destroy", 0), ("GET", 3, "edit", 1)]
    sets = sets.withColumn("v", F.explode(F.array(*(F.struct(F.lit(v).alias("verb"), F.lit(k).alias("k"), F.lit(a).alias("action"), F.lit(bool(w)).alias("pages")) for v, k, a, w in rows)))).where("how = 'resource' or not v.pages")
    end = F.when(F.col("v.k") == 0, "").when(F.col("v.k") == 1, hole).when(F.col("v.k") == 2, "/create").otherwise(F.concat(hole, F.lit("/edit")))
    many = _shape(sets.withColumn("end", end), ROUTES, scope=scope_of, framework=F.lit("laravel"), verb=F.col("v.verb"), path="path", line="line", expression=F.concat("given", F.lit(' . "'), "end", F.lit('"')), handler=F.concat_ws(".", "class", "v.action"))
    return Layout(scopes, mounts, singles.unionByName(many))


def joined(a: Column, b: Column) -> Column:
    """One path behind another, with one slash between, none at the end and holes written `{x}`."""
    holes = F.regexp_replace(F.regexp_replace(F.regexp_replace(b, r"<(?:\w+:)?(\w+)>", r"{$1}"), r"(?<=/|^):(\w+)(?:\([^)]*\))?", r"{$1}"), r"\{(\w+):path\}", r"{$1*}")
    both = F.concat_ws("/", F.regexp_replace(a, "/+$", ""), F.regexp_replace(holes, r"^/+|/+$", ""))
    out = F.regexp_replace(F.regexp_replace(both, "/{2,}", "/"), "/+$", "")
    return F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))


def compose(scopes: DataFrame, mounts: DataFrame) -> DataFrame:
    """scope, prefix, mounted, hops: every prefix a scope is served under, by (scope, prefix, app) and (outer, inner, prefix, replaces).

    The walk starts at scopes that nothing mounts. A scope that no start reaches, because its mounts run in a circle, has its own prefix.
    `mounted` is whether the start is an application; hops is the number of mounts passed.
    """
    own = cut(scopes.groupBy("scope", "prefix").agg(F.max("app").alias("app")), "scopes")
    links = cut(mounts.select("outer", "inner", F.col("prefix").alias("under"), "replaces").distinct(), "mounts")
    start = own.join(links.select(F.col("inner").alias("scope")).distinct(), "scope", "left_anti")
    begin = lambda df: df.select("scope", joined(F.lit(""), F.col("prefix")).alias("prefix"), F.col("app").alias("mounted"), F.array("scope").alias("passed"))
    step = lambda state: (
        state.join(links, F.col("scope") == F.col("outer")).where(~F.array_contains("passed", F.col("inner")))
        .join(own.select(F.col("scope").alias("inner"), F.col("prefix").alias("its")), "inner")
        .select(F.col("inner").alias("scope"), F.when(F.col("replaces"), joined(F.col("prefix"), F.col("under"))).otherwise(joined(joined(F.col("prefix"), F.col("under")), F.col("its"))).alias("prefix"), "mounted", F.array_append("passed", F.col("inner")).alias("passed"))
    )
    done, state = None, cut(begin(start), "prefixes")
    for circles in (False, True):
        while not state.isEmpty():
            done = state if done is None else done.unionByName(state)
            state = cut(step(state).distinct(), "prefixes")
        if not circles:
            reached = done.select("scope").distinct() if done is not None else own.select("scope").limit(0)
            state = cut(begin(own.join(reached, "scope", "left_anti")).withColumn("mounted", F.lit(False)), "prefixes")
    out = done if done is not None else begin(own.limit(0))
    return out.groupBy("scope", "prefix").agg(F.max("mounted").alias("mounted"), F.min(F.size("passed") - 1).alias("hops"))


#: Each framework's reader, and what a tree that has it says somewhere.
FRAMEWORKS = {
    "python": (python_web, r"\b(FastAPI|APIRouter|Flask|Blueprint|Starlette)\("),
    "django": (django, r"\b(re_)?(path|url)\(|\bDefaultRouter\("),
    "express": (express, r"\b(express|Express|Router|fastify|Fastify|Koa|Hono)\("),
    "nestjs": (nest, r"^@Controller\("),
    "laravel": (laravel, r"\bRoute::"),
}


def frameworks_of(tree: Tree) -> list[str]:
    """The frameworks that a tree's statements speak of: one pass."""
    said = tree.lines.agg(*(F.bool_or(F.col("s").rlike(mark)).alias(name) for name, (_, mark) in FRAMEWORKS.items())).first()
    return [name for name in FRAMEWORKS if said[name]]


def route_table(sources: DataFrame, frameworks: list[str] | None = None) -> DataFrame:
    """framework, verb, name (the served path), handler (a definition's id), file, line, hops, confidence of all routes of a tree (path, text).

    resolved: below an application, with all of the path known and a handler found; else heuristic.
    """
    tree = Tree.of(sources)
    spark = sources.sparkSession
    layout = Layout(*(spark.createDataFrame([], schema) for schema in (SCOPES, MOUNTS, ROUTES)))
    for name in frameworks_of(tree) if frameworks is None else frameworks:
        layout = layout + FRAMEWORKS[name][0](tree)
    scopes, mounts, routes = (cut(df.distinct().withColumn("key", F.concat_ws("\0", F.lit(tag), F.xxhash64(*df.columns).cast("string"))), f"layout-{tag}") for tag, df in (("scope", layout.scopes), ("mount", layout.mounts), ("route", layout.routes)))
    given = cut(S.assignments(tree.lines, tree.defs), "assignments")
    asked = scopes.select("key", "path", "owner", "expression").unionByName(mounts.select("key", "path", "owner", "expression")).unionByName(routes.select("key", "path", "owner", "expression"))
    values = cut(S.evaluate(asked, given, tree.bound).withColumnRenamed("value", "prefix"), "path-values")
    served = compose(scopes.join(values, "key").select("scope", "prefix", "app"), mounts.join(values, "key").select("outer", "inner", "prefix", "replaces"))
    known = tree.defs.select("path", F.col("qualified").alias("name"), "id")
    led = S.resolve(routes.where("handler is not null").select("path", F.col("handler").alias("name")), known.select("path", "name"), tree.bound)
    to = led.join(known.select(F.col("path").alias("to_path"), F.col("name").alias("to_name"), "id"), ["to_path", "to_name"]).groupBy("path", F.col("name").alias("handler")).agg(F.min("id").alias("id"))
    rows = routes.join(values.withColumnRenamed("prefix", "own_path"), "key").join(served, "scope").join(to, ["path", "handler"], "left")
    name = joined(F.col("prefix"), F.col("own_path"))
    sure = F.col("mounted") & ~F.contains(name, F.lit(S.HOLE)) & F.col("id").isNotNull()
    return rows.select("framework", "verb", name.alias("name"), F.col("id").alias("handler"), F.col("path").alias("file"), "line", "hops", F.when(sure, "resolved").otherwise("heuristic").alias("confidence")).distinct()


def route_edges(table: DataFrame) -> DataFrame:
    """ROUTES_TO edges from served routes to their handlers, as `build.dedup_edges` takes them."""
    rank = F.when(F.col("confidence") == "resolved", 2).otherwise(1)
    return table.where("handler is not null").select(F.concat(F.lit("route:"), "verb", F.lit(" "), "name").alias("src"), F.col("handler").alias("dst"), F.lit("ROUTES_TO").alias("kind"), "file", "line", "confidence", rank.alias("conf_rank"), F.lit(None).cast("string").alias("gate"))
