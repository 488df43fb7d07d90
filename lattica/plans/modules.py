"""Source trees of many modules made from the star schema: regions hold nations, nations hold suppliers.

Names, prefixes and topics lead through imports, re-exports, constants and base classes; the SQL says from the tables alone what must come out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import calls, channels, lints, routing, taint, variants
from lattica.plans.registry import query
from lattica.sources.fixture import read

@dataclass(frozen=True)
class Key:
    """A key column of the tables, within a text."""

    column: str


R, N, S = Key("r_regionkey"), Key("n_nationkey"), Key("s_suppkey")


def _text(*parts: str | Key | Column) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else F.col(x.column).cast("string") if isinstance(x, Key) else x for x in parts))


def _tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    region = read(spark, sf_dir, "region").select("r_regionkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey")).join(region, "r_regionkey")
    return region, nation, read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")).join(nation, "n_nationkey")


def _file(df: DataFrame, path, head, line, tail="") -> DataFrame:
    """path, text: a file for each path, its head, a line for each row, and its tail."""
    rows = df.select(path.alias("path"), (F.lit(head) if isinstance(head, str) else head).alias("head"), line.alias("line"))
    return rows.groupBy("path").agg(F.concat(F.min("head"), F.array_join(F.array_sort(F.collect_list("line")), ""), F.lit(tail)).alias("text"))


def routed(spark, sf_dir) -> DataFrame:
    """path, text: applications in four frameworks, each with a route below three nested includes for every supplier."""
    region, nation, supplier = _tables(spark, sf_dir)
    root = F.lit("")
    out = [
        _file(region, _text(root, "fa/main.py"), "from fastapi import FastAPI\napp = FastAPI()\n", _text("from fa.r", R, " import router as r", R, "\napp.include_router(r", R, ', prefix="/v1")\n')),
        _file(nation, _text(root, "fa/consts.py"), 'BASE = "/nations"\n', _text("N_", N, ' = BASE + "/', N, '"\n')),
        _file(nation, _text("fa/r", R, ".py"), _text('router = APIRouter(prefix="/r', R, '")\n'), _text("from fa.n", N, " import router as n", N, "\nfrom fa.consts import N_", N, " as P", N, "\nrouter.include_router(\n    n", N, ",\n    prefix=P", N, ",\n)\n")),
        _file(supplier, _text("fa/n", N, ".py"), "router = APIRouter()\n", _text("from fa.s", S, " import router as s", S, "\nrouter.include_router(s", S, ', prefix="/s', S, '")\n')),
        _file(supplier, _text("fa/s", S, ".py"), 'router = APIRouter(prefix="/items")\n', F.lit('@router.get("/{id}")\ndef show(id):\n    pass\n')),
        _file(region, _text(root, "dj/urls.py"), "urlpatterns = [\n", _text('    path("v1/", include("dj.r', R, '.urls")),\n'), "]\n"),
        _file(nation, _text("dj/r", R, "/urls.py"), "urlpatterns = [\n", _text('    path("r', R, "/n", N, '/", include("dj.n', N, '.urls")),\n'), "]\n"),
        _file(supplier, _text("dj/n", N, "/urls.py"), "urlpatterns = [\n", _text('    path("s', S, '/", include("dj.s', S, '.urls")),\n'), "]\n"),
        _file(supplier, _text("dj/s", S, "/urls.py"), "from . import views\n", F.lit('urlpatterns = [path("items/<int:id>/", views.show)]\n')),
        _file(supplier, _text("dj/s", S, "/views.py"), "", F.lit("def show(request, id):\n    pass\n")),
        _file(region, _text(root, "ex/app.js"), "const app = express()\n", _text("app.use('/v1/r", R, "', require('./r", R, "'))\n")),
        _file(nation, _text("ex/r", R, ".js"), "const router = express.Router()\nmodule.exports = router\n", _text("const n", N, " = require('./n", N, "')\nrouter.use('/n", N, "', n", N, ")\n")),
        _file(supplier, _text("ex/n", N, ".js"), "const router = express.Router()\nmodule.exports = router\n", _text("router.use('/s", S, "', require('./s", S, "'))\n")),
        _file(supplier, _text("ex/s", S, ".js"), "const r = express.Router()\n", F.lit("r.get('/items/:id', show)\nfunction show(req) {\n}\nmodule.exports = r\n")),
        _file(supplier, _text("routes/n", N, ".php"), _text("<?php\nRoute::prefix('v1/r", R, "')->group(function () {\nRoute::prefix('n", N, "')->group(function () {\n"), _text("Route::prefix('s", S, "')->group(function () {\nRoute::get('items/{id}', [C", S, "::class, 'show']);\n});\n"), "});\n});\n"),
        _file(supplier, _text("routes/uses", N, ".php"), "<?php\n", _text("use App\\C", S, ";\n")),
        _file(supplier, _text("app/C", S, ".php"), "<?php\nnamespace App;\n", _text("class C", S, "\n{\n    public function show()\n    {\n    }\n}\n")),
    ]
    made = out[0]
    for more in out[1:]:
        made = made.unionByName(more)
    # a file of groups begins with what it imports
    uses = made.where("path like 'routes/uses%'").select(F.regexp_replace("path", "uses", "n").alias("path"), F.regexp_replace("text", "^<\\?php", "").alias("uses"))
    rest = made.where("path not like 'routes/uses%'").join(uses, "path", "left")
    return rest.select("path", F.when(F.col("uses").isNotNull(), F.concat(F.lit("<?php"), "uses", F.regexp_replace("text", "^<\\?php\n", ""))).otherwise(F.col("text")).alias("text"))


PLACES = "supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"


@query(f"""SELECT 'fastapi' AS framework, 'GET' AS verb, '/v1/r' || r_regionkey || '/nations/' || n_nationkey || '/s' || s_suppkey || '/items/{{id}}' AS name, 'function:fa/s' || s_suppkey || '.py#show' AS handler, 3 AS hops, 'resolved' AS confidence FROM {PLACES}
UNION ALL SELECT 'django', 'ANY', '/v1/r' || r_regionkey || '/n' || n_nationkey || '/s' || s_suppkey || '/items/{{id}}', 'function:dj/s' || s_suppkey || '/views.py#show', 3, 'resolved' FROM {PLACES}
UNION ALL SELECT 'express', 'GET', '/v1/r' || r_regionkey || '/n' || n_nationkey || '/s' || s_suppkey || '/items/{{id}}', 'function:ex/s' || s_suppkey || '.js#show', 3, 'resolved' FROM {PLACES}
UNION ALL SELECT 'laravel', 'GET', '/v1/r' || r_regionkey || '/n' || n_nationkey || '/s' || s_suppkey || '/items/{{id}}', 'function:app/C' || s_suppkey || '.php#C' || s_suppkey || '.show', 3, 'resolved' FROM {PLACES}""")
def served_routes(spark, sf_dir):
    """SL10, SL11, SL12, SL16, R1: routes below three nested includes, groups or mounts at their full paths, with their handlers."""
    return routing.route_table(routed(spark, sf_dir)).select("framework", "verb", "name", "handler", "hops", "confidence")


def library(spark, sf_dir) -> DataFrame:
    """path, text: modules that all define `run` and `save`, through aliases, packages, base classes and receivers."""
    region, nation, supplier = _tables(spark, sf_dir)
    package = _file(nation, _text(F.lit(""), "lib/__init__.py"), "", _text("from .n", N, " import run as run_", N, "\n"))
    base = _file(region, _text("lib/base", R, ".py"), "def run():\n    pass\n", _text("class Root", R, ":\n    def close(self):\n        pass\n\nclass Base", R, "(Root", R, "):\n    def save(self):\n        pass\n"))
    of_nation = _file(nation, _text("lib/n", N, ".py"), "", _text("from lib.base", R, " import Base", R, " as Parent, run as base_run\n\ndef run():\n    base_run()\n\nclass Nation(Parent):\n    def work(self):\n        self.save()\n"))
    of_supplier = _file(supplier, _text("app/s", S, ".py"), "", _text("from lib import run_", N, " as go, n", N, "\nfrom lib.n", N, " import Nation\n\ndef run():\n    go()\n\ndef use(n: Nation):\n    n", N, ".run()\n    run()\n    n.work()\n    n.close()\n    unknown.save()\n"))
    return package.unionByName(base).unionByName(of_nation).unionByName(of_supplier)


@query(f"""WITH r AS (SELECT r_regionkey AS r FROM region), n AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation JOIN region ON r_regionkey = n_regionkey), s AS (SELECT s_suppkey AS s, n_nationkey AS n, r_regionkey AS r FROM {PLACES})
SELECT 'function:lib/n' || n || '.py#run' AS src, 'function:lib/base' || r || '.py#run' AS dst, 'name' AS how, 'exact' AS confidence FROM n
UNION ALL SELECT 'function:lib/n' || n || '.py#Nation.work', 'function:lib/base' || r || '.py#Base' || r || '.save', 'base', 'resolved' FROM n
UNION ALL SELECT 'function:app/s' || s || '.py#run', 'function:lib/n' || n || '.py#run', 'name', 'exact' FROM s
UNION ALL SELECT 'function:app/s' || s || '.py#use', 'function:lib/n' || n || '.py#run', 'name', 'exact' FROM s
UNION ALL SELECT 'function:app/s' || s || '.py#use', 'function:app/s' || s || '.py#run', 'name', 'exact' FROM s
UNION ALL SELECT 'function:app/s' || s || '.py#use', 'function:lib/n' || n || '.py#Nation.work', 'receiver', 'resolved' FROM s
UNION ALL SELECT 'function:app/s' || s || '.py#use', 'function:lib/base' || r || '.py#Root' || r || '.close', 'base', 'resolved' FROM s""")
def resolved_calls(spark, sf_dir):
    """SL1, SL2, SL3, G24, SC9: calls of functions whose name many modules define, through aliases, packages, receivers' types and base classes."""
    return calls.resolved(routing.Tree.of(library(spark, sf_dir))).select("src", "dst", "how", "confidence")


def bus(spark, sf_dir) -> DataFrame:
    """path, text: publishers and subscribers whose channels' names are constants of other files."""
    _, nation, supplier = _tables(spark, sf_dir)
    names = _file(nation, _text(F.lit(""), "bus/names.py"), 'ROOT = "orders"\nclass Topics:\n    BASE = ROOT + "/of"\n', _text("    N_", N, ' = f"{BASE}/', N, '"\n'))
    sends = _file(supplier, _text("bus/s", S, ".py"), "from bus.names import Topics as T\n\n", _text("def send(x):\n    client.publish(T.N_", N, ' + "/s', S, '", x)\n    client.publish(T.N_', N, " + x.tail, x)\n"))
    gets = _file(nation, _text("bus/n", N, ".py"), "from bus import names\n\n", _text("def listen():\n    client.subscribe(names.Topics.N_", N, ' + "/+", got)\n'))
    script = _file(nation, _text(F.lit(""), "web/names.ts"), "export const ROOT = 'ev'\n", _text("export const N_", N, " = `${ROOT}:", N, "`\n"))
    again = _file(nation, _text(F.lit(""), "web/index.ts"), "export * from './names'\n", _text("// ", N, "\n"))
    emits = _file(supplier, _text("web/s", S, ".ts"), _text("import { N_", N, " as name } from './index'\n"), F.lit("export function push(x) {\n  socket.emit(name, x)\n}\n"))
    takes = _file(nation, _text("web/n", N, ".ts"), "", _text("export function take() {\n  socket.on('ev:", N, "', x => x)\n}\n"))
    made = names
    for more in (sends, gets, script, again, emits, takes):
        made = made.unionByName(more)
    return made


@query(f"""SELECT 'mqtt' AS protocol, 'function:bus/s' || s_suppkey || '.py#send' AS sender, 'function:bus/n' || n_nationkey || '.py#listen' AS receiver, 'orders/of/' || n_nationkey || '/s' || s_suppkey AS name FROM {PLACES}
UNION ALL SELECT 'socketio', 'function:web/s' || s_suppkey || '.ts#push', 'function:web/n' || n_nationkey || '.ts#take', 'ev:' || n_nationkey FROM {PLACES}""")
def constant_channels(spark, sf_dir):
    """SP9, SP10, SP2, SP14: topics and events held by constants of other files meet their subscribers; a name whose end isn't known says nothing here."""
    found = channels.links(bus(spark, sf_dir))
    return found.where(~F.col("name").contains("{?}")).select("protocol", "sender", "receiver", "name")


def requesting(spark, sf_dir) -> DataFrame:
    """path, text: handlers that put request input into addresses: through assignments and a helper, checked, as a path, as a number."""
    _, _, supplier = _tables(spark, sf_dir)
    k = F.col("s_suppkey") % 5
    body = (
        F.when(k == 0, _text("    a = request.GET['k", S, "']\n    b = a\n    c = f\"{b}/x\"\n    requests.get(c)\n"))
        .when(k == 1, _text("    a = request.form.get('k", S, "')\n    if a not in ALLOWED:\n        return None\n    requests.get(a)\n"))
        .when(k == 2, _text("    a = request.args['k", S, "']\n    b = \"https://api.example.com/\" + a\n    requests.post(b)\n"))
        .when(k == 3, _text("    a = request.json['k", S, "']\n    b = a\n    pull(b)\n"))
        .otherwise(_text("    a = int(request.GET['k", S, "'])\n    requests.get(f\"https://h/{a}\")\n    b = request.GET['x']\n    b = \"https://fixed.example.com\"\n    requests.get(b)\n"))
    )
    views = _file(supplier, _text("src/v", S, ".py"), _text("import requests\nfrom n", N, " import pull\n\ndef view(request):\n"), body)
    helpers = _file(supplier, _text("src/n", N, ".py"), "import requests\n", F.lit("")).select("path", F.concat("text", F.lit("def pull(address):\n    target = address\n    return requests.get(target)\n")).alias("text"))
    return views.unionByName(helpers)


@query(f"""SELECT CASE k WHEN 3 THEN 'function:src/n' || n || '.py#pull' ELSE 'function:src/v' || s || '.py#view' END AS id, ['query', 'body', 'query', 'body'][(k + 1)::INT] AS source, 'k' || s AS key,
CASE k WHEN 2 THEN 'path' ELSE 'url' END AS part, CASE k WHEN 3 THEN 'helper' ELSE 'direct' END AS via, k = 1 AS checked, CASE WHEN k IN (0, 3) THEN 'ssrf' END AS finding
FROM (SELECT s_suppkey AS s, n_nationkey AS n, s_suppkey % 5 AS k FROM {PLACES}) WHERE k < 4""")
def tainted_requests(spark, sf_dir):
    """SP20, B12: requests whose address holds request input, and which of them are findings."""
    from lattica.operators import surface

    found = taint.tainted(requesting(spark, sf_dir))
    bad = surface.findings(surface.Facts(requests=found)).select(F.col("node").alias("id"), F.col("file").alias("f_file"), F.col("line").alias("f_line"), "finding").distinct()
    met = found.join(bad, (found["id"] == bad["id"]) & (found["file"] == bad["f_file"]) & (found["line"] == bad["f_line"]), "left")
    return met.select(found["id"], "source", "key", "part", "via", "checked", F.when(F.col("part").isin("url", "host") & ~F.col("checked"), F.col("finding")).alias("finding"))


def cached(spark, sf_dir) -> DataFrame:
    """path, text: a class for each supplier whose methods store values in a cache."""
    _, _, supplier = _tables(spark, sf_dir)
    k = F.col("s_suppkey") % 4
    body = (
        F.when(k == 0, F.lit("    def load(self, url, size):\n        a = size\n        b = render(url, a)\n        self.cache[url] = b\n"))
        .when(k == 1, F.lit('    def load(self, url, size):\n        key = f"{url}:{size}"\n        self.cache[key] = render(url, size)\n'))
        .when(k == 2, F.lit("    def load(self, url):\n        self.cache.set(url, self.paint(url))\n    def paint(self, url):\n        return self.inner(url)\n    def inner(self, url):\n        return url * self.scale\n"))
        .otherwise(F.lit("    def load(self, url):\n        got = self.client.get(url)\n        self.cache[url] = got + self.theme\n"))
    )
    return _file(supplier, _text("src/k", S, ".py"), _text("class K", S, ":\n"), body)


@query(f"""SELECT 'function:src/k' || s_suppkey || '.py#K' || s_suppkey || '.load' AS id, ['size', '', 'self.scale', 'self.theme'][(s_suppkey % 4 + 1)::INT] AS missing, CASE s_suppkey % 4 WHEN 2 THEN 'call' ELSE 'value' END AS via
FROM {PLACES} WHERE s_suppkey % 4 <> 1""")
def incomplete_cache_keys(spark, sf_dir):
    """Cached values whose key leaves out a parameter or field that they depend on, through assignments and methods."""
    return lints.incomplete_cache_keys(cached(spark, sf_dir)).select("id", "missing", "via")


def native(spark, sf_dir) -> DataFrame:
    """path, text: a C file for each supplier with a function a platform, and script files by platform."""
    _, _, supplier = _tables(spark, sf_dir)
    c = _file(supplier, _text("src/s", S, ".c"), "#ifdef _WIN32\n", _text("int load_", S, "(int x)\n{\n  win_", S, "(x);\n  log_it(x);\n}\n#elif defined(__APPLE__)\nint load_", S, "(int x)\n{\n  mac_", S, "(x);\n  log_it(x);\n}\n#else\n#if HAVE_X\nint maybe(int x)\n{\n}\n#endif\n#endif\nint common(int x)\n{\n}\n"))
    ios = _file(supplier, _text("app/s", S, ".ios.ts"), "export function save(x) {\n", _text("  keychain_", S, "(x)\n}\n"))
    android = _file(supplier.where("s_suppkey % 2 = 0"), _text("app/s", S, ".android.ts"), "export function save(x) {\n", _text("  keystore_", S, "(x)\n}\n"))
    return c.unionByName(ios).unionByName(android)


@query(f"""WITH s AS (SELECT s_suppkey AS s FROM {PLACES})
SELECT 'function:src/s' || s || '.c#load_' || s AS id, 2 AS start, 'windows' AS targets, '' AS unknown FROM s UNION ALL SELECT 'function:src/s' || s || '.c#load_' || s, 8, 'macos,ios', '' FROM s
UNION ALL SELECT 'function:src/s' || s || '.c#maybe', 15, 'linux,android,web', 'linux,android,web' FROM s UNION ALL SELECT 'function:src/s' || s || '.c#common', 20, 'windows,linux,android,macos,ios,web', '' FROM s
UNION ALL SELECT 'function:app/s' || s || '.ios.ts#save', 1, 'ios', '' FROM s UNION ALL SELECT 'function:app/s' || s || '.android.ts#save', 1, 'android', '' FROM s WHERE s % 2 = 0""")
def platform_tags(spark, sf_dir):
    """SP4, B42, B43: targets of definitions by preprocessor branches and file names, unknown conditions kept live."""
    found = variants.placed(native(spark, sf_dir))
    return found.select("id", "start", F.array_join("targets", ",").alias("targets"), F.array_join("unknown", ",").alias("unknown"))


@query(f"""WITH s AS (SELECT s_suppkey AS s FROM {PLACES}), t(target) AS (VALUES ('linux'), ('android'), ('web'), ('windows'), ('macos'), ('ios'))
SELECT 'function:src/s' || s || '.c#load_' || s AS grp, 'own-calls' AS kind, w || s AS what FROM s, (VALUES ('win_'), ('mac_')) v(w)
UNION ALL SELECT 'function:src/s' || s || '.c#load_' || s, 'missing-target', 'android' FROM s
UNION ALL SELECT 'function:app/s' || s || '.ts#save', 'own-calls', w || s FROM s, (VALUES ('keychain_'), ('keystore_')) v(w) WHERE s % 2 = 0
UNION ALL SELECT 'function:app/s' || s || '.ts#save', 'missing-target', target FROM s, t WHERE s % 2 = 0 AND target IN ('windows', 'macos')""")
def platform_divergences(spark, sf_dir):
    """Variants of one symbol that lack a target or call what no other variant calls."""
    return variants.divergences(native(spark, sf_dir)).select("grp", "kind", "what")


def echoing(spark, sf_dir) -> DataFrame:
    """path, text: an editor for each supplier: an observer with a guard, guarded writes, and asynchronous ones of which some are covered by their callers."""
    _, _, supplier = _tables(spark, sf_dir)
    k = F.col("s_suppkey") % 3
    head = "    def changed(self, x):\n        if self.isApplyingRemote:\n            return\n        self.send(x)\n    def apply(self, x):\n        self.isApplyingRemote = True\n        self.text = x\n        self.isApplyingRemote = False\n"
    guarded, bare = "        self.isApplyingRemote = True\n        self.late()\n", "        self.late()\n"
    body = F.when(k == 0, F.lit(head + "    async def late(self):\n        self.text = await self.load()\n")).when(k == 1, F.lit(head + "    async def late(self):\n        self.text = await self.load()\n    def one(self):\n" + guarded)).otherwise(F.lit(head + "    async def late(self):\n        self.text = await self.load()\n    def one(self):\n" + guarded + "    def two(self):\n" + bare))
    return _file(supplier, _text("src/e", S, ".py"), _text("class Editor", S, ":\n"), body)


@query(f"""SELECT 'function:src/e' || s_suppkey || '.py#Editor' || s_suppkey || '.late' AS id, 'isApplyingRemote' AS guard, 'text' AS state, 11 AS line FROM {PLACES} WHERE s_suppkey % 3 <> 1""")
def unguarded_echoes(spark, sf_dir):
    """Asynchronous writes that no guard covers on some path to them; one that every caller covers isn't found."""
    return lints.unguarded_echoes(echoing(spark, sf_dir)).select("id", "guard", "state", "line")
