"""Served paths of small trees in each framework, and prefixes against a plain walk."""

from __future__ import annotations

import random

import pytest

from lattica.operators import routing as R
from lattica.operators import symbols as S

TREES = {
    "fastapi": {
        "src/shop/main.py": 'from fastapi import FastAPI\nfrom shop.api import router as api\nfrom shop.consts import ROOT\napp = FastAPI()\napp.include_router(\n    api,\n    prefix=ROOT,\n)\n\n@app.get("/health")\ndef health():\n    pass\n',
        "src/shop/consts.py": 'ROOT = "/api"\nSUB = ROOT + "/v1"\n',
        "src/shop/api.py": 'from fastapi import APIRouter\nfrom shop.orders import router as orders\nrouter = APIRouter(prefix="/v1")\nrouter.include_router(orders, prefix="/shop")\nlost = APIRouter(prefix="/lost")\n\n@lost.get("/x")\ndef nowhere():\n    pass\n',
        "src/shop/orders.py": 'from fastapi import APIRouter\nrouter = APIRouter(prefix="/orders")\n\n@router.get("/{order_id}")\n@cached\nasync def show(order_id: int):\n    pass\n\n@router.post("")\ndef create():\n    pass\n',
        "web/flask_app.py": 'app = Flask(__name__)\nbp = Blueprint("bp", __name__, url_prefix="/old")\ninner = Blueprint("inner", __name__, url_prefix="/inner")\nbp.register_blueprint(inner)\napp.register_blueprint(bp, url_prefix="/new")\n\n@inner.route("/a/<int:n>", methods=["GET", "POST"])\ndef a(n):\n    pass\n',
    },
    "django": {
        "site/urls.py": 'from django.urls import include, path\nfrom rest_framework.routers import DefaultRouter\nfrom site.views import OrderSet\nrouter = DefaultRouter()\nrouter.register(r"orders", OrderSet)\nextra = [\n    path("deep/", include("site.shop.urls")),\n]\nurlpatterns = [\n    path("api/", include(router.urls)),\n    path("shop/", include(extra)),\n    path("", include(("site.blog.urls", "blog"))),\n]\n',
        "site/views.py": "class OrderSet:\n    def list(self):\n        pass\n    def destroy(self):\n        pass\n",
        "site/shop/urls.py": 'from . import views\nfrom django.urls import path, re_path\nurlpatterns = [path("items/<int:pk>/", views.item), re_path(r"^old/(?P<slug>[a-z]+)/$", views.old)]\n',
        "site/shop/views.py": "def item(request, pk):\n    pass\ndef old(request, slug):\n    pass\n",
        "site/blog/urls.py": 'from site.blog.views import Post\nurlpatterns = [path("posts/", Post.as_view())]\n',
        "site/blog/views.py": "class Post:\n    pass\n",
    },
    "express": {
        "srv/app.js": "const express = require('express')\nconst app = express()\nconst api = require('./api')\napp.use('/api', auth, api)\napp.get('/ping', (req, res) => {\n  res.send(1)\n})\n",
        "srv/api/index.js": "const router = express.Router()\nconst { V } = require('../consts')\nrouter.use(`/${V}`, require('./orders'))\nrouter.use('/loop', loop)\nconst loop = express.Router()\nloop.use('/again', router)\nmodule.exports = router\n",
        "srv/consts.js": "const V = 'v2'\nmodule.exports = { V }\n",
        "srv/api/orders.js": "const r = express.Router()\nconst { show } = require('../handlers')\nr.get('/orders/:id', show)\nr.route('/orders').get(list).post(create)\nfunction list(req) {\n}\nfunction create(req) {\n}\nmodule.exports = r\n",
        "srv/handlers.js": "function show(req) {\n}\nexports.show = show\n",
    },
    "nestjs": {
        "n/main.ts": "const app = await NestFactory.create(AppModule)\napp.setGlobalPrefix('api')\n",
        "n/app.module.ts": "import { AdminModule } from './admin.module'\nimport { StatsModule } from './stats'\n@Module({\n  imports: [\n    RouterModule.register([\n      { path: 'admin', module: AdminModule, children: [\n        { path: 'stats', module: StatsModule },\n      ] },\n    ]),\n  ],\n})\nexport class AppModule {}\n",
        "n/admin.module.ts": "import { UsersController } from './users'\n@Module({ controllers: [UsersController] })\nexport class AdminModule {}\n",
        "n/users.ts": "@Controller('users')\nexport class UsersController {\n  @Get(':id')\n  one(@Param('id') id: string) {\n  }\n\n  @Post()\n  async make() {\n  }\n}\n",
        "n/stats.ts": "@Controller({ path: 'daily' })\nexport class DailyController {\n  @Get()\n  all() {\n  }\n}\n@Module({ controllers: [DailyController] })\nexport class StatsModule {}\n@Controller('free')\nexport class FreeController {\n  @Delete('x')\n  drop() {\n  }\n}\n",
    },
    "laravel": {
        "bootstrap/app.php": "<?php\nreturn Application::configure()->withRouting(\n  api: __DIR__.'/../routes/api.php',\n  apiPrefix: 'api/v2',\n  then: function () {\n    Route::middleware('api')->prefix('hooks')->group(base_path('routes/hooks.php'));\n  },\n);\n",
        "routes/api.php": "<?php\nuse App\\Http\\OrderController;\nRoute::post('orders', [OrderController::class, 'store'])->middleware('auth');\nRoute::prefix('shop/{store}')->group(function () {\n    Route::group(['prefix' => 'deep', 'middleware' => 'x'], function () {\n        Route::match(['get', 'put'], 'a', [OrderController::class, 'store']);\n    });\n    Route::apiResource('photos', OrderController::class);\n});\nRoute::prefix('one')->get('two', [OrderController::class, 'store']);\n",
        "routes/hooks.php": "<?php\nuse App\\Http\\OrderController;\nRoute::any('pay', [OrderController::class, 'store']);\n",
        "routes/web.php": "<?php\nRoute::get('orders', 'x');\n",
        "app/OrderController.php": "<?php\nnamespace App\\Http;\nclass OrderController\n{\n    public function store()\n    {\n    }\n    public function index()\n    {\n    }\n}\n",
    },
}
WANT = {
    "fastapi": {("GET", "/health", "health", "resolved"), ("GET", "/api/v1/shop/orders/{order_id}", "show", "resolved"), ("POST", "/api/v1/shop/orders", "create", "resolved"), ("GET", "/lost/x", "nowhere", "heuristic"), ("GET", "/new/inner/a/{n}", "a", "resolved"), ("POST", "/new/inner/a/{n}", "a", "resolved")},
    "django": {("ANY", "/shop/deep/items/{pk}", "item", "resolved"), ("ANY", "/shop/deep/old/{slug}", "old", "resolved"), ("ANY", "/posts", "Post", "resolved"), ("GET", "/api/orders", "OrderSet.list", "resolved"), ("DELETE", "/api/orders/{pk}", "OrderSet.destroy", "resolved"), *((v, p, None, "heuristic") for v, p in (("POST", "/api/orders"), ("GET", "/api/orders/{pk}"), ("PUT", "/api/orders/{pk}"), ("PATCH", "/api/orders/{pk}")))},
    "express": {("GET", "/ping", None, "heuristic"), ("GET", "/api/v2/orders/{id}", "show", "resolved"), ("GET", "/api/v2/orders", "list", "resolved"), ("POST", "/api/v2/orders", "create", "resolved")},
    "nestjs": {("GET", "/api/admin/users/{id}", "UsersController.one", "resolved"), ("POST", "/api/admin/users", "UsersController.make", "resolved"), ("GET", "/api/admin/stats/daily", "DailyController.all", "resolved"), ("DELETE", "/api/free/x", "FreeController.drop", "resolved")},
    "laravel": {("POST", "/api/v2/orders", "OrderController.store", "resolved"), ("GET", "/api/v2/shop/{store}/deep/a", "OrderController.store", "resolved"), ("PUT", "/api/v2/shop/{store}/deep/a", "OrderController.store", "resolved"), ("GET", "/api/v2/shop/{store}/photos", "OrderController.index", "resolved"), ("POST", "/api/v2/shop/{store}/photos", "OrderController.store", "resolved"), ("GET", "/api/v2/one/two", "OrderController.store", "resolved"), ("ANY", "/hooks/pay", "OrderController.store", "resolved"), ("GET", "/orders", None, "heuristic"), *((v, "/api/v2/shop/{store}/photos/{photo}", None, "heuristic") for v in ("GET", "PUT", "PATCH", "DELETE"))},
}


@pytest.mark.parametrize("framework", sorted(TREES))
def test_served_paths(spark, framework):
    df = spark.createDataFrame(list(TREES[framework].items()), "path string, text string").repartition(3)
    got = {(r["verb"], r["name"], r["handler"] and r["handler"].split("#")[1], r["confidence"]) for r in R.route_table(df).collect()}
    assert got == WANT[framework], (got - WANT[framework], WANT[framework] - got)


def test_an_empty_tree_has_no_routes(spark):
    assert R.route_table(spark.createDataFrame([], "path string, text string")).collect() == []
    assert R.route_table(spark.createDataFrame([("a.py", None), ("b.ts", ""), (None, "x")], "path string, text string")).collect() == []


def walked(scopes, mounts):
    """Prefixes by depth-first search; scopes are unique here."""
    join = lambda *p: "/" + "/".join(x.strip("/") for x in p if x.strip("/"))
    out = {}

    def visit(s, prefix, passed):
        out.setdefault(s, set()).add(prefix)
        for o, i, under, replaces in mounts:
            if o == s and i not in passed:
                visit(i, join(prefix, under) if replaces else join(prefix, under, scopes[i]), passed | {i})

    for s, own in scopes.items():
        if s not in {i for _, i, _, _ in mounts}:
            visit(s, join(own), {s})
    for s in set(scopes) - set(out):
        visit(s, join(scopes[s]), {s})
    return {(s, p) for s, ps in out.items() for p in ps}


def test_prefixes_equal_a_plain_walk(spark):
    r = random.Random(8)
    for _ in range(6):
        scopes = {f"s{k}": r.choice(["", "/a", "b/"]) for k in range(9)}
        mounts = [(f"s{r.randrange(9)}", f"s{r.randrange(9)}", f"/m{k}", r.random() < 0.3) for k in range(8)]
        reached = walked(scopes, mounts)
        got = R.compose(spark.createDataFrame([(s, p, True) for s, p in scopes.items()], "scope string, prefix string, app boolean"), spark.createDataFrame(mounts, "outer string, inner string, prefix string, replaces boolean"))
        assert {(x["scope"], x["prefix"]) for x in got.collect()} >= {(s, p) for s, p in reached if s not in circles(mounts)}


def circles(mounts):
    """Scopes that only circles reach, whose start depends on the one that is taken first."""
    top = {o for o, _, _, _ in mounts} - {i for _, i, _, _ in mounts}
    seen, todo = set(top), list(top)
    while todo:
        s = todo.pop()
        for o, i, _, _ in mounts:
            if o == s and i not in seen:
                seen.add(i)
                todo.append(i)
    return {x for m in mounts for x in m[:2]} - seen


SOURCES = {
    "src/shop/topics.py": 'BASE = "orders"\nNEW = BASE + "/new"\nLOOP = OTHER + "x"\nOTHER = LOOP + "y"\nclass Names:\n    DONE = f"{NEW}/done"\n    ALSO = DONE\n    SELF = f"{self.DONE}!"\n',
    "src/shop/__init__.py": "from .topics import NEW as FRESH\nfrom shop import topics\n",
    "src/shop/pay.py": 'from shop import FRESH\nfrom shop.topics import (\n    Names,\n    BASE as B,\n)\nimport shop.topics\nTWO = "a"\nTWO = "b"\n',
    "web/a.ts": "export const ROOT = '/api'\nexport const V = `${ROOT}/v1`\nexport default class Api {\n  load() {\n  }\n}\n",
    "web/b.ts": "export * from './a'\nexport { V as Version } from './a'\nexport * from './sub/c'\n",
    "web/sub/c.ts": "import { Version, ROOT as R } from '../b'\nimport * as N from '../b'\nexport * from '../b'\nconst w = R + '/x' + N.V + z()\n",
    "app/K.php": "<?php\nnamespace App\\Topics;\nclass K {\n    public const ROOT = 'root';\n    const SUB = self::ROOT . '/sub';\n}\n",
    "app/Use.php": "<?php\nuse App\\Topics\\K as Keys;\n$name = Keys::SUB . '/x';\n",
}
ASKED = [
    ("src/shop/pay.py", None, "FRESH", {"orders/new"}), ("src/shop/pay.py", None, "Names.DONE", {"orders/new/done"}), ("src/shop/pay.py", None, 'B + "/" + TWO', {"orders/a", "orders/b"}), ("src/shop/pay.py", None, "shop.topics.NEW", {"orders/new"}),
    ("src/shop/topics.py", "Names", "self.SELF", {"orders/new/done!"}), ("src/shop/topics.py", "Names", "ALSO", {"orders/new/done"}), ("src/shop/topics.py", None, "OTHER", {"{?}"}), ("src/shop/pay.py", None, "nowhere", {"{?}"}), ("src/shop/pay.py", None, "f(x)", {"{?}"}),
    ("web/sub/c.ts", None, "w", {"/api/x/api/v1{?}"}), ("web/sub/c.ts", None, "`${Version}/q/${N.V}`", {"/api/v1/q//api/v1"}), ("app/Use.php", None, "$name", {"root/sub/x"}), ("app/Use.php", None, "Keys::ROOT", {"root"}), ("web/b.ts", None, "'it''s'", {"its"}),
]


def test_constants_through_imports_sums_and_circles(spark):
    df = spark.createDataFrame(list(SOURCES.items()), "path string, text string").repartition(2)
    tree = R.Tree.of(df)
    asked = spark.createDataFrame([(f"k{k}", p, o, e) for k, (p, o, e, _) in enumerate(ASKED)], "key string, path string, owner string, expression string")
    got: dict = {}
    for r in S.evaluate(asked, S.assignments(tree.lines, tree.defs), tree.bound).collect():
        got.setdefault(r["key"], set()).add(r["value"])
    assert got == {f"k{k}": v for k, (*_, v) in enumerate(ASKED)}


def test_definitions_know_their_classes(spark):
    text = "class A:\n    class B:\n        def h(self):\n            def inner():\n                pass\n    def k(self):\n        pass\ndef g():\n    class C:\n        def m(self): pass\n"
    got = {(r["qualified"], r["owner"]) for r in S.definitions(spark.createDataFrame([("a.py", text)], "path string, text string")).collect()}
    assert got == {("A", None), ("A.B", "A"), ("A.B.h", "A.B"), ("A.B.inner", "A.B"), ("A.k", "A"), ("g", None), ("C", None), ("C.m", "C")}
