"""Callers of equal names in several modules, receivers, inheritance and circles on small trees."""

from __future__ import annotations

import pytest

from lattica.operators import calls as C
from lattica.operators.routing import Tree

PYTHON = {
    "src/a/one.py": "def run():\n    pass\n\ndef helper():\n    run()\n",
    "src/a/two.py": "from b.base import Base\n\ndef run():\n    pass\n\nclass Job(Base):\n    def __init__(self):\n        self.next = Other()\n    def work(self):\n        self.step()\n        super().work()\n        self.next.stop()\n    def step(self):\n        pass\n\nclass Other(Base):\n    pass\n",
    "src/b/base.py": "class Root:\n    def stop(self):\n        pass\n\nclass Base(Root):\n    def work(self):\n        pass\n    def step(self):\n        pass\n",
    "src/b/__init__.py": "from a.one import run as start\nfrom .base import *\n",
    "src/c/use.py": "from a import one, two as second\nfrom b import start, Base as Parent\nimport a.two\n\ndef first():\n    one.run()\n\ndef other():\n    second.run()\n    a.two.run()\n\ndef third(j: second.Job, x):\n    start()\n    j.work()\n    j.stop()\n    x.unique_name()\n    y = Parent()\n    y.step()\n    print(run_away)\n    Parent.work(y)\n",
    "src/c/single.py": "def unique_name():\n    pass\n",
    "src/c/circle.py": "from c.circle2 import B\nclass A(B):\n    def m(self):\n        self.nothing()\n",
    "src/c/circle2.py": "from c.circle import A\nclass B(A):\n    pass\n",
}
SCRIPT = {
    "web/api.ts": "export class Api {\n  load(x: string) {\n    this.send(x)\n  }\n  send(x: string) {\n  }\n}\nexport const make = () => {\n  return 1\n}\n",
    "web/index.ts": "export * from './api'\nexport { make as build } from './api'\n",
    "web/page.ts": "import { Api, build } from './index'\nexport class Page extends Api {\n  constructor(private api: Api) {\n    super()\n  }\n  load(x: string) {\n    super.load(x)\n    this.api.send(x)\n    this.send(build())\n  }\n}\nfunction go() {\n  const p = new Page(1)\n  p.load('x')\n  p.send('y')\n}\n",
}
PHP = {
    "app/Base.php": "<?php\nnamespace App;\nclass Base\n{\n    public function save()\n    {\n    }\n}\n",
    "app/Order.php": "<?php\nnamespace App;\nuse App\\Base as Parental;\nclass Order extends Parental\n{\n    public function pay()\n    {\n        $this->save();\n        parent::save();\n    }\n    public static function find($id)\n    {\n    }\n}\n",
    "app/Http.php": "<?php\nnamespace App\\Http;\nuse App\\Order;\nclass Controller\n{\n    public function show(Order $order)\n    {\n        $order->pay();\n        $order->save();\n        $o = new Order();\n        $o->pay();\n        Order::find(1);\n    }\n}\n",
}
WANT = {
    "python": {
        ("one.py#helper", "one.py#run", "name"), ("use.py#first", "one.py#run", "name"), ("use.py#other", "two.py#run", "name"), ("use.py#third", "one.py#run", "name"), ("two.py#Job.work", "two.py#Job.step", "self"), ("two.py#Job.work", "base.py#Base.work", "self"),
        ("two.py#Job.work", "base.py#Root.stop", "base"), ("two.py#Job.__init__", "two.py#Other", "name"), ("use.py#third", "two.py#Job.work", "receiver"), ("use.py#third", "base.py#Root.stop", "base"), ("use.py#third", "single.py#unique_name", "once"), ("use.py#third", "base.py#Base", "name"), ("use.py#third", "base.py#Base.step", "receiver"), ("use.py#third", "base.py#Base.work", "name"),
    },
    "script": {
        ("api.ts#Api.load", "api.ts#Api.send", "self"), ("page.ts#Page.load", "api.ts#Api.load", "self"), ("page.ts#Page.load", "api.ts#Api.send", "receiver"), ("page.ts#Page.load", "api.ts#Api.send", "base"), ("page.ts#Page.load", "api.ts#make", "name"),
        ("page.ts#go", "page.ts#Page", "name"), ("page.ts#go", "page.ts#Page.load", "receiver"), ("page.ts#go", "api.ts#Api.send", "base"),
    },
    "php": {("Order.php#Order.pay", "Base.php#Base.save", "base"), ("Order.php#Order.pay", "Base.php#Base.save", "self"), ("Http.php#Controller.show", "Order.php#Order.pay", "receiver"), ("Http.php#Controller.show", "Base.php#Base.save", "base"), ("Http.php#Controller.show", "Order.php#Order", "name"), ("Http.php#Controller.show", "Order.php#Order.find", "name")},
}
TREES = {"python": PYTHON, "script": SCRIPT, "php": PHP}


def short(x: str) -> str:
    return x.split(":", 1)[1].split("/")[-1]


@pytest.fixture(scope="module")
def trees(spark):
    return {k: Tree.of(spark.createDataFrame(list(t.items()), "path string, text string").repartition(3)) for k, t in TREES.items()}


@pytest.mark.parametrize("language", sorted(TREES))
def test_calls_have_their_own_targets(trees, language):
    rows = C.resolved(trees[language]).collect()
    got = {(short(r["src"]), short(r["dst"]), r["how"]) for r in rows}
    assert got == WANT[language], (got - WANT[language], WANT[language] - got)
    assert all(r["confidence"] == {"name": "exact", "once": "heuristic"}.get(r["how"], "resolved") for r in rows)


def test_overrides(trees):
    got = {(short(r["src"]), short(r["dst"])) for r in C.overrides(trees["python"]).collect()}
    assert got == {("base.py#Base.work", "two.py#Job.work"), ("base.py#Base.step", "two.py#Job.step")}


def test_an_empty_tree_has_no_calls(spark):
    assert C.resolved(Tree.of(spark.createDataFrame([], "path string, text string"))).collect() == []
