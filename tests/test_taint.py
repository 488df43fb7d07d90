"""Request input through assignments, sums and helpers to requests; what is converted, checked or set anew isn't found."""

from __future__ import annotations

import pytest

from lattica.operators import taint as T

PYTHON = {
    "src/views.py": "\n".join([
        "import requests", "from helpers import load, safe",
        "def direct(request):", "    requests.get(request.GET.get('url'))",  # 4
        "def two_steps(request):", "    a = request.args['feed']", "    b = a", "    c = f\"{b}/x\"", "    requests.post(c)",  # 9
        "def path_only(request):", "    isbn = request.GET['isbn']", "    requests.get(\"https://api.example.com/books/\" + isbn)",  # 12
        "def query_only(request):", "    code = request.POST.get('code')", "    requests.get(f\"https://api.example.com/x?c={code}\")",  # 15
        "def host(request):", "    h = request.headers['X-Host']", "    requests.get(f\"https://{h}/status\")",  # 18
        "def checked(request):", "    cb = request.json['callback']", "    if cb not in ALLOWED:", "        return None", "    requests.get(cb)",  # 23
        "def number(request):", "    n = int(request.GET['n'])", "    requests.get(f\"{n}\")",
        "def set_anew(request):", "    u = request.GET['u']", "    u = 'https://fixed.example.com'", "    requests.get(u)",
        "def through(request):", "    f = request.form.get('feed')", "    load(f)", "    safe(f)",  # 33 into helper
        "def lookup(request):", "    socket.gethostbyname(request.args.get('host'))",  # 36
        "def clean():", "    requests.get('https://x.example.com')",
    ]),
    "src/helpers.py": "import requests\ndef load(address):\n    target = address\n    return requests.get(target)\ndef safe(address):\n    return len(address)\n",
    "src/api.py": "@app.get('/books/{isbn}')\ndef book(isbn: str, link: str, n: int):\n    httpx.get('https://a.example.com/' + isbn)\n    httpx.get(link)\n    httpx.get(f'{n}')\n",
    "tests/test_views.py": "def test_it(request):\n    requests.get(request.GET['url'])\n",
}
SCRIPT = {
    "src/app.ts": "\n".join([
        "import { pull } from './pull'",
        "function direct(req, res) {", "  fetch(req.query.url)", "}",  # 3
        "function path(req, res) {", "  const isbn = req.params.isbn", "  axios.get(`https://api.example.com/books/${isbn}`)", "}",  # 7
        "function checked(req, res) {", "  const { callback } = req.body", "  if (!HOSTS.includes(callback)) return", "  fetch(callback)", "}",  # 12
        "function helper(req, res) {", "  const feed = req.body.feed", "  pull(feed)", "}",
        "function number(req) {", "  const n = Number(req.query.n)", "  fetch(`https://${n}`)", "}",
        "class Ctl {", "  show(@Query('link') link: string) {", "    return fetch(link)", "  }", "}",  # 24
    ]),
    "src/pull.ts": "export function pull(address: string) {\n  const u = new URL(address)\n  return fetch(u)\n}\n",
}
PHP = {
    "app/C.php": "\n".join([
        "<?php", "class C", "{",
        "    public function direct($request)", "    {", "        Http::get($request->input('url'));", "    }",  # 6
        "    public function sum($request)", "    {", "        $isbn = $request->route('isbn');", "        $u = 'https://api.example.com/' . $isbn;", "        file_get_contents($u);", "    }",  # 12
        "    public function checked()", "    {", "        $cb = $_POST['cb'];", "        if (!in_array($cb, self::HOSTS)) {", "            return;", "        }", "        curl_init($cb);", "    }",  # 20
        "}",
    ]),
}
WANT = {
    "python": {("direct", "ssrf", "query", "url", "url", "direct", False, 4), ("two_steps", "ssrf", "query", "feed", "url", "direct", False, 9), ("path_only", "ssrf", "query", "isbn", "path", "direct", False, 12), ("query_only", "ssrf", "body", "code", "query", "direct", False, 15), ("host", "ssrf", "header", "X-Host", "host", "direct", False, 18), ("checked", "ssrf", "body", "callback", "url", "direct", True, 23), ("load", "ssrf", "body", "feed", "url", "helper", False, 4), ("lookup", "dns-input", "query", "host", "url", "direct", False, 36), ("book", "ssrf", "param", "isbn", "path", "direct", False, 3), ("book", "ssrf", "query", "link", "url", "direct", False, 4)},
    "script": {("direct", "ssrf", "query", "url", "url", "direct", False, 3), ("path", "ssrf", "param", "isbn", "path", "direct", False, 7), ("checked", "ssrf", "body", "callback", "url", "direct", True, 12), ("pull", "ssrf", "body", "feed", "url", "helper", False, 3), ("Ctl.show", "ssrf", "query", "link", "url", "direct", False, 24)},
    "php": {("C.direct", "ssrf", "query", "url", "url", "direct", False, 6), ("C.sum", "ssrf", "param", "isbn", "path", "direct", False, 12), ("C.checked", "ssrf", "body", "cb", "url", "direct", True, 20)},
}
TREES = {"python": PYTHON, "script": SCRIPT, "php": PHP}


@pytest.mark.parametrize("language", sorted(TREES))
def test_requests_whose_address_holds_input(spark, language):
    rows = T.tainted(spark.createDataFrame(list(TREES[language].items()), "path string, text string").repartition(2)).collect()
    got = {(r["id"].split("#")[1], r["kind"], r["source"], r["key"], r["part"], r["via"], r["checked"], r["line"]) for r in rows}
    assert got == WANT[language], (got - WANT[language], WANT[language] - got)
    assert {r["caller"].split("#")[1] for r in rows if r["via"] == "helper"} == {"python": {"through"}, "script": {"helper"}, "php": set()}[language]


def test_an_empty_tree(spark):
    assert T.tainted(spark.createDataFrame([], "path string, text string")).collect() == []
