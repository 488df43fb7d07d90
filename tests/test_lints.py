"""Cache keys: what they leave out is found, what isn't an input isn't."""

from __future__ import annotations

from lattica.operators import lints as L

PYTHON = "\n".join([
    "class Thumbs:",
    "    def thumbnail(self, url, size):", "        image = render(url, size)", "        self.cache[url] = image",  # 4: size
    "    def badge(self, user):", "        text = user.name + self.theme", "        out = text", "        self.cache[user] = draw(out)",  # 8: self.theme
    "    def whole(self, url, size):", "        key = f\"{url}:{size}\"", "        self.cache[key] = render(url, size)",
    "    def client_is_no_input(self, url):", "        got = self.client.get(url)", "        self.cache[url] = got",
    "    def passes_through(self, key, thing):", "        self.cache[key] = thing",
    "    def by_method(self, url):", "        self.cache.set(url, self.paint(url))",  # 18: self.scale by call
    "    def paint(self, url):", "        return self.inner(url)",
    "    def inner(self, url):", "        return url * self.scale",
    "    def store_it(self, url, size):", "        self.cache[url] = f(size)",
    "    def picked(self, i, rows):", "        row = rows[i]", "        self.cache[i] = g(row)",
])
SCRIPT = "\n".join([
    "function page(userId, theme) {", "  const html = render(userId, theme)", "  pageCache.set(userId, html)", "}",  # 3: theme
    "function good(userId, theme) {", "  const key = `${userId}-${theme}`", "  pageCache.set(key, render(userId, theme))", "}",
    "function other(a, data) {", "  things.set(a, f(data))", "  memo.set(a, f(data))", "}",
])


def test_missing_parts_of_keys(spark):
    df = spark.createDataFrame([("src/a.py", PYTHON), ("web/b.ts", SCRIPT), ("tests/test_a.py", PYTHON)], "path string, text string")
    got = {(r["id"].split("#")[1], r["line"], r["missing"], r["via"]) for r in L.incomplete_cache_keys(df).collect()}
    assert got == {("Thumbs.thumbnail", 4, "size", "value"), ("Thumbs.badge", 8, "self.theme", "value"), ("Thumbs.by_method", 18, "self.scale", "call"), ("page", 3, "theme", "value")}, got


def test_an_empty_tree(spark):
    assert L.incomplete_cache_keys(spark.createDataFrame([], "path string, text string")).collect() == []


ECHO = "\n".join([
    "class Editor:",
    "    def changed(self, text):", "        if self.isApplyingRemote:", "            return", "        self.send(text)",
    "    def apply(self, text):", "        self.isApplyingRemote = True", "        self.text = text", "        self.isApplyingRemote = False",
    "    async def refresh(self):", "        got = await self.load()", "        self.text = got",  # 12: not covered
    "    async def covered(self):", "        self.text = await self.load()",  # 14: its only caller sets the guard
    "    def outer(self):", "        self.isApplyingRemote = True", "        self.middle()",
    "    def middle(self):", "        self.covered()",
    "    async def both(self):", "        self.text = await self.load()",  # 21: one caller doesn't set it
    "    def with_guard(self):", "        self.isApplyingRemote = True", "        self.both()",
    "    def without(self):", "        self.both()",
    "    def plain(self):", "        self.text = ''",
    "    async def other(self):", "        self.title = await self.load()",
    "    async def load(self):", "        return 1",
])


def test_writes_that_no_guard_covers(spark):
    df = spark.createDataFrame([("src/e.py", ECHO), ("tests/test_e.py", ECHO)], "path string, text string")
    got = {(r["guard"], r["state"], r["id"].split("#")[1], r["line"]) for r in L.unguarded_echoes(df).collect()}
    assert got == {("isApplyingRemote", "text", "Editor.refresh", 12), ("isApplyingRemote", "text", "Editor.both", 21)}, got
    assert L.unguarded_echoes(df.limit(0)).collect() == []
