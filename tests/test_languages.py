"""The rules of each language, framework and protocol on a few lines, and a small tree's graph."""

from __future__ import annotations

import pytest

from lattica.operators import languages as L

LINES = {
    "a.py": ["class Shop:", "    async def buy(self):", '@app.post("/buy")', "path('orders/<int:id>/', view)", '@bp.route("/x")', "def test_buy():", 'send_task("mail.send")', '@shared_task(name="mail.send")', "Order.objects.create(a=1)", 'cur.execute("select * from stock where a")', 'os.getenv("KEY")', "requests.get(u, verify=False)", "sock.bind(('', 8080))", "add_ShopServicer_to_server(x, s)", "subprocess.run(['git', 'log'])"],
    "a.php": ["final class Cart", "public function total()", "Route::get('/cart', [C::class, 'show']);", "DB::table('carts')", "Item::create($x)", "env('APP_KEY')", "public function testTotal()"],
    "a.ts": ["export class Api {", "export const load = async (x) => {", "@Get('items')", "app.put('/x', h)", "router.push(target)", "prisma.order.findMany()", "process.env.TOKEN", "it('works', f)", "ipcMain.handle('open', f)", "socket.emit('chat')", "new Queue('mail')", "new Worker('mail')", "new BroadcastChannel('tabs')", "nodeIntegration: true", "new WebSocket('wss://h/live')"],
    "a.dart": ["class Page extends W {", "Future<int> load(int x) async {", "GoRoute(path: '/home')", "Isolate.spawn(work, x)", "MethodChannel('shop/pay')", "test('adds', f)"],
    "a.kt": ["data class Item(val a: Int)", "suspend fun load(x: Int) {", '@GetMapping("/k")', 'Intent("app.OPEN")'],
    "A.java": ["public class A {", "  public List<String> names(int x) {", '@PostMapping(path = "/j")', "new Intent(ctx, Other.class)"],
    "a.swift": ["public struct Item {", "  private func load(x: Int) {", 'NSXPCConnection(serviceName: "app.x")'],
    "a.rs": ["pub struct Item {", "pub async fn load(x: i32) {", '.route("/r", get(h))', 'Command::new("ls")'],
    "a.c": ["struct item {", "static int load(int x)", "{"],
    "a.go": ["type Item struct {", "func (i *Item) Load(x int) {", 'http.HandleFunc("/g", h)', 'os.Getenv("K")'],
}
WANT = {
    "a.py": "class:Shop function:buy http_route:/buy http_route:orders/<int:id>/ http_route:/x function:test_buy test:test_buy send:mail.send receive:mail.send WRITES_TABLE:Order READS_TABLE:stock READS_ENV:KEY tls-verify-off:verify=False receive:8080 receive:Shop send:git",
    "a.php": "class:Cart function:total http_route:/cart READS_TABLE:carts WRITES_TABLE:Item READS_ENV:APP_KEY function:testTotal test:testTotal",
    "a.ts": "class:Api function:load http_route:items http_route:/x unresolved-navigation:target READS_TABLE:order READS_ENV:TOKEN test:works receive:open send:chat send:mail receive:mail send:tabs ipc-electron:nodeIntegration:true send:/live",
    "a.dart": "class:Page function:load ui_page:/home send:work send:shop/pay test:adds",
    "a.kt": "class:Item function:load http_route:/k send:app.OPEN",
    "A.java": "class:A function:names http_route:/j send:Other",
    "a.swift": "class:Item function:load send:app.x",
    "a.rs": "class:Item function:load http_route:/r send:ls",
    "a.c": "class:item function:load",
    "a.go": "class:Item function:Load http_route:/g READS_ENV:K",
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(p, "\n".join(lines)) for p, lines in LINES.items()] + [("x.py", None), ("y.py", ""), ("z.unknown", "class Z:")], "path string, text string")
    out: dict = {}
    for r in L.facts(df).collect():
        out.setdefault(r["path"], set()).add(f"{r['kind']}:{r['name'].replace(' ', '')}")
    return out


@pytest.mark.parametrize("path", sorted(LINES))
def test_rules_of_a_language(found, path):
    assert set(WANT[path].split()) <= found[path], sorted(set(WANT[path].split()) - found[path])


def test_other_files_give_nothing(found):
    assert set(found) == set(LINES)


def test_a_tree_s_graph(spark):
    tree = [("shop/api.py", '@app.get("/buy")\ndef buy():\n    pay()\n    helper()\n\ndef helper():\n    Order.objects.create()\n'), ("shop/pay.py", "def pay():\n    return twice()\n"), ("one.py", "def twice():\n    pass\n"), ("two.py", "def twice():\n    pass\n"), ("pages/orders/[id].vue", ""), ("package.json", '{"nuxt": "3"}'), ("requirements.txt", "FastAPI==1\n")]
    df = spark.createDataFrame(tree, "path string, text string")
    nodes, edges = L.index(df)
    assert {(r["src"], r["kind"], r["dst"], r["confidence"]) for r in edges.collect()} == {
        ("route:GET /buy", "ROUTES_TO", "function:shop/api.py#buy", "heuristic"),
        ("function:shop/api.py#buy", "CALLS", "function:shop/pay.py#pay", "heuristic"),
        ("function:shop/api.py#buy", "CALLS", "function:shop/api.py#helper", "resolved"),
        ("function:shop/api.py#helper", "WRITES_TABLE", "table:Order", "heuristic"),
        ("route:ANY /orders/{id}", "ROUTES_TO", "file:pages/orders/[id].vue", "heuristic"),
    }
    kinds = {r["id"]: r["kind"] for r in nodes.collect()}
    assert kinds["table:Order"] == "table" and kinds["route:GET /buy"] == "route" and len(kinds) == nodes.count()
    assert {r["name"] for r in L.detect(df).collect()} == {"python", "typescript", "nuxt", "fastapi"}


def test_an_empty_tree(spark):
    nodes, edges = L.index(spark.createDataFrame([], "path string, text string"))
    assert nodes.collect() == [] == edges.collect()


def test_addresses_of_outside_systems(spark):
    text = 'A = "rediss://:secret@cache:6380/0"\nB = "postgres://u:${PW}@db/x"\nC = "http://api.example.com/x?y=1"\nD = "file:///tmp/x"\nE = "postgres+psycopg://u:p@db:5432/x?sslmode=require"'
    found = {r["scheme"]: (r["protocol"], r["host"], r["port"], r["tls"], r["in_url"]) for r in L.externals(spark.createDataFrame([("a.py", text)], "path string, text string")).collect()}
    assert found == {"rediss": ("redis", "cache", 6380, True, True), "postgres": ("postgres", "db", None, None, False), "http": ("http", "api.example.com", None, False, False), "postgres+psycopg": ("postgres", "db", 5432, True, True)}
