"""Source trees to graphs by rules: definitions, calls, routes, endpoints, tables and tests, line by line.

A rule names the languages it reads, a pattern for one line, and what its groups mean; all rules of a language are
tried in one pass over the lines, in the JVM. Rules see no types and no second line, so what they find is
`heuristic` beyond names that are defined once; a parser for a language is registered with `scan.register`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.text import dsn, placeholder
from lattica.operators import build
from lattica.operators.joins import as_of
from lattica.storage import cut

# Languages by file name ending.
ENDINGS = {
    "python": ["py"], "php": ["php"], "typescript": ["ts", "tsx", "js", "jsx", "mjs", "vue"], "dart": ["dart"], "kotlin": ["kt", "kts"], "java": ["java"], "swift": ["swift"], "rust": ["rs"],
    "c": ["c", "h", "cc", "cpp", "hpp"], "go": ["go"], "astro": ["astro"],
}


@dataclass(frozen=True)
class Rule:
    """what: definition, route, endpoint, table, env, test or fact; kind: its kind or side; name: the group that names it; extra: a group with a verb or handler."""

    what: str
    kind: str
    languages: str
    pattern: str
    name: int = 1
    extra: int = 0
    label: str = ""


N = r"([A-Za-z_$][\w$]*)"
S = r"""["'`]([^"'`]*)["'`]"""

DEFINITIONS = [
    Rule("definition", "class", "python", rf"^\s*class\s+{N}"),
    Rule("definition", "function", "python", rf"^\s*(?:async\s+)?def\s+{N}\s*\("),
    Rule("definition", "class", "php", rf"^\s*(?:abstract\s+|final\s+|readonly\s+)*(?:class|interface|trait|enum)\s+{N}"),
    Rule("definition", "function", "php", rf"^\s*(?:(?:public|protected|private|static|abstract|final)\s+)*function\s+&?{N}\s*\("),
    Rule("definition", "class", "typescript", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+{N}"),
    Rule("definition", "function", "typescript", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{N}\s*[<(]"),
    Rule("definition", "function", "typescript", rf"^\s*(?:export\s+)?(?:const|let|var)\s+{N}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>"),
    Rule("definition", "class", "dart", rf"^\s*(?:abstract\s+|sealed\s+|base\s+|final\s+)*(?:class|mixin|enum|extension)\s+{N}"),
    Rule("definition", "function", "dart", rf"^\s*(?:static\s+|external\s+)?(?:[A-Za-z_][\w<>,?\s]*\s+){N}\s*\([^;]*\)\s*(?:async\*?\s*)?(?:\{{|=>)"),
    Rule("definition", "class", "kotlin", rf"^\s*(?:(?:public|private|internal|open|abstract|sealed|data|enum|annotation|inner)\s+)*(?:class|interface|object)\s+{N}"),
    Rule("definition", "function", "kotlin", rf"^\s*(?:(?:public|private|protected|internal|override|suspend|inline|open|abstract|operator|tailrec)\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?{N}\s*\("),
    Rule("definition", "class", "java", rf"^\s*(?:(?:public|protected|private|static|final|abstract|sealed)\s+)*(?:class|interface|enum|record)\s+{N}"),
    Rule("definition", "function", "java", rf"^\s*(?:(?:public|protected|private|static|final|abstract|synchronized|default)\s+)+(?:<[^>]*>\s*)?[\w<>\[\],.?\s]+\s+{N}\s*\([^;]*$"),
    Rule("definition", "class", "swift", rf"^\s*(?:(?:public|private|internal|open|final|fileprivate|indirect)\s+)*(?:class|struct|enum|protocol|actor|extension)\s+{N}"),
    Rule("definition", "function", "swift", rf"^\s*(?:@\w+\s+)*(?:(?:public|private|internal|open|final|static|override|mutating|fileprivate|class)\s+)*func\s+{N}\s*[<(]"),
    Rule("definition", "class", "rust", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+{N}"),
    Rule("definition", "function", "rust", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+{N}\s*[<(]"),
    Rule("definition", "class", "c", rf"^\s*(?:typedef\s+)?(?:struct|class|enum|union)\s+{N}\s*(?:[:{{]|$)"),
    Rule("definition", "function", "c", rf"^(?!\s*(?:return|else|if|while|for|switch)\b)[A-Za-z_][\w\s*&:<>,~]*[\s*&]{N}\s*\([^;]*\)\s*(?:const\s*)?\{{?\s*$"),
    Rule("definition", "class", "go", rf"^\s*type\s+{N}\s+(?:struct|interface)\b"),
    Rule("definition", "function", "go", rf"^func\s+(?:\([^)]*\)\s*)?{N}\s*\("),
]

VERBS = r"(get|post|put|patch|delete|options|head|any|all|match)"
ROUTES = [
    Rule("route", "http_route", "php", rf"Route::{VERBS}\(\s*{S}", 2, 1, "laravel"),
    Rule("route", "http_route", "python", rf"^\s*(?:re_)?path\(\s*r?{S}", 1, 0, "django"),
    Rule("route", "http_route", "python", rf"^\s*@\w+\.{VERBS}\(\s*{S}", 2, 1, "fastapi"),
    Rule("route", "http_route", "python", rf"^\s*@\w+\.route\(\s*{S}", 1, 0, "flask"),
    Rule("route", "http_route", "typescript", r"""^\s*@(Get|Post|Put|Patch|Delete|Options|Head|All)\(\s*(?:["'`]([^"'`]*)["'`])?""", 2, 1, "nestjs"),
    Rule("route", "http_route", "typescript", rf"\b(?:app|router|server|fastify|api)\.{VERBS}\(\s*{S}\s*,", 2, 1, "express"),
    Rule("route", "http_route", "java,kotlin", rf"@(Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:(?:value|path)\s*=\s*)?{S}", 2, 1, "spring"),
    Rule("route", "ui_page", "dart", r"""\bGoRoute\(\s*path:\s*["'](/[\w/:\-]*)""", 1, 0, "flutter"),
    Rule("route", "ui_page", "dart", r"""^\s*["'](/[\w/:\-]*)["']\s*:\s*\(""", 1, 0, "flutter"),
    Rule("route", "http_route", "go", rf"\.HandleFunc\(\s*{S}", 1, 0, "go"),
    Rule("route", "http_route", "rust", rf"\.route\(\s*{S}\s*,\s*(get|post|put|patch|delete)", 1, 2, "axum"),
]

_any = "python,php,typescript,dart,kotlin,java,swift,rust,c,go"
ENDPOINTS = [
    Rule("endpoint", "receive", _any, r"\b(?:listen|bind|createServer)\w*\(\s*\(?(?:[^)]*[:,\s\"'])?(\d{2,5})\b", 1, 0, "tcp"),
    Rule("endpoint", "send", _any, r"\b(?:connect|createConnection|dial|Dial)\w*\(\s*\(?[^)]*[:,\s\"'](\d{2,5})\b", 1, 0, "tcp"),
    Rule("endpoint", "receive", "python,go,java,kotlin,typescript", r"\b(?:add_|Register)([A-Z]\w*?)(?:Servicer_to_server|Server)\(", 1, 0, "grpc"),
    Rule("endpoint", "send", "python,go,java,kotlin,typescript", r"\b([A-Z]\w*?)(?:Stub|ServiceClient|Grpc\.newBlockingStub)\(", 1, 0, "grpc"),
    Rule("endpoint", "receive", "typescript,python", r"^\s*@?(?:Query|Mutation|Subscription)\w*\(\s*(?:\(\)\s*=>\s*\w+,?\s*)?(?:\{\s*name:\s*)?[\"'](\w+)", 1, 0, "graphql"),
    Rule("endpoint", "send", "typescript,dart,kotlin,swift", r"\b(?:query|mutation|subscription)\s+(\w+)\s*[({]", 1, 0, "graphql"),
    Rule("endpoint", "receive", "python", r"^\s*@(?:\w+\.)?(?:task|shared_task|job)\(\s*(?:name\s*=\s*)?[\"']([\w.]+)", 1, 0, "job"),
    Rule("endpoint", "send", "python", r"\bsend_task\(\s*[\"']([\w.]+)", 1, 0, "job"),
    Rule("endpoint", "receive", "typescript", r"(?:@Process(?:or)?|\bnew Worker)\(\s*[\"']([\w.\-]+)", 1, 0, "bull"),
    Rule("endpoint", "send", "typescript", r"\bnew Queue\(\s*[\"']([\w.\-]+)", 1, 0, "bull"),
    Rule("endpoint", "send", _any, r"\b(?:mqtt|mqttClient|client)\.publish\(\s*[\"']([\w/+#\-]*/[\w/+#\-]*)", 1, 0, "mqtt"),
    Rule("endpoint", "receive", _any, r"\b(?:mqtt|mqttClient|client)\.subscribe\(\s*[\"']([\w/+#\-]*/[\w/+#\-]*)", 1, 0, "mqtt"),
    Rule("endpoint", "send", _any, r"\bproducer\.(?:send|produce)\(\s*(?:\{\s*topic:\s*)?[\"']([\w.\-]+)", 1, 0, "kafka"),
    Rule("endpoint", "receive", _any, r"\bconsumer\.subscribe\(\s*(?:\[|\{\s*topic:\s*|\{\s*topics:\s*\[)?\s*[\"']([\w.\-]+)", 1, 0, "kafka"),
    Rule("endpoint", "send", _any, r"\bbasic_?[pP]ublish\(\s*(?:exchange\s*=\s*)?[\"']([\w.\-]*)", 1, 0, "amqp"),
    Rule("endpoint", "receive", _any, r"\bbasic_?[cC]onsume\(\s*(?:queue\s*=\s*)?[\"']([\w.\-]+)", 1, 0, "amqp"),
    Rule("endpoint", "send", "typescript,dart,swift,kotlin", r"\bsocket\.emit\(\s*[\"']([\w:.\-]+)", 1, 0, "socketio"),
    Rule("endpoint", "receive", "typescript,dart,swift,kotlin,python", r"\bsocket\.on\(\s*[\"']([\w:.\-]+)", 1, 0, "socketio"),
    Rule("endpoint", "send", "typescript,dart,python,swift,kotlin", r"\b(?:new WebSocket|WebSocket\.connect|websockets\.connect|WebSocketChannel\.connect)\(\s*[\"'`](?:wss?://[^/\"'`]*)?([^\"'`]*)", 1, 0, "ws"),
    Rule("endpoint", "receive", "typescript,python", r"(?:@WebSocketGateway|\.websocket)\(\s*[\"'`]([^\"'`]*)", 1, 0, "ws"),
    Rule("endpoint", "send", "typescript,dart", r"\bnew EventSource\(\s*[\"'`]([^\"'`]*)", 1, 0, "sse"),
    Rule("endpoint", "receive", "php,python,typescript", r"[\"'`](?:HTTP_)?(?:X-)?(stripe|github|shopify|slack)[-_ ]?(?:hub[-_])?signature", 1, 0, "webhook"),
    Rule("endpoint", "send", "typescript", r"\bipcRenderer\.(?:send|invoke)\(\s*[\"']([\w:.\-]+)", 1, 0, "electron-ipc"),
    Rule("endpoint", "receive", "typescript", r"\bipcMain\.(?:on|handle)\(\s*[\"']([\w:.\-]+)", 1, 0, "electron-ipc"),
    Rule("endpoint", "send", "typescript", r"\bnew BroadcastChannel\(\s*[\"']([\w:.\-]+)", 1, 0, "broadcastchannel"),
    Rule("endpoint", "send", "typescript", r"\binvoke\(\s*[\"']([\w:.\-|]+)[\"']", 1, 0, "tauri"),
    Rule("endpoint", "send", "dart", r"\bMethodChannel\(\s*[\"']([\w:./\-]+)", 1, 0, "flutter"),
    Rule("endpoint", "receive", "kotlin,java,swift", r"\b(?:FlutterMethodChannel|MethodChannel)\([^\"]*\"([\w:./\-]+)", 1, 0, "flutter"),
    Rule("endpoint", "receive", _any, r"[\"'`](?:unix:(?://)?)?(/[\w./\-]+\.sock)\b", 1, 0, "unix"),
    Rule("endpoint", "receive", _any, r"\b(?:request_name|own_name|BusName|g_bus_own_name)\([^\"']*[\"']([\w.]+)", 1, 0, "dbus"),
    Rule("endpoint", "send", "kotlin,java", r"\bIntent\(\s*\"([\w.]+)\"", 1, 0, "intent-action"),
    Rule("endpoint", "send", "kotlin,java", r"\bIntent\(\s*\w+,\s*(\w+)(?:::class\.java|\.class)", 1, 0, "intent"),
    Rule("endpoint", "receive", "swift", r"\bNSXPCListener\(\s*machServiceName:\s*\"([\w.\-]+)", 1, 0, "xpc"),
    Rule("endpoint", "send", "swift", r"\bNSXPCConnection\(\s*(?:machServiceName|serviceName):\s*\"([\w.\-]+)", 1, 0, "xpc"),
    Rule("endpoint", "send", "dart", r"\bIsolate\.spawn\w*\(\s*(\w+)", 1, 0, "isolate"),
    Rule("endpoint", "send", _any, r"\b(?:subprocess\.(?:run|Popen|call|check_output)|execFile|spawn|Process\.(?:start|run)|Command::new)\(\s*\[?\s*[\"']([\w./\-]+)", 1, 0, "process"),
]

FACTS = [
    Rule("table", "READS_TABLE", _any, r"(?i)[\"'`]\s*select\s.*?\bfrom\s+[\"`]?(\w+)"),
    Rule("table", "WRITES_TABLE", _any, r"(?i)[\"'`]\s*(?:insert\s+into|update|delete\s+from)\s+[\"`]?(\w+)"),
    Rule("table", "READS_TABLE", "php", r"\bDB::table\(\s*[\"'](\w+)"),
    Rule("table", "READS_TABLE", "python", r"\b([A-Z]\w*)\.objects\.(?:filter|get|all|exclude|values|count|exists|first)\b"),
    Rule("table", "WRITES_TABLE", "python", r"\b([A-Z]\w*)\.objects\.(?:create|update|bulk_create|get_or_create|update_or_create|delete)\b"),
    Rule("table", "READS_TABLE", "typescript", r"\bprisma\.(\w+)\.(?:find\w*|count|aggregate|groupBy)\("),
    Rule("table", "WRITES_TABLE", "typescript", r"\bprisma\.(\w+)\.(?:create\w*|update\w*|upsert|delete\w*)\("),
    Rule("table", "WRITES_TABLE", "php", r"\b([A-Z]\w*)::(?:create|insert|update|upsert|destroy|updateOrCreate|firstOrCreate)\("),
    Rule("table", "READS_TABLE", "php", r"\b([A-Z]\w*)::(?:find|where|all|query|with|first|findOrFail)\("),
    Rule("env", "READS_ENV", "python", r"\bos\.(?:environ(?:\.get\(|\[)|getenv\()\s*[\"'](\w+)"),
    Rule("env", "READS_ENV", "php", r"\benv\(\s*[\"'](\w+)"),
    Rule("env", "READS_ENV", "typescript", r"\bprocess\.env\.(\w+)"),
    Rule("env", "READS_ENV", "go", r"\bos\.Getenv\(\s*\"(\w+)"),
    Rule("env", "READS_ENV", "rust", r"\benv::var\(\s*\"(\w+)"),
    Rule("test", "test", "python", rf"^\s*(?:async\s+)?def\s+(test_\w+)\s*\("),
    Rule("test", "test", "php", r"^\s*(?:public\s+)?function\s+(test\w+)\s*\("),
    Rule("test", "test", "php", r"\b(?:it|test)\(\s*['\"]([^'\"]+)"),
    Rule("test", "test", "typescript", r"\b(?:it|test)(?:\.\w+)?\(\s*[\"'`]([^\"'`]+)"),
    Rule("test", "test", "kotlin,java", r"@Test\b.*?(?:fun|void)\s+(\w+)"),
    Rule("test", "test", "dart", r"\btest(?:Widgets)?\(\s*[\"']([^\"']+)"),
    Rule("fact", "tls-verify-off", _any, r"(verify\s*=\s*False|rejectUnauthorized\s*:\s*false|InsecureSkipVerify\s*:\s*true|CURLOPT_SSL_VERIFYPEER\s*,\s*(?:false|0)|danger_accept_invalid_certs\(true\)|badCertificateCallback)"),
    Rule("fact", "ssh-hostkey-off", _any, r"(AutoAddPolicy\(\)|StrictHostKeyChecking[= ]no|InsecureIgnoreHostKey\(\))"),
    Rule("fact", "grpc-plaintext", _any, r"(insecure_channel\(|add_insecure_port\(|insecure\.NewCredentials\(\)|usePlaintext\(\))"),
    Rule("fact", "ipc-electron", "typescript", r"(nodeIntegration\s*:\s*true|contextIsolation\s*:\s*false)"),
    Rule("fact", "ipc-extension-external", "typescript", r"(onMessageExternal\.addListener|onConnectExternal\.addListener)"),
    Rule("fact", "l10n-use", "typescript,php,dart,swift,kotlin", r"(?:\$t|\bt|__|trans|\btr|NSLocalizedString|String\(localized:)\(?\s*[\"']([\w.\-]+)[\"']"),
    Rule("fact", "ssrf", "python,typescript,php", r"(?:requests\.\w+|fetch|axios(?:\.\w+)?|Http::\w+)\(\s*(?:request|req|\$request)(?:\.|->)(\w+)"),
    Rule("fact", "loop-route", "typescript", r"\b(?:forEach|for)\b.*\b(?:app|router)\[?\.?\w*\]?\("),
    Rule("fact", "loop-route", "php", r"\bforeach\b.*\bRoute::"),
    Rule("fact", "dynamic-route", "python", r"\burlpatterns\s*\+?=\s*(?!\s*\[)(\w+)"),
    Rule("fact", "unresolved-include", "python", r"\binclude\(\s*(?![\"'(\[])(\w+)"),
    Rule("fact", "registry-assignment", "python", r"^\s*(\w*(?:registry|REGISTRY|handlers|HANDLERS))\[[^\]]+\]\s*=\s*\w+"),
    Rule("fact", "unresolved-navigation", "typescript", r"\b(?:router\.push|navigateTo)\(\s*(?![\"'`{])(\w+)"),
    Rule("fact", "platform-check", _any, r"\b(Platform\.(?:OS|isIOS|isAndroid)|defaultTargetPlatform|sys\.platform|os\.name|process\.platform|#if\s+os\(\w+\)|cfg\(target_os\b|#ifdef\s+_WIN32)"),
]

RULES = DEFINITIONS + ROUTES + ENDPOINTS + FACTS


def language(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    out = F.when(F.lit(False), F.lit(""))
    for name, endings in ENDINGS.items():
        out = out.when(ending.isin(endings), name)
    return out


def facts(sources: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """path, lang, line, what, kind, name, extra, label of every line of the sources (path, text) that a rule of its language fits."""
    lines = sources.withColumn("lang", language(F.col("path"))).where("lang is not null").select("path", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n", -1)).alias("at", "l"))
    chosen = RULES if rules is None else rules
    found = None
    for lang in ENDINGS:
        own = [r for r in chosen if lang in r.languages.split(",")]
        if not own:
            continue
        tried = [
            F.when(
                F.col("l").rlike(r.pattern),
                F.struct(F.lit(r.what).alias("what"), F.lit(r.kind).alias("kind"), F.regexp_extract("l", r.pattern, r.name).alias("name"), (F.upper(F.regexp_extract("l", r.pattern, r.extra)) if r.extra else F.lit("")).alias("extra"), F.lit(r.label).alias("label")),
            )
            for r in own
        ]
        found = F.when(F.col("lang") == lang, F.array_compact(F.array(*tried))) if found is None else found.when(F.col("lang") == lang, F.array_compact(F.array(*tried)))
    rows = lines.select("path", "lang", (F.col("at") + 1).alias("line"), F.explode(found).alias("f"))
    return rows.select("path", "lang", "line", "f.*")


def page_routes(sources: DataFrame) -> DataFrame:
    """path, name, kind, label of files whose place is a route: pages and handlers of file-routed frameworks."""
    p = F.col("path")
    inside = F.regexp_extract(p, r"(?:^|/)(?:src/)?(?:pages|app|server/api|server/routes)/(.*?)(?:/?(?:index|page|route))?(?:\.(?:get|post|put|patch|delete))?\.(?:tsx?|jsx?|vue|astro)$", 1)
    label = F.when(p.rlike(r"(?:^|/)(?:src/)?app/.*(?:page|route)\.(?:tsx?|jsx?)$"), "nextjs").when(p.rlike(r"(?:^|/)server/(?:api|routes)/.*\.ts$"), "nuxt").when(p.rlike(r"\.astro$") & p.rlike("(?:^|/)pages/"), "astro").when(p.rlike(r"(?:^|/)pages/.*\.vue$"), "nuxt").when(p.rlike(r"(?:^|/)pages/.*\.(?:tsx?|jsx?)$"), "nextjs")
    hole = F.regexp_replace(F.regexp_replace(inside, r"\[\.\.\.(\w+)\]", "{$1*}"), r"\[(\w+)\]", "{$1}")
    base = F.when(p.rlike(r"(?:^|/)server/api/"), "/api/").otherwise("/")
    kind = F.when(p.rlike(r"(?:^|/)server/|/route\.(?:tsx?|jsx?)$|(?:^|/)pages/api/"), "http_route").otherwise("ui_page")
    return sources.select("path", label.alias("label"), F.concat(base, F.regexp_replace(hole, r"\([^)]*\)/?", "")).alias("name"), kind.alias("kind")).where("label is not null")


#: Signs before a bracket that call nothing.
KEYWORDS = ["if", "for", "while", "switch", "catch", "return", "function", "def", "fn", "func", "fun", "class", "elif", "match", "when", "with", "and", "or", "not", "in", "is", "new", "super", "sizeof", "await", "yield", "print", "assert", "lambda"]


def spans(found: DataFrame) -> DataFrame:
    """id, path, lang, kind, name, start, end of definitions; one ends before the next of its file begins."""
    defs = found.where("what = 'definition' and name <> ''").groupBy("path", "lang", "line").agg(F.min(F.struct("kind", "name")).alias("d")).select("path", "lang", "line", "d.*")
    end = F.lead("line").over(Window.partitionBy("path").orderBy("line")) - 1
    return defs.select(F.concat("kind", F.lit(":"), "path", F.lit("#"), "name").alias("id"), "path", "lang", "kind", "name", F.col("line").alias("start"), end.alias("end"))


def inside(rows: DataFrame, defs: DataFrame) -> DataFrame:
    """rows (path, line) with src, the definition they lie in; the file where they lie in none."""
    held = as_of(rows, defs.select("path", "start", "id"), "path", "line", "start", ["id"])
    return held.withColumn("src", F.coalesce("id", F.concat(F.lit("file:"), "path"))).drop("id")


def calls(sources: DataFrame, defs: DataFrame) -> DataFrame:
    """src, dst, kind, file, line, confidence, conf_rank, gate: calls by name; sure within a file, a guess where a name is defined once elsewhere, none where it is ambiguous."""
    lines = sources.withColumn("lang", language(F.col("path"))).where("lang is not null").select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n", -1)).alias("at", "l"))
    used = lines.select("path", (F.col("at") + 1).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("l", F.lit(r"([A-Za-z_$][\w$]*)\s*\(")))).alias("name")).where(~F.col("name").isin(KEYWORDS))
    used = used.join(defs.select("path", F.col("start").alias("line"), "name"), ["path", "line", "name"], "left_anti")
    named = defs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only"))
    here = defs.groupBy("path", "name").agg(F.min("id").alias("near"), F.count(F.lit(1)).alias("n_near"))
    met = inside(used, defs).join(named, "name").join(here, ["path", "name"], "left")
    near, once = F.col("n_near") == 1, F.col("near").isNull() & (F.col("n") == 1)
    rows = met.where(near | once).select("src", F.coalesce("near", "only").alias("dst"), F.lit("CALLS").alias("kind"), F.col("path").alias("file"), "line", F.when(near, "resolved").otherwise("heuristic").alias("confidence"), F.when(near, 2).otherwise(1).alias("conf_rank"), F.lit(None).cast("string").alias("gate"))
    return rows.where("src <> dst")


def _edge(rows: DataFrame, src: Column, dst: Column, kind: Column) -> DataFrame:
    return rows.select(src.alias("src"), dst.alias("dst"), kind.alias("kind"), F.col("path").alias("file"), F.col("line").cast("int").alias("line"), F.lit("heuristic").alias("confidence"), F.lit(1).alias("conf_rank"), F.lit(None).cast("string").alias("gate"))


def index(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a source tree (path, text): definitions, calls, routes with the functions they lead to, endpoints with both sides, tables, variables and tests."""
    found = cut(facts(sources), "facts")  # the lines are read once for all that follows
    defs = cut(spans(found), "definitions")
    rest = inside(found.where("what <> 'definition' and name <> ''"), defs)
    verb = F.when(F.col("extra").isin("", "ANY", "ALL", "MATCH", "REQUEST"), "ANY").otherwise(F.col("extra"))
    route = F.concat(F.lit("route:"), verb, F.lit(" "), F.when(F.col("name").startswith("/"), F.col("name")).otherwise(F.concat(F.lit("/"), "name")))
    routes = rest.where("what = 'route'").withColumn("id", route)
    after = as_of(routes, defs.where("kind = 'function'").select("path", F.col("start").alias("since"), F.col("id").alias("handler")), "path", "line", "since", ["handler"], direction="forward")
    pages = page_routes(sources).withColumn("id", F.concat(F.lit("route:ANY "), "name")).withColumn("line", F.lit(1))
    endpoint = F.concat(F.lit("endpoint:"), "label", F.lit(":"), "name")
    ends = rest.where("what = 'endpoint'")
    tests = rest.where("what = 'test'")
    thing = lambda prefix: F.concat(F.lit(f"{prefix}:"), "name")
    edges = (
        calls(sources, defs)
        .unionByName(_edge(after.where("handler is not null"), F.col("id"), F.col("handler"), F.lit("ROUTES_TO")))
        .unionByName(_edge(pages, F.col("id"), F.concat(F.lit("file:"), "path"), F.lit("ROUTES_TO")))
        .unionByName(_edge(ends.where("kind = 'send'"), F.col("src"), endpoint, F.lit("SENDS_TO")))
        .unionByName(_edge(ends.where("kind = 'receive'"), endpoint, F.col("src"), F.lit("RECEIVED_BY")))
        .unionByName(_edge(rest.where("what = 'table'"), F.col("src"), thing("table"), F.col("kind")))
        .unionByName(_edge(rest.where("what = 'env'"), F.col("src"), thing("env"), F.col("kind")))
    )
    edges = build.dedup_edges(edges)
    null = F.lit(None).cast("string")
    shape = lambda df, id_, kind, name, line, entry=null: df.select(id_.alias("id"), kind.alias("kind"), name.alias("name"), F.col("path").alias("file"), line.cast("int").alias("line"), entry.alias("entry_kind"))
    nodes = (
        shape(defs, F.col("id"), F.col("kind"), F.col("name"), F.col("start"))
        .unionByName(shape(routes, F.col("id"), F.lit("route"), F.col("name"), F.col("line"), F.col("kind")))
        .unionByName(shape(pages, F.col("id"), F.lit("route"), F.col("name"), F.col("line"), F.col("kind")))
        .unionByName(shape(tests, F.concat(F.lit("test:"), "path", F.lit("#"), "name"), F.lit("test"), F.col("name"), F.col("line"), F.lit("test")))
        .unionByName(shape(sources, F.concat(F.lit("file:"), "path"), F.lit("file"), F.col("path"), F.lit(1)))
    )
    merged = nodes.groupBy("id").agg(*(F.min_by(c, F.struct("file", "line")).alias(c) for c in ("kind", "name", "entry_kind", "file", "line")))
    missing = build.placeholders(merged, edges).select("id", "kind", "name", null.alias("entry_kind"), null.alias("file"), F.lit(None).cast("int").alias("line"))
    return merged.unionByName(missing), edges


def _lines(sources: DataFrame) -> DataFrame:
    return sources.withColumn("lang", language(F.col("path"))).where("lang is not null").select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n", -1)).alias("at", "l")).select("path", (F.col("at") + 1).alias("line"), "l")


#: An early refusal, a check after which a late answer is dropped, and a write of an object's or component's state.
CHECK = r"(\b(?:abort|forbid|deny)\w*\(|\b40[13]\b|PermissionDenied|Unauthori[sz]ed|Forbidden|authori[sz]e\w*\(|\b(?:check|require|ensure)_?(?:auth|perm|role|admin|login)\w*)"
GUARD = r"\bif\b.*(?:mounted|cancel|disposed|aborted|gone|stale|current|token|version)"
STATE = r"(?:\b(?:self|this)\.[\w.]+\s*=[^=]|\bset[A-Z]\w*\()"


def early_checks(sources: DataFrame, defs: DataFrame, within: int = 12) -> DataFrame:
    """src, file, line, said: refusals and permission checks in the first lines of definitions."""
    held = as_of(_lines(sources).where(F.col("l").rlike(CHECK)), defs.select("path", "start", "id"), "path", "line", "start", ["id"]).join(defs.select("id", "start"), "id")
    return held.where(F.col("line") - F.col("start") <= within).select(F.col("id").alias("src"), F.col("path").alias("file"), "line", F.regexp_extract("l", CHECK, 1).alias("said"))


def stale_writes(sources: DataFrame, defs: DataFrame) -> DataFrame:
    """src, file, line, waited: writes of state after an await of the same function, with no check between that the answer is still wanted."""
    marked = _lines(sources).select("path", "line", F.col("l").rlike(r"\bawait\b").alias("waits"), F.col("l").rlike(GUARD).alias("guards"), F.col("l").rlike(STATE).alias("writes")).where("waits or guards or writes")
    held = as_of(marked, defs.where("kind = 'function'").select("path", "start", "id"), "path", "line", "start", ["id"]).where("id is not null")
    before = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.max(F.when(F.col(c), F.col("line"))).over(before)
    seen = held.withColumn("waited", last("waits")).withColumn("checked", last("guards"))
    return seen.where("writes and waited is not null and (checked is null or checked < waited)").select(F.col("id").alias("src"), F.col("path").alias("file"), "line", "waited")


def mentions(sources: DataFrame, names: DataFrame) -> DataFrame:
    """name, file, line: lines whose text holds a name (name) as a word: never an edge, only where to look."""
    said = _lines(sources).select(F.col("path").alias("file"), "line", F.explode(F.array_distinct(F.regexp_extract_all("l", F.lit(r"([A-Za-z_$][\w$]*)")))).alias("name"))
    return said.join(names.select("name").distinct(), "name", "left_semi")


def precedents(sources: DataFrame, defs: DataFrame, pattern: str) -> DataFrame:
    """src, line: lines within definitions that fit a pattern: how it was done before."""
    found = as_of(_lines(sources).where(F.col("l").rlike(pattern)), defs.select("path", "start", "id"), "path", "line", "start", ["id"])
    return found.where("id is not null").select(F.col("id").alias("src"), "line")


#: Schemes that say that nothing is encrypted; others without a sign of it are unknown.
BARE_SCHEMES = ["http", "ws", "redis", "amqp", "mqtt", "ldap", "ftp", "smtp", "memcached", "nats", "telnet"]
ADDRESS = r"""(\b[a-z][a-z0-9+.\-]*://[^\s"'`<>)\]]+)"""


def externals(sources: DataFrame) -> DataFrame:
    """id, protocol, host, port, tls, scheme, literal, in_url, file, line, confidence: systems that source text addresses by a URL, once a place.

    tls is null where the address doesn't say; a password in the address counts unless it is a reference.
    """
    found = _lines(sources).where(F.col("l").contains("://")).select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("l", F.lit(ADDRESS)))).alias("url"))
    d = dsn(F.col("url"))
    password = F.regexp_extract("url", r"://[^:@/\s]*:([^@/\s]+)@", 1)
    rows = found.withColumn("d", d).where("d.host is not null and d.protocol not in ('file', 'data')").withColumn("scheme", F.col("d.protocol")).withColumn("protocol", F.regexp_replace(F.regexp_replace("d.protocol", r"\+.*$", ""), r"(?<=http|ws|redis|amqp|mqtt|ldap|ftp|smtp)s$", ""))
    tls = F.when(F.col("d.tls"), True).when(F.col("scheme").isin(BARE_SCHEMES), False)
    port = F.col("d.port")
    return rows.select(F.concat_ws(":", F.lit("external"), "protocol", "d.host", port.cast("string")).alias("id"), "protocol", F.lower("d.host").alias("host"), port.alias("port"), tls.alias("tls"), "scheme", F.lit(False).alias("literal"), (~placeholder(password)).alias("in_url"), F.col("path").alias("file"), "line", F.lit("exact").alias("confidence"))


#: Marker files and what their text says of a project.
MARKERS = {
    "laravel": ("composer.json", "laravel/framework"), "php": ("composer.json", ""), "nestjs": ("package.json", "@nestjs/core"), "nextjs": ("package.json", '"next"'), "nuxt": ("package.json", '"nuxt"'), "express": ("package.json", '"express"'), "astro": ("package.json", '"astro"'),
    "typescript": ("package.json", ""), "django": ("requirements.txt", "(?i)django"), "fastapi": ("requirements.txt", "(?i)fastapi"), "flask": ("requirements.txt", "(?i)flask"), "python": ("pyproject.toml", ""), "flutter": ("pubspec.yaml", "flutter:"), "dart": ("pubspec.yaml", ""),
    "rust": ("Cargo.toml", ""), "go": ("go.mod", ""), "kotlin": ("build.gradle.kts", ""), "java": ("pom.xml", ""), "swift": ("Package.swift", ""), "c": ("CMakeLists.txt", ""),
}


def detect(sources: DataFrame) -> DataFrame:
    """name, root: languages and frameworks by marker files and by endings, with the folder that says so."""
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    root = F.regexp_replace("path", r"/?[^/]+$", "")
    said = F.array_compact(F.array(*(F.when((base == file) & (F.col("text").rlike(text) if text else F.lit(True)), name) for name, (file, text) in MARKERS.items())))
    marked = sources.select(F.explode(said).alias("name"), root.alias("root"))
    return marked.unionByName(sources.select(language(F.col("path")).alias("name"), F.lit("").alias("root")).where("name is not null")).distinct()
