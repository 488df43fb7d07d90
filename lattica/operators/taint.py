"""Request input that reaches addresses of outgoing requests and name lookups: def-use chains over source text.

Rows: assignments, calls and sinks of each function, with the expressions they hold, cut into literals, inputs and names. A name's
use refers to the last assignment of it before (an as-of join by function and name), so a variable that is set anew loses what
it held. The walk's state is (assignment, input, part): it starts at expressions that hold an input and follows uses to a fixpoint; an
argument of a call makes the parameter of the function called tainted, one call deep (calls as `calls.resolved` attributes them).

`part` is what the input controls, told by the text before it: url (nothing before), host (a scheme), path or query (a fixed host).
Conversions to numbers and file names end the taint. `checked` says that a comparison with a list or fixed text mentions one of the
chain's names between its assignment and the request.

Python, JavaScript/TypeScript and PHP are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import calls as C
from lattica.operators import symbols as S
from lattica.operators.joins import as_of
from lattica.operators.routing import Tree
from lattica.storage import cut

N = S.NAME
_Q = r"""\(\s*["']([^"']+)["']"""

#: language, kind of input, pattern; its first group is the key where it has one.
SOURCES = [
    ("typescript", "query", rf"\b(?:req|request|ctx|ctx\.request|c\.req)\.query(?:\.({N})|\[\s*[\"']([^\"']+)[\"']\s*\]|{_Q})?"),
    ("typescript", "body", rf"\b(?:req|request|ctx\.request)\.body(?:\.({N})|\[\s*[\"']([^\"']+)[\"']\s*\])?"),
    ("typescript", "param", rf"\b(?:req|request|ctx|c\.req)\.params?(?:\.({N})|\[\s*[\"']([^\"']+)[\"']\s*\]|{_Q})?"),
    ("typescript", "header", rf"\b(?:req|request)\.(?:headers(?:\.({N})|\[\s*[\"']([^\"']+)[\"']\s*\])|(?:get|header){_Q})"),
    ("typescript", "query", rf"\b(?:getQuery\(\s*\w+\s*\)(?:\.({N}))?|searchParams\.get{_Q})"),
    ("typescript", "body", rf"\b(?:readBody\(\s*\w+\s*\)(?:\.({N}))?|(?:req|request)\.json\(\s*\))"),
    ("typescript", "param", r"\bgetRouterParam\(\s*\w+\s*,\s*[\"']([^\"']+)[\"']"),
    ("python", "query", rf"\brequest\.(?:GET|args|query_params)(?:\.get{_Q}|\[\s*[\"']([^\"']+)[\"']\s*\])?"),
    ("python", "body", rf"\brequest\.(?:POST|form|json|data|get_json\(\s*\)|values)(?:\.get{_Q}|\[\s*[\"']([^\"']+)[\"']\s*\])?"),
    ("python", "header", rf"\brequest\.(?:headers|META)(?:\.get{_Q}|\[\s*[\"']([^\"']+)[\"']\s*\])"),
    ("python", "cookie", rf"\brequest\.(?:COOKIES|cookies)(?:\.get{_Q}|\[\s*[\"']([^\"']+)[\"']\s*\])"),
    ("php", "query", rf"(?:\$request->(?:query|get|input){_Q}|\$_(?:GET|REQUEST)\[\s*[\"']([^\"']+)[\"']\s*\]|\brequest{_Q})"),
    ("php", "body", rf"(?:\$request->(?:post|json){_Q}|\$_POST\[\s*[\"']([^\"']+)[\"']\s*\])"),
    ("php", "param", rf"\$request->route{_Q}"),
    ("php", "header", rf"\$request->header{_Q}"),
    ("php", "cookie", rf"(?:\$request->cookie{_Q}|\$_COOKIE\[\s*[\"']([^\"']+)[\"']\s*\])"),
]
#: language, kind of fact, pattern up to the address.
SINKS = [
    ("typescript", "ssrf", r"\b(?:fetch|\$fetch|ofetch|got|needle|ky)(?:\.(?:get|post|put|patch|delete|head))?\(\s*"),
    ("typescript", "ssrf", r"\b(?:axios|http|https|superagent|undici)(?:\.(?:get|post|put|patch|delete|head|request))?\(\s*"),
    ("typescript", "dns-input", r"\bdns(?:\.promises)?\.(?:lookup|resolve\w*)\(\s*"),
    ("python", "ssrf", r"\b(?:requests|httpx|session|client|http)\.(?:get|post|put|patch|delete|head|options)\(\s*(?:url\s*=\s*)?"),
    ("python", "ssrf", r"\b(?:requests|httpx|session|client)\.request\(\s*[\"']\w+[\"']\s*,\s*(?:url\s*=\s*)?"),
    ("python", "ssrf", r"\b(?:urlopen|urlretrieve)\(\s*"),
    ("python", "dns-input", r"\bsocket\.(?:gethostbyname\w*|getaddrinfo)\(\s*"),
    ("php", "ssrf", r"\bHttp::(?:[\w]+\([^()]*\)->)*(?:get|post|put|patch|delete|head)\(\s*"),
    ("php", "ssrf", r"(?:\b(?:curl_init|file_get_contents|fopen)\(\s*|CURLOPT_URL\s*,\s*|\$(?:client|http)->(?:get|post|put|patch|delete)\(\s*|->request\(\s*[\"']\w+[\"']\s*,\s*)"),
    ("php", "dns-input", r"\b(?:gethostbyname\w*|dns_get_record|checkdnsrr)\(\s*"),
]
ENDS = r"^(?:(?:int|float|len|bool|uuid\.UUID|UUID|Number|parseInt|parseFloat|intval|floatval|basename|secure_filename|os\.path\.basename|path\.basename)\(|\((?:int|float|bool)\)|\+\s*\w)"
GUARD = r"\b(?:in|not in)\s+\w|\.(?:includes|has|indexOf|startswith|startsWith)\(|\b(?:in_array|str_starts_with|array_key_exists)\(|(?:===?|!==?)\s*[\"']"
TEST_PATH = r"(?:^|/)(?:tests?|__tests__|spec)/|(?:^|/)test_[^/]*$|[._](?:test|spec)\.\w+$"

_TOKEN = rf"""([rRbB]*"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`|\x01\d+\x02|\$?{N}(?:(?:\.|->|::|\?\.){N})*|\()"""


def _sum(e: Column) -> Column:
    """Texts with names in them as sums."""
    f = F.regexp_replace(F.regexp_replace(e, r"""\b[fF]"([^"]*)\"""", '"$1"'), r"\b[fF]'([^']*)'", '"$1"')
    python = F.regexp_replace(f, r"(?<!\$)\{([^{}\"]+)\}", '" + $1 + "')
    script = F.regexp_replace(F.regexp_replace(e, r"\$\{([^{}]+)\}", '" + $1 + "'), "`", '"')
    php = F.regexp_replace(F.regexp_replace(e, r"\{(\$[^{}]+)\}", '" . $1 . "'), r'(?<=["\w:/.?=&])\$(\w+)(?=[^"]*"[^"]*$)', '" . \\$$1 . "')
    return F.when(F.col("lang") == "python", F.when(e.rlike(r"\b[fF][\"']"), python).otherwise(e)).when(F.col("lang") == "typescript", F.when(e.contains("`"), script).otherwise(e)).otherwise(php)


def part_of(before: Column) -> Column:
    """What a value controls by the text before it; \\x03 stands for a name of unknown text."""
    return F.when(before == "", "url").when(before.rlike(r"^[a-z][a-z0-9+.-]*://[^/?#]*$"), "host").when(before.rlike(r"^(?:[a-z][a-z0-9+.-]*://|\x03|/)[^?#]*\?"), "query").otherwise("path")


def _argument(text: Column) -> Column:
    """The first argument of a call whose brackets are cut open before it: up to a comma or bracket outside of others."""
    return F.regexp_extract(text, r"^((?:[^,()\[\]\"'`]|\"[^\"]*\"|'[^']*'|`[^`]*`|\((?:[^()]|\([^()]*\))*\)|\[[^\[\]]*\])*)", 1)


def expressions(tree: Tree, placed: DataFrame) -> DataFrame:
    """key, path, lang, fn, line, what (assign, sink or argument), name (variable, kind, or callee and position), expression."""
    body = placed.where(F.col("fn").isNotNull() & F.col("lang").isin("python", "typescript", "php") & ~F.col("path").rlike(TEST_PATH))
    given = rf"^(?:(?:const|let|var)\s+)?(\$?{N})\s*(?::\s*[\w.<>\[\]| ]+)?\s*=(?![=>])\s*(?:await\s+)?(.+?);?$"
    base = ["path", "lang", "fn", "line"]
    assign = body.where(F.col("s").rlike(given)).select(*base, F.lit("assign").alias("what"), F.regexp_replace(F.regexp_extract("s", given, 1), r"^\$", "").alias("name"), F.regexp_extract("s", given, 2).alias("expression"))
    unpack = rf"^(?:const|let|var)\s+\{{([^}}]*)\}}\s*=\s*(?:await\s+)?(.+?);?$"
    several = body.where(F.col("s").rlike(unpack)).withColumn("pair", F.explode(F.split(F.regexp_extract("s", unpack, 1), ","))).select(*base, F.lit("assign").alias("what"), F.trim(F.element_at(F.split("pair", ":"), -1)).alias("name"), F.concat(F.regexp_extract("s", unpack, 2), F.lit("."), F.trim(F.element_at(F.split("pair", ":"), 1))).alias("expression"))
    out = assign.unionByName(several)
    for lang, kind, pattern in SINKS:
        hit = body.where((F.col("lang") == lang) & F.col("s").rlike(pattern))
        out = out.unionByName(hit.select(*base, F.lit("sink").alias("what"), F.lit(kind).alias("name"), _argument(F.regexp_extract("s", rf"{pattern}(.*)$", 1)).alias("expression")))
    call = rf"((?:new\s+)?\$?{N}(?:(?:\.|->|::){N})*\(.*)$"
    calls = body.where(F.col("s").rlike(call)).withColumn("each", F.explode(F.regexp_extract_all("s", F.lit(rf"(\$?{N}(?:(?:\.|->|::)\$?{N})*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))"), F.lit(1))))
    inner = F.regexp_extract("each", r"^[^(]*\((.*)\)$", 1)
    pieces = F.split(inner, r",\s*(?![^(\[{]*[)\]}])")
    args = calls.select(*base, F.regexp_extract("each", r"^([^(]*)\(", 1).alias("callee"), F.posexplode(pieces).alias("pos", "expression")).where("trim(expression) <> ''")
    named = F.regexp_extract("expression", rf"^\s*({N})\s*[=:](?!=)\s*", 1)
    args = args.select(*base, F.lit("argument").alias("what"), F.concat_ws("\0", C._dots(F.col("callee")), F.when(named != "", named).otherwise(F.col("pos").cast("string"))).alias("name"), F.regexp_replace("expression", rf"^\s*{N}\s*[=:](?!=)\s*", "").alias("expression"))
    return out.unionByName(args).where("expression <> ''").distinct().withColumn("key", F.xxhash64("path", "fn", "line", "what", "name", "expression"))


def occurrences(rows: DataFrame) -> DataFrame:
    """key, fn, path, line, what, name, and for each input or name that an expression holds: source, input_key, var, part."""
    rest = None
    for lang in ("python", "typescript", "php"):
        marked, found = F.col("e"), []
        for k, (own, kind, pattern) in enumerate(SOURCES):
            if own != lang:
                continue
            groups = pattern.count("(") - pattern.count("(?") - pattern.count(r"\(")
            key = F.coalesce(*(F.when(F.regexp_extract("e", pattern, g) != "", F.regexp_extract("e", pattern, g)) for g in range(1, groups + 1)))
            found.append(F.when(F.col("e").rlike(pattern), F.struct(F.lit(kind).alias("source"), key.alias("input_key"))))
            marked = F.regexp_replace(marked, pattern, f"\x01{k}\x02")
        own = rows.where((F.col("lang") == lang) & ~F.trim(F.col("expression")).rlike(ENDS)).withColumn("e", _sum(F.col("expression"))).withColumn("marked", marked).withColumn("keys", F.array_compact(F.array(*found)))
        rest = own if rest is None else rest.unionByName(own)
    rest = cut(rest, "taint-inputs")
    tokens = rest.select("key", "path", "fn", "line", "what", "name", "keys", F.posexplode(F.filter(F.regexp_extract_all("marked", F.lit(_TOKEN), F.lit(1)), lambda x: ~x.isin("(", "new", "await", "str", "String", "URL", "urljoin"))).alias("pos", "t"), F.regexp_extract_all("marked", F.lit(_TOKEN), F.lit(1)).alias("all"))
    text = F.array_join(F.transform(F.filter(F.slice("all", 1, F.greatest(F.array_position("all", F.col("t")).cast("int") - 1, F.lit(0))), lambda x: ~x.isin("(", "new", "await", "str", "String", "URL", "urljoin")), lambda x: F.when(x.rlike(r"""^[rRbB]*["'`]"""), F.regexp_replace(x, r"""^[rRbB]*["'`]|["'`]$""", "")).otherwise(F.lit("\x03"))), "")
    kinds = F.array(*(F.lit(kind) for _, kind, _ in SOURCES))
    number = F.regexp_extract("t", "\x01(\\d+)\x02", 1)
    source = F.when(number != "", F.get(kinds, number.cast("int")))
    at_key = F.filter("keys", lambda x: x["source"] == source)
    var = F.when((number == "") & ~F.col("t").rlike(r"""^[rRbB]*["'`]"""), F.regexp_extract(F.regexp_replace("t", r"^\$", ""), rf"^({N})", 1))
    seen = tokens.select("key", "path", "fn", "line", "what", "name", source.alias("source"), F.get(at_key, F.lit(0))["input_key"].alias("input_key"), var.alias("var"), part_of(text).alias("part"))
    return seen.where("source is not null or var is not null").distinct()


def parameters(tree: Tree) -> DataFrame:
    """fn, pos, name, type, line of the functions' parameters; a method's own object isn't counted."""
    heads = tree.lines.join(tree.defs.where("kind = 'function'").select("path", F.col("start").alias("line"), F.col("id").alias("fn")), ["path", "line"])
    listed = F.split(F.regexp_extract("s", r"\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", 1), r",\s*(?![^(\[{]*[)\]}])")
    each = heads.select("fn", "path", "lang", "line", F.posexplode(F.filter(F.transform(listed, F.trim), lambda x: ~x.isin("", "self", "cls", "*", "/"))).alias("pos", "p"))
    plain = F.regexp_replace("p", r"@\w+\([^)]*\)\s*", "")
    name = F.when(F.col("lang") == "php", F.regexp_extract("p", r"\$(\w+)", 1)).otherwise(F.regexp_extract(plain, rf"^(?:(?:private|public|readonly)\s+)*({N})", 1))
    return each.select("fn", "path", "lang", "line", "pos", "p", name.alias("name"), F.lower(F.regexp_extract(plain, r":\s*([\w.]+)", 1)).alias("type"))


def handler_inputs(tree: Tree, params: DataFrame) -> DataFrame:
    """fn, line, name, source, input_key: parameters that a framework fills from the request: those of decorated Python handlers and of Nest's methods."""
    nest = r"@(Query|Body|Param|Headers)\(\s*(?:[\"']([^\"']+)[\"'])?"
    kinds = F.create_map(*(F.lit(x) for x in ("Query", "query", "Body", "body", "Param", "param", "Headers", "header")))
    a = params.where((F.col("lang") == "typescript") & F.col("p").rlike(nest)).select("fn", "line", "name", kinds[F.regexp_extract("p", nest, 1)].alias("source"), F.when(F.regexp_extract("p", nest, 2) != "", F.regexp_extract("p", nest, 2)).otherwise(F.col("name")).alias("input_key"))
    deco = r"^@[\w.]+\.(?:get|post|put|patch|delete|route)\(\s*[\"']([^\"']*)[\"']"
    on = tree.lines.where((F.col("lang") == "python") & F.col("s").rlike(deco)).select("path", "line", F.regexp_extract("s", deco, 1).alias("route"))
    met = as_of(on, tree.defs.where("kind = 'function'").select("path", "start", F.col("id").alias("fn")), "path", "line", "start", ["fn"], direction="forward").select("fn", "route")
    held = params.where("lang = 'python'").join(met.where("fn is not null"), "fn")
    hole = F.rlike("route", F.concat(F.lit(r"[<{](?:\w+:)?"), "name", F.lit(r"(?::\w+)?[>}]")))
    b = held.where(~F.col("name").isin("request", "db", "session") & F.col("type").isin("", "str", "any", "bytes")).where(~F.col("p").contains("Depends")).where(~F.rlike("route", F.concat(F.lit(r"<int:"), "name"))).select("fn", "line", "name", F.when(hole, "param").otherwise("query").alias("source"), F.col("name").alias("input_key"))
    return a.unionByName(b).distinct()


def tainted(sources: DataFrame, tree: Tree | None = None) -> DataFrame:
    """id, kind (ssrf or dns-input), source, key, part, via (direct or helper), caller, checked, file, line: requests and lookups whose address holds request input."""
    tree = tree or Tree.of(sources)
    _, placed = C.sites(tree)
    rows = cut(expressions(tree, placed), "taint-expressions")
    uses = cut(occurrences(rows), "taint-uses")
    params = cut(parameters(tree), "parameters")
    filled = handler_inputs(tree, params).select("fn", F.col("line"), F.col("name"), "source", "input_key")
    # definitions of names: assignments, and parameters at the function's head
    defs = cut(rows.where("what = 'assign'").select("fn", F.col("name").alias("var"), F.col("line").alias("def_line")).unionByName(params.select("fn", F.col("name").alias("var"), F.col("line").alias("def_line"))).distinct(), "taint-definitions")
    asked = uses.where("var is not null").withColumn("slot", F.concat_ws("\0", "fn", "var")).withColumn("until", F.col("line") - 1)
    reached = as_of(asked, defs.select(F.concat_ws("\0", "fn", "var").alias("slot"), "def_line"), "slot", "until", "def_line", ["def_line"]).where("def_line is not null")
    chains = cut(reached.select("key", "fn", "line", "what", "name", "var", "def_line", "part"), "taint-chains")
    combine = F.when(F.col("held") == "url", F.col("part")).when(F.col("part") == "url", F.col("held")).otherwise(F.col("part"))
    direct = uses.where("source is not null")
    columns = ["fn", "line", "what", "name", "key", "source", "input_key", "part", "via", "caller", "names"]
    none = F.lit("")  # no key and no caller: never null here, so that states can be compared
    state = direct.select("fn", "line", "what", "name", "key", "source", F.coalesce("input_key", F.lit("")).alias("input_key"), "part", F.lit("direct").alias("via"), none.alias("caller"), F.array().cast("array<struct<var:string,since:int>>").alias("names"))
    heads = filled.select("fn", "line", F.lit("assign").alias("what"), "name", F.xxhash64("fn", "name").alias("key"), "source", F.coalesce("input_key", F.lit("")).alias("input_key"), F.lit("url").alias("part"), F.lit("direct").alias("via"), none.alias("caller"), F.array().cast("array<struct<var:string,since:int>>").alias("names"))
    state = cut(state.unionByName(heads), "tainted")
    edges = cut(C.resolved(tree).select(F.col("src").alias("fn"), "line", F.col("dst").alias("callee"), F.regexp_extract("dst", r"([^.#]+)$", 1).alias("last")), "taint-calls")
    done = seen = state
    identity = ["fn", "line", "what", "name", "key", "source", "input_key", "part", "via", "caller"]
    for _ in range(S.DEEPEST):
        held = state.where("what = 'assign'").select("fn", F.col("name").alias("var"), F.col("line").alias("def_line"), "source", "input_key", F.col("part").alias("held"), "via", "caller", "names")
        onward = chains.join(held, ["fn", "var", "def_line"]).select("fn", "line", "what", "name", "key", "source", "input_key", combine.alias("part"), "via", "caller", F.array_append("names", F.struct("var", F.col("def_line").alias("since"))).alias("names"))
        passed = state.where("what = 'argument' and via = 'direct'").withColumn("last", F.regexp_extract(F.element_at(F.split("name", "\0"), 1), r"([^.]+)$", 1)).withColumn("which", F.element_at(F.split("name", "\0"), 2))
        at = passed.join(edges, ["fn", "line", "last"]).select(F.col("fn").alias("from"), "callee", "which", "source", "input_key", F.col("part").alias("held"))
        into = at.join(params.select(F.col("fn").alias("callee"), F.col("name").alias("param"), "pos", F.col("line").alias("head")), "callee").where("which = param or which = cast(pos as string)")
        helper = into.select(F.col("callee").alias("fn"), F.col("head").alias("line"), F.lit("assign").alias("what"), F.col("param").alias("name"), F.xxhash64("callee", "param").alias("key"), "source", "input_key", F.col("held").alias("part"), F.lit("helper").alias("via"), F.col("from").alias("caller"), F.array().cast("array<struct<var:string,since:int>>").alias("names"))
        fresh = onward.select(*columns).unionByName(helper.select(*columns)).groupBy(*identity).agg(F.min_by("names", F.size("names")).alias("names")).select(*columns)
        state = cut(fresh.join(seen.select(*identity), identity, "left_anti"), "tainted")
        if state.isEmpty():
            break
        done = seen = done.unionByName(state)
    sinks = done.where("what = 'sink'")
    # comparisons that mention a name of the chain after it was set and before the request
    guards = placed.where(F.col("fn").isNotNull() & F.col("s").rlike(GUARD) & F.col("s").rlike(r"\b(?:if|elif|assert|unless|while)\b|\?|&&|\|\|")).select("fn", F.col("line").alias("guard"), F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace("s", r"""["'][^"']*["']""", ""), F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))).alias("var"))
    own = ["fn", "line", "key", "source", "input_key", "part", "via", "caller"]
    on_chain = sinks.select(*own, F.explode("names").alias("n")).select(*own, "n.var", "n.since").distinct()
    checked = on_chain.join(guards, ["fn", "var"]).where("guard > since and guard <= line").select(*own, F.lit(True).alias("is_checked")).distinct()
    found = sinks.join(checked, own, "left")
    path = F.regexp_extract("fn", r"^\w+:(.*)#", 1)
    return found.select(F.col("fn").alias("id"), F.col("name").alias("kind"), "source", F.nullif("input_key", F.lit("")).alias("key"), "part", "via", F.nullif("caller", F.lit("")).alias("caller"), F.coalesce("is_checked", F.lit(False)).alias("checked"), path.alias("file"), "line").distinct()
