"""Endpoint name matchers as column expressions.

Each takes the sender's and the receiver's name and gives a struct (ok, lit, wild, multi, ph): whether
they match, literal parts in common, parts taken by a wildcard or parameter, multi-level wildcards,
and parts where a sender's placeholder met a receiver's literal. All run inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PARAM = r"^\{[^{}*]*\}$"
OPTIONAL = r"^\{[^{}*]*\?\}$"
CATCH_ALL = r"^\{[^{}]*\*\??\}$"
OPTIONAL_REST = r"^\{[^{}]*\*\?\}$"
_SPECIAL = r"([.^$*+?()\[\]|\\{}])"


def _info(ok: Column, lit=0, wild=0, multi=0, ph=0) -> Column:
    number = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("int")
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), number(lit).alias("lit"), number(wild).alias("wild"), number(multi).alias("multi"), number(ph).alias("ph"))


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, _SPECIAL, r"\\$1")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def template_regex(name: Column, hole: str) -> Column:
    """A regular expression for a name whose `{...}` parts stand for `hole`."""
    return F.concat(F.lit("(?s)^"), F.regexp_replace(escape_regex(name), r"\\\{[^{}\\]*(?:\\.[^{}\\]*)*\\\}", hole.replace("\\", "\\\\")), F.lit("$"))


def exact(send: Column, recv: Column) -> Column:
    return _info(send == recv, lit=1)


def glob_regex(pattern: Column) -> Column:
    """Shell style over a whole name: `*` any text, `?` one sign, `[...]` one of a set."""
    quoted = F.regexp_replace(pattern, r"([.^$+(){}|\\])", r"\\$1")
    quoted = F.regexp_replace(quoted, r"\[!", "[^")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", "."), F.lit("$"))


def glob(send: Column, recv: Column) -> Column:
    same = send == recv
    fits = recv.rlike(r"[*?\[]") & F.when(recv.rlike(r"[*?\[]"), F.regexp_like(send, glob_regex(recv)))
    return _info(same | fits, lit=F.when(same, 1).otherwise(F.length(F.regexp_replace(recv, r"[*?]|\[[^\]]*\]", ""))), wild=F.when(same, 0).otherwise(1))


def _kind(client: Column, route: Column) -> Column:
    """How one path segment meets another: l literal, p parameter to placeholder, w literal to parameter, h placeholder to literal, x not."""
    held = client.rlike(PARAM) | (client == "{?}")
    hole = "[^/]+"
    return (
        F.when(route.rlike(PARAM), F.when(held, "p").otherwise("w"))
        .when(client == route, "l")
        .when(route.rlike(r"\{[^{}]*\}") & (F.regexp_replace(client, r"\{[^{}]*\}", "{}") == F.regexp_replace(route, r"\{[^{}]*\}", "{}")), "p")
        .when(route.rlike(r"\{[^{}]*\}") & ~client.rlike(r"\{[^{}]*\}") & F.regexp_like(client, template_regex(route, hole)), "w")
        .when(client.rlike(r"\{[^{}]*\}") & F.regexp_like(route, template_regex(client, hole)), "h")
        .otherwise("x")
    )


def match_path(client: Column, route: Column) -> Column:
    """URL paths by segment: parameters, optional trailing ones, a catch-all at the end, parameters inside a segment."""
    c, r = segments(client), segments(route)
    rest = F.when(F.size(r) > 0, F.try_element_at(r, F.lit(-1)).rlike(CATCH_ALL)).otherwise(False)
    fixed = F.when(rest, F.size(r) - 1).otherwise(F.size(r))
    met = F.transform(F.filter(F.zip_with(c, F.slice(r, F.lit(1), F.greatest(fixed, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["b"].isNotNull()), lambda p: F.when(p["a"].isNull(), F.when(p["b"].rlike(OPTIONAL), "o").otherwise("x")).otherwise(_kind(p["a"], p["b"])))
    left = F.size(c) - fixed
    tail = F.when(rest, (left >= 1) | (left >= 0) & F.try_element_at(r, F.lit(-1)).rlike(OPTIONAL_REST)).otherwise(left <= 0)
    n = lambda k: F.size(F.filter(met, lambda x: x == k))
    return _info(tail & ~F.array_contains(met, "x"), lit=n("l"), wild=n("p") + n("w") + F.when(rest, 1).otherwise(0), ph=n("h"))


def path(send: Column, recv: Column) -> Column:
    """match_path with a literal in common at least, but for the root itself."""
    m = match_path(send, recv)
    root = (F.btrim(send, F.lit("/")) == "") & (F.btrim(recv, F.lit("/")) == "")
    return F.when(m["ok"] & (m["lit"] == 0) & ~root, _info(F.lit(False))).otherwise(m)


def _levels(s: Column, r: Column, one: str | None) -> Column:
    """Kinds of equally many levels: l, w (wildcard or parameter), h (sender's placeholder), x."""
    wild = r.rlike(PARAM) if one is None else (r == one) | r.rlike(PARAM)
    return F.when(wild, "w").when(s == r, "l").when(s.rlike(PARAM), "h").otherwise("x")


def topic(sep: str, one: str | None, many: str | None, many_min: int = 0, many_last: bool = True) -> Callable[[Column, Column], Column]:
    """Topic names with wildcards of one level and of many in the receiver's pattern."""
    quoted = f"\\Q{sep}\\E"

    def match(send: Column, recv: Column) -> Column:
        s, r = F.split(send, quoted, -1), F.split(recv, quoted, -1)
        last = F.try_element_at(r, F.lit(-1)) == many if many else F.lit(False)
        fixed = F.size(r) - F.when(last, 1).otherwise(0)
        met = F.when(F.size(s) >= fixed, F.transform(F.sequence(F.lit(1), F.greatest(fixed, F.lit(1))), lambda i: F.when(i <= fixed, _levels(F.try_element_at(s, i), F.try_element_at(r, i), one)).otherwise("-"))).otherwise(F.array(F.lit("x")))
        n = lambda k: F.size(F.filter(met, lambda x: x == k))
        tail = F.when(last, F.size(s) - fixed >= many_min).otherwise(F.size(s) == fixed)
        plain = _info(tail & ~F.array_contains(met, "x"), lit=n("l"), wild=n("w"), multi=F.when(last, 1).otherwise(0), ph=n("h"))
        if many is None or many_last:
            inner = F.array_contains(F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))), many) if many else F.lit(False)
            return F.when(inner, _info(F.lit(False))).otherwise(plain)
        return F.when(F.array_contains(r, many), _anywhere(s, r, sep, one, many)).otherwise(plain)

    return match


def _anywhere(s: Column, r: Column, sep: str, one: str, many: str) -> Column:
    """A many-level wildcard at any place, by one regular expression; each level ends with the separator."""
    level = F.transform(r, lambda x: F.when(x == many, F.lit(f"(?:[^{sep}]*\\Q{sep}\\E)*")).when((x == one) | x.rlike(PARAM), F.lit(f"[^{sep}]*\\Q{sep}\\E")).otherwise(F.concat(F.lit("(?:"), escape_regex(x), F.lit(f"|\\{{[^{{}}*]*\\}})\\Q{sep}\\E"))))
    fits = F.regexp_like(F.concat(F.array_join(s, sep), F.lit(sep)), F.concat(F.lit("^"), F.array_join(level, ""), F.lit("$")))
    literal = F.filter(r, lambda x: (x != many) & (x != one) & ~x.rlike(PARAM))
    ph = F.size(F.filter(s, lambda x: x.rlike(PARAM) & ~F.array_contains(r, x)))
    held = F.size(F.filter(literal, lambda x: F.array_contains(s, x)))
    return _info(fits, lit=held, wild=F.size(F.filter(r, lambda x: (x == one) | x.rlike(PARAM))), multi=F.size(F.filter(r, lambda x: x == many)), ph=F.least(ph, F.size(literal) - held))


mqtt = topic("/", "+", "#")
nats = topic(".", "*", ">", many_min=1)
amqp_topic = topic(".", "*", "#", many_last=False)
dotted = topic(".", None, None)


def template(send: Column, recv: Column) -> Column:
    """Whole names with `{param}` parts: a receiver's parameter takes any text, a sender's may fit a receiver's literal."""
    hole = "(.+?)"
    length = lambda x: F.length(F.regexp_replace(x, r"\{[^{}]*\}", ""))
    by_recv = recv.contains("{") & F.when(recv.contains("{"), F.regexp_like(send, template_regex(recv, hole)))
    by_send = send.contains("{") & ~recv.contains("{") & F.when(send.contains("{"), F.regexp_like(recv, template_regex(send, hole)))
    return F.when(send == recv, _info(F.lit(True), lit=1)).when(by_recv, _info(F.lit(True), lit=length(recv), wild=F.size(F.regexp_extract_all(recv, F.lit(r"(\{[^{}]*\})"))))).when(by_send, _info(F.lit(True), lit=length(send), ph=1)).otherwise(_info(F.lit(False)))


def _after(x: Column, sep: str) -> Column:
    return F.when(F.instr(x, sep) > 0, F.substring(x, F.instr(x, sep) + len(sep), F.length(x))).otherwise("")


def mcp(send: Column, recv: Column) -> Column:
    """`server/name`: an unknown server is `*`; names match as templates."""
    server = F.substring_index(send, "/", 1)
    m = template(_after(send, "/"), _after(recv, "/"))
    fits = (server == "*") | (server == F.substring_index(recv, "/", 1))
    return _info(fits & m["ok"], lit=m["lit"], wild=m["wild"] + F.when(server == "*", 1).otherwise(0), ph=m["ph"])


def amqp(send: Column, recv: Column) -> Column:
    """`exchange/key`: equal exchanges and a topic match of the keys; `queue:name` is exact."""
    queue = send.startswith("queue:") | recv.startswith("queue:")
    both = send.contains("/") & recv.contains("/") & (F.substring_index(send, "/", 1) == F.substring_index(recv, "/", 1))
    m = amqp_topic(_after(send, "/"), _after(recv, "/"))
    return F.when(queue, exact(send, recv)).otherwise(_info(both & m["ok"], lit=m["lit"] + 1, wild=m["wild"], multi=m["multi"], ph=m["ph"]))


def webhook(send: Column, recv: Column) -> Column:
    """`app:event`: both equal; a receiver of a general signature scheme takes the event of any app."""
    event, own = _after(send, ":"), _after(recv, ":")
    general = F.substring_index(recv, ":", 1).isin("hmac", "webhook", "standard-webhooks", "svix")  # fixed values
    return F.when(send == recv, _info(F.lit(True), lit=2)).otherwise(_info((event != "") & (event == own) & ~event.rlike(PARAM) & general, lit=1, ph=1))


def extension(send: Column, recv: Column) -> Column:
    m = glob(send, recv)
    return _info(m["ok"] & (send.startswith("port:") == recv.startswith("port:")), lit=m["lit"], wild=m["wild"])


MATCHERS: dict[str, Callable[[Column, Column], Column]] = {"exact": exact, "glob": glob, "path": path, "template": template, "mqtt": mqtt, "nats": nats, "amqp_topic": amqp_topic, "dotted": dotted, "mcp": mcp, "amqp": amqp, "webhook": webhook, "extension": extension}


def register(name: str, matcher: Callable[[Column, Column], Column]) -> None:
    """Extension point: a matcher of one's own."""
    MATCHERS[name] = matcher


def rank(info: Column) -> Column:
    """Larger is more specific: fewer placeholders on literals, more literals, fewer wildcards of many levels, fewer of one."""
    return F.struct((-info["ph"]).alias("ph"), info["lit"].alias("lit"), (-info["multi"]).alias("multi"), (-info["wild"]).alias("wild"))


def confidence(info: Column, tied: Column) -> Column:
    return F.when((info["ph"] > 0) | tied, "heuristic").when((info["wild"] > 0) | (info["multi"] > 0), "resolved").otherwise("exact")
