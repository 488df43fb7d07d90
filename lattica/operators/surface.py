"""Findings about what a system offers and calls: producers from facts to rows of one shape.

A producer takes the tables of `Facts` and returns finding, severity, protocol, node, file, line, confidence,
detail and variant. `findings` unites them, marks each by finding, node, file and variant, and keeps one row a
mark: the earliest line, with the others listed.

Tables, of which a caller gives those it has: `externals` (id, protocol, host, port, tls, scheme, literal,
in_url, file, line, confidence), `inbound` (node, name, protocol, transport, guard_state, public, unsure,
reaches_write, exposure, port, mode, webhook, verified, file, line, confidence), `config` (id, key, value, file,
line), `transport` (id, kind, detail, system_protocol, file, line, confidence) and `requests` (id, kind, part,
source, key, via, checked, file, line), `posts` (src, dst, target_origin, file, line, confidence).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import placeholder, secret_key, world_writable
from lattica.model import FINDINGS


@dataclass
class Facts:
    externals: DataFrame | None = None
    inbound: DataFrame | None = None
    config: DataFrame | None = None
    transport: DataFrame | None = None
    requests: DataFrame | None = None
    posts: DataFrame | None = None


Producer = Callable[[Facts], "DataFrame | None"]
PRODUCERS: dict[str, list[Producer]] = {}

# Protocols without protection, ports that say so, and hosts that stay on the machine.
BARE_PROTOCOLS = ["telnet", "tftp"]
BARE_PORTS = {"mqtt": 1883, "smtp": 25}
LOOPBACK = ["localhost", "127.0.0.1", "::1", "0.0.0.0", "host.docker.internal", ""]


def producer(finding: str) -> Callable[[Producer], Producer]:
    """Registers a producer of findings of this name; a name may have several."""

    def put(f: Producer) -> Producer:
        PRODUCERS.setdefault(finding, []).append(f)
        return f

    return put


def local_host(host: Column) -> Column:
    """Whether a host is unknown or stays on the machine."""
    h = F.lower(host)
    return F.coalesce(h.isin(LOOPBACK) | h.startswith("127.") | h.endswith(".localhost"), F.lit(True))


def row(finding: str, node: str | Column, protocol: str | Column, detail: Column, severity: Column | None = None, confidence: Column | None = None, variant: Column | None = None) -> list[Column]:
    """The columns of a finding; file and line are those of the facts."""
    column = lambda x: F.col(x) if isinstance(x, str) else x
    usual = F.lit(FINDINGS[finding][0])
    return [
        F.lit(finding).alias("finding"),
        (F.coalesce(severity, usual) if severity is not None else usual).alias("severity"),
        column(protocol).alias("protocol"),
        column(node).alias("node"),
        F.col("file"),
        F.col("line"),
        (confidence if confidence is not None else F.col("confidence")).alias("confidence"),
        detail.alias("detail"),
        (variant if variant is not None else F.lit(None).cast("string")).alias("variant"),
    ]


@producer("hardcoded")
def literal_credentials(facts: Facts) -> DataFrame | None:
    if facts.externals is None:
        return None
    what = F.when(F.col("protocol") == "saas", "key").otherwise("password")
    literal = facts.externals.where("literal").select(*row("hardcoded", "id", "protocol", F.concat(F.lit("literal "), what, F.lit(" in code or configuration (value not shown)"))))
    in_url = facts.externals.where("in_url").select(*row("hardcoded", "id", "protocol", F.concat(F.lit("password inline in the "), F.coalesce("scheme", "protocol"), F.lit(" connection URL (value not shown)"))))
    return literal.unionByName(in_url)


@producer("hardcoded")
def literal_configuration(facts: Facts) -> DataFrame | None:
    if facts.config is None:
        return None
    last = F.element_at(F.split("key", r"\."), -1)
    return facts.config.where(secret_key(last) & ~placeholder(F.col("value"))).select(*row("hardcoded", "id", F.lit("config"), F.concat(F.lit("literal value in config key "), "key", F.lit(" (value not shown)")), confidence=F.lit("resolved")))


@producer("plaintext")
def unprotected_systems(facts: Facts) -> DataFrame | None:
    if facts.externals is None:
        return None
    why = F.when(~F.col("tls"), F.concat(F.coalesce("scheme", "protocol"), F.lit(" without TLS")))
    why = why.when(F.col("tls").isNull() & F.col("protocol").isin(BARE_PROTOCOLS), F.concat("protocol", F.lit(" has no transport protection")))
    for protocol, port in BARE_PORTS.items():
        why = why.when(F.col("tls").isNull() & (F.col("protocol") == protocol) & (F.col("port") == port), F.lit(f"{protocol} on the plaintext port {port}"))
    found = facts.externals.withColumn("why", why).where(F.col("why").isNotNull() & ~local_host(F.col("host")))
    where = F.concat_ws(":", "host", F.col("port").cast("string"))
    return found.select(*row("plaintext", "id", "protocol", F.concat_ws(": ", "why", where), confidence=F.when(F.col("tls").isNull(), "heuristic").otherwise(F.col("confidence"))))


@producer("plaintext")
def unprotected_channels(facts: Facts) -> DataFrame | None:
    return None if facts.transport is None else facts.transport.where("kind = 'grpc-plaintext'").select(*row("plaintext", "id", F.lit("grpc"), F.col("detail"), variant=F.col("kind")))


@producer("unverified")
def unverified_webhooks(facts: Facts) -> DataFrame | None:
    if facts.inbound is None:
        return None
    return facts.inbound.where("webhook is not null and verified = false").select(*row("unverified", "node", "protocol", F.concat("webhook", F.lit(" webhook "), "name", F.lit(" never verifies the signature or secret")), confidence=F.lit("resolved")))


@producer("unguarded")
def unguarded_handlers(facts: Facts) -> DataFrame | None:
    """Low where public by design, unclear, or without a write behind it; unclear ones are heuristic."""
    if facts.inbound is None:
        return None
    severity = F.when(F.col("public").isNotNull() | F.col("unsure").isNotNull() | ~F.col("reaches_write"), "low")
    tail = F.when(F.col("public").isNotNull(), F.concat(F.lit(" (public by design: "), "public", F.lit(")"))).when(F.col("unsure").isNotNull(), F.concat(F.lit(" (unclear: "), "unsure", F.lit(")"))).otherwise("")
    confidence = F.when(F.col("public").isNull() & F.col("unsure").isNotNull(), "heuristic").otherwise(F.col("confidence"))
    detail = F.concat("name", F.lit(" has no auth guard"), F.when(F.col("reaches_write"), " and reaches a write").otherwise(""), tail)
    return facts.inbound.where("guard_state = 'unguarded'").select(*row("unguarded", "node", "protocol", detail, severity, confidence))


@producer("exposed-listener")
def exposed_listeners(facts: Facts) -> DataFrame | None:
    if facts.inbound is None:
        return None
    port = F.when(F.col("port").isNotNull(), F.concat(F.lit(" on port "), F.col("port").cast("string"))).otherwise("")
    return facts.inbound.where("exposure = 'all'").select(*row("exposed-listener", "node", "protocol", F.concat("transport", F.lit(" listener"), port, F.lit(" bound to all interfaces"))))


@producer("tls-off")
def verification_off(facts: Facts) -> DataFrame | None:
    if facts.transport is None:
        return None
    protocol = F.when(F.col("kind") == "ssh-hostkey-off", "ssh").otherwise(F.coalesce("system_protocol", F.lit("tls")))
    return facts.transport.where(F.col("kind").isin("tls-verify-off", "ssh-hostkey-off")).select(*row("tls-off", "id", protocol, F.col("detail"), variant=F.col("kind")))


@producer("ssrf")
def chosen_hosts(facts: Facts) -> DataFrame | None:
    """Hosts or whole addresses that request input picks; looking one up by name is of medium severity."""
    if facts.requests is None:
        return None
    dns = F.col("kind") == "dns-input"
    found = facts.requests.where(~F.coalesce("checked", F.lit(False)) & (dns | F.col("part").isin("host", "url")))
    what = F.when(dns, "DNS lookup of request input").when(F.col("part") == "url", "the whole outbound URL comes from request input").otherwise("outbound URL host comes from request input")
    source = F.concat_ws(".", "source", "key")
    detail = F.concat(what, F.lit(" ("), source, F.lit(")"), F.when(F.col("via") == "helper", " via helper").otherwise(""))
    return found.select(*row("ssrf", "id", F.when(dns, "dns").otherwise("http"), detail, F.when(dns, "medium"), F.when(F.col("via") == "helper", "heuristic").otherwise("resolved"), F.concat_ws(":", "kind", source)))


@producer("ipc-exposed")
def open_posts(facts: Facts) -> DataFrame | None:
    return None if facts.posts is None else facts.posts.where("target_origin = '*'").select(*row("ipc-exposed", "src", F.lit("postmessage"), F.lit("postMessage with target origin '*': any page in that window receives the message"), variant=F.lit("postmessage-send")))


@producer("ipc-exposed")
def open_sockets(facts: Facts) -> DataFrame | None:
    if facts.inbound is None:
        return None
    return facts.inbound.where((F.col("protocol") == "unix") & world_writable(F.col("mode"))).select(*row("ipc-exposed", "node", "protocol", F.concat(F.lit("Unix socket "), "name", F.lit(" is chmod "), "mode", F.lit(": any local user can connect")), variant=F.lit("unix-mode")))


@producer("ipc-exposed")
def open_endpoints(facts: Facts) -> DataFrame | None:
    """Facts of extensions and desktop windows, but for extension listeners that are unguarded already."""
    if facts.transport is None:
        return None
    found = facts.transport.where(F.col("kind").startswith("ipc-"))
    if facts.inbound is not None:
        known = facts.inbound.where("guard_state = 'unguarded'").select("file", "line", F.lit("ipc-extension-external").alias("kind"))
        found = found.join(known, ["file", "line", "kind"], "left_anti")
    return found.select(*row("ipc-exposed", "id", F.when(F.col("kind") == "ipc-electron", "electron").otherwise("extension"), F.col("detail"), variant=F.concat_ws(":", "kind", F.substring(F.sha2("detail", 256), 1, 6))))


def findings(facts: Facts, names: list[str] | None = None) -> DataFrame:
    """finding, severity, direction, protocol, node, file, line, confidence, detail, variant, mark, also: all findings of the producers that the facts feed, one a mark."""
    found = None
    for name, makers in PRODUCERS.items():
        if names is None or name in names:
            for f in makers:
                out = f(facts)
                if out is not None:
                    found = out if found is None else found.unionByName(out)
    if found is None:
        raise ValueError("no producer has its facts")
    mark = F.substring(F.sha2(F.concat_ws("\0", "finding", "node", F.coalesce("file", F.lit("")), "variant"), 256), 1, 16)
    rest = [c for c in found.columns if c != "line"]
    first = F.min(F.struct(F.coalesce("line", F.lit(0)).alias("at"), F.struct("line", *rest).alias("f"))).alias("first")
    grouped = found.withColumn("mark", mark).groupBy("mark").agg(first, F.sort_array(F.collect_set("line")).alias("lines"))
    direction = F.create_map(*(F.lit(x) for name, (_, d) in FINDINGS.items() for x in (name, d)))
    return grouped.select("first.f.*", "mark", F.array_except("lines", F.array("first.f.line")).alias("also")).withColumn("direction", direction[F.col("finding")])


def exceeds(found: DataFrame, fail_on: str) -> DataFrame:
    """One row, n: findings of a severity or worse; what a check in a build fails on."""
    order = {"high": 0, "medium": 1, "low": 2}
    rank = F.create_map(*(F.lit(x) for p in order.items() for x in p))
    return found.agg(F.count_if(rank[F.col("severity")] <= order[fail_on]).alias("n"))
