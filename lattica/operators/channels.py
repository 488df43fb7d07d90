"""Channels named by constants: topics, events, queues and IPC names evaluated through imports and sums, then matched.

A rule finds the expression that names a channel; `symbols.evaluate` gives all its values, so a topic that another file's constant
holds meets the subscriber that writes it out. A name with an unknown part is a pattern: `{?}` stands for any one level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import calls as C
from lattica.operators import joins as J
from lattica.operators import symbols as S
from lattica.operators.routing import _E, Tree
from lattica.storage import cut

#: protocol, side, languages, pattern before the name's expression, matcher.
RULES = [
    ("mqtt", "send", "python,typescript,php,java,kotlin", r"\b\w*(?:mqtt|[cC]lient)\w*(?:\.|->)publish\(\s*(?:topic\s*=\s*)?", "mqtt"),
    ("mqtt", "receive", "python,typescript,php,java,kotlin", r"\b\w*(?:mqtt|[cC]lient)\w*(?:\.|->)subscribe\(\s*(?:topic\s*=\s*)?", "mqtt"),
    ("kafka", "send", "python,typescript,java,kotlin", r"\b\w*[pP]roducer\.(?:send|produce)\(\s*(?:\{\s*topic\s*:\s*|new\s+ProducerRecord(?:<[^>]*>)?\(\s*)?", "exact"),
    ("kafka", "receive", "python,typescript,java,kotlin", r"\b\w*[cC]onsumer\.subscribe\(\s*(?:\[|\{\s*topics?\s*:\s*\[?|List\.of\()?\s*", "exact"),
    ("socketio", "send", "typescript,python", r"\b(?:socket|io|sio)\.emit\(\s*", "exact"),
    ("socketio", "receive", "typescript,python", r"\b(?:socket|io|sio)\.on\(\s*", "exact"),
    ("electron-ipc", "send", "typescript", r"\bipcRenderer\.(?:send|sendSync|invoke)\(\s*", "exact"),
    ("electron-ipc", "receive", "typescript", r"\bipcMain\.(?:on|once|handle)\(\s*", "exact"),
    ("queue", "send", "python,typescript", r"\b(?:send_task|queue\.(?:enqueue|add))\(\s*", "exact"),
    ("queue", "receive", "python,typescript", r"(?:@\w*\.?(?:shared_)?task\(\s*name\s*=\s*|\bnew\s+Worker\(\s*)", "exact"),
]


def endpoints(tree: Tree) -> DataFrame:
    """protocol, side, matcher, path, line, src (the function, else the file), name: every value that a channel's name can have."""
    _, placed = C.sites(tree)
    found = None
    for protocol, side, languages, pattern, matcher in RULES:
        fits = placed.where(F.col("lang").isin(languages.split(",")) & F.col("s").rlike(pattern + _E))
        own = fits.select(F.lit(protocol).alias("protocol"), F.lit(side).alias("side"), F.lit(matcher).alias("matcher"), "path", "line", "fn", F.coalesce("owner", "around").alias("owner"), F.regexp_extract("s", pattern + _E, 1).alias("expression"))
        found = own if found is None else found.unionByName(own)
    found = cut(found.withColumn("key", F.xxhash64("protocol", "side", "path", "line", "expression").cast("string")), "channel-names")
    values = S.evaluate(found.select("key", "path", "owner", "expression"), cut(S.assignments(tree.lines, tree.defs), "assignments"), tree.bound)
    return found.join(values, "key").select("protocol", "side", "matcher", "path", "line", F.coalesce("fn", F.concat(F.lit("file:"), "path")).alias("src"), F.col("value").alias("name")).where(F.col("name") != S.HOLE).distinct()


def links(sources: DataFrame, tree: Tree | None = None) -> DataFrame:
    """protocol, sender, receiver, name, confidence: who may receive what each sends; heuristic where a part of a name isn't known."""
    ends = cut(endpoints(tree or Tree.of(sources)), "channel-ends")
    out = None
    for matcher in ("mqtt", "exact"):
        side = lambda which, matcher=matcher: ends.where((F.col("matcher") == matcher) & (F.col("side") == which)).select(F.struct("protocol", F.col("src").alias("node")).alias("id"), "name", "protocol", F.col("name").contains(S.HOLE).alias("open"))
        sends, gets = side("send"), side("receive").withColumnRenamed("protocol", "r_protocol").withColumnRenamed("open", "r_open")
        met = J.match_endpoints(sends, gets, matcher, fan_out=True, extra=F.col("protocol") == F.col("r_protocol"))
        rows = met.select("sender.protocol", F.col("sender.node").alias("sender"), F.col("receiver.node").alias("receiver"), F.col("s_name").alias("name"), "confidence")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()
