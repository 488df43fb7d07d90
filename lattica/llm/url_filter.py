"""URL filters: a blocked Bloom filter before an exact hash join, in DataFrame functions only.

The list holds canonical URL prefixes, each with a verdict: `host/path`, fitting its host, all
subdomains, and every path that starts with its path. For a url the candidate keys are its host's
suffixes times its path's prefixes, of the shapes (labels, path length) that the list has. A
candidate is tested in the blocked Bloom filter: its hash names one block of 512 bits, in which it
must find its eight bits set. Only possible hits go on to the exact hash join with the list, which
removes the false positives; of the rules that remain the longest decides, and of equally long ones
one that blocks.

The filter is a table of blocks. Up to `INLINE_BLOCKS` blocks (2 MB) it is sent as a literal, so
urls without a possible hit never shuffle; beyond that size the candidates meet the blocks in a
join on the block's number.

A null url, or one without "://", has an empty host and path and fits no rule. Repeated pages give
repeated rows. Columns other than the page's id and url aren't read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import ascii_lower

WORDS, PROBES = 8, 8
#: Blocks of 64 bytes that may travel in the plan.
INLINE_BLOCKS = 32_768
#: Keys for one block: 512 bits over 40 keys keep false positives under one in a hundred.
KEYS_PER_BLOCK = 40

#: The rules of the registered query: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _probes(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key, and its bit in each of the block's eight words."""
    h = F.xxhash64(key)
    spread = F.xxhash64(key, F.lit(1))
    block = F.pmod(h, F.lit(n_blocks)).cast("int")
    return block, [F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftright", spread, F.lit(6 * i)).bitwiseAND(F.lit(63).cast("long")).cast("int")) for i in range(PROBES)]


def blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """The filter: rows (block, w0 .. w7) of those blocks that hold a key."""
    block, bits = _probes(F.col("key"), n_blocks)
    return keys.select(block.alias("block"), *(b.alias(f"b{i}") for i, b in enumerate(bits))).groupBy("block").agg(*(F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", inline_blocks: int = INLINE_BLOCKS) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. `rules` has verdict, host, path; of equal rules block wins."""
    listed = rules.where("host is not null and path is not null").groupBy(ascii_lower("host").alias("host"), "path").agg(F.max(F.col("verdict") == "block").alias("blocks"))
    listed = listed.select(F.concat("host", "path").alias("key"), F.concat("host", "path").alias("rule"), F.when(F.col("blocks"), "block").otherwise("allow").alias("verdict"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"))
    shapes = sorted((r["labels"], r["chars"]) for r in listed.select("labels", "chars").distinct().collect())  # at most 127 labels times the longest path
    n_blocks = -(-listed.count() // KEYS_PER_BLOCK) or 1
    base = pages.select("page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shapes:
        return base.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    fits = lambda s: (F.size(F.split("host", r"\.")) >= s["labels"]) & (F.length("path") >= s["chars"]) & (F.col("host") != "")
    key = lambda s: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.substr(F.col("path"), F.lit(1), s["chars"]))
    known = F.from_json(F.lit(json.dumps([{"labels": n, "chars": c} for n, c in shapes])), "array<struct<labels:int,chars:int>>")  # one constant, however many shapes
    tried = base.withColumn("tried", F.transform(F.filter(known, fits), key))
    filled = blocks(listed, n_blocks)
    if n_blocks <= inline_blocks:
        words = {r["block"]: [r[f"w{i}"] for i in range(WORDS)] for r in filled.collect()}
        literal = [F.array(*(F.lit(words.get(b, [0] * WORDS)[i]).cast("long") for b in range(n_blocks))) for i in range(WORDS)] if n_blocks <= 64 else [F.from_json(F.lit(str([words.get(b, [0] * WORDS)[i] for b in range(n_blocks)])), "array<bigint>") for i in range(WORDS)]

        def possible(key: Column) -> Column:
            block, bits = _probes(key, n_blocks)
            found = F.lit(True)
            for word, bit in zip(literal, bits, strict=True):
                found = found & (F.element_at(word, block + 1).bitwiseAND(bit) != 0)
            return found

        probed = tried.withColumn("possible", F.filter("tried", possible))
        without = probed.where(F.size("possible") == 0)
        hits = probed.where(F.size("possible") > 0).select("page_id", "host", "path", F.size("possible").alias("n"), F.explode("possible").alias("key"))
        joined = hits.join(listed.select("key", "rule", F.col("verdict").alias("said")), "key", "left")
    else:
        without = tried.where(F.size("tried") == 0)
        each = tried.where(F.size("tried") > 0).select("page_id", "host", "path", F.size("tried").alias("n"), F.explode("tried").alias("key"))
        block, bits = _probes(F.col("key"), n_blocks)
        met = each.withColumn("block", block).join(filled, "block", "left")
        found = F.lit(True)
        for i, bit in enumerate(bits):
            found = found & (F.coalesce(F.col(f"w{i}"), F.lit(0).cast("long")).bitwiseAND(bit) != 0)
        met = met.select("page_id", "host", "path", "n", F.when(found, F.col("key")).alias("key"))
        joined = met.join(listed.select("key", "rule", F.col("verdict").alias("said")), "key", "left")
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("said") == "block").alias("blocks"), F.col("rule").alias("rule"), F.col("said").alias("said")))
    decided = joined.groupBy("page_id", "host", "path", "n").agg(best.alias("best"), F.count(F.lit(1)).alias("rows"))
    decided = decided.select("page_id", "host", "path", "best.rule", F.coalesce("best.said", F.lit(default)).alias("verdict"), F.explode(F.expr("array_repeat(1, cast(rows / n as int))")).alias("each")).drop("each")
    return without.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")).unionByName(decided)
