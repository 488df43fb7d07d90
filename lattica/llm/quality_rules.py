"""Quality rules by host: counts of a text's words, a verdict of the text alone, and one of its host.

A text fails the base rules if it has too few words or repeats too much of itself. Failures are then added up
by host. Hosts differ in how often they fail by chance and by nature; the latter is estimated over all hosts as a
beta prior, by moments: its mean is the pooled rate, its strength what is left of the rates' spread once
binomial chance is taken off. A host's rate is shrunk to that prior, so a host of two failing texts isn't condemned and one
of thousands is. A host is refused if the shrunk rate, less `deviations` standard deviations of its beta
posterior, is still above both the limit and the prior's mean; where hosts don't differ beyond chance, none is.
The host's verdict is joined back to its documents: a refused host's texts go even if they pass the base rules.

Counts of texts are made once and written (five numbers and the host a row). Sums are formed before the shuffle, so a host of a third of all rows
costs no more than others. Only refused hosts are joined, broadcast up to BROADCAST_HOSTS of them as counted and by a shuffle beyond.

Null texts have no words; null hosts aren't added up and refuse nothing. Repeated rows count each. Extra columns pass through `judged`,
and those named as its results are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from lattica.llm.common import free_name, lean, raw, ship, written

#: Words of a window whose repetition counts.
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Refused hosts up to which their names are broadcast.
BROADCAST_HOSTS = 200_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules and of a host's shrunk rate of failures."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_host_rate: float = 0.5
    deviations: float = 3.0


def ranks(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, and only for them."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def doubled(rank: np.ndarray, step: int) -> np.ndarray:
    """Ranks of stretches of 2 * step words out of those of step words."""
    return np.unique(rank[:-step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1]


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more; `window` is a power of two."""
    if len(words) <= window:
        return 0
    rank, size = ranks(words), 1
    while size < window:
        rank = doubled(rank, size)
        size *= 2
        again = np.bincount(rank)[rank] > 1
        if not again.any():
            return 0
    change = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return int((np.cumsum(change) > 0).sum())


def counts_of(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line and not line.isspace():
            seen.add(line)
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), again, repeated(words)


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; `text` isn't returned."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != text and c.lower() not in COUNTS]
    schema = StructType([docs.schema[c] for c in keep] + [StructField(c, LongType()) for c in COUNTS])
    arrow = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [counts_of(t) for t in raw(b.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), *(pa.array([f[k] for f in found], pa.int64()) for k in range(len(COUNTS)))], schema=arrow)

    return docs.select(*(docs[f"`{c}`"] for c in keep), docs[f"`{text}`"]).mapInArrow(lean(count), schema)


def host_rates(judged_alone: DataFrame, host: str, rules: Rules = Rules()) -> DataFrame:
    """A row for each host: n_docs, n_failed, rate (shrunk) and refused.

    Moments over hosts of n documents and f failures, with m the pooled rate: the beta prior of mean m has the strength s for
    which the expected sum of n * (f/n - m)^2 equals the observed one,

        sum n (f/n - m)^2 = m (1 - m) (H + (N - H) / (s + 1)),

    H hosts and N documents. Without spread beyond chance s is infinite and every rate is m.
    """
    own = judged_alone.where(F.col(f"`{host}`").isNotNull()).groupBy(F.col(f"`{host}`").alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    pooled = own.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("h"), F.sum(f * f / n).alias("squares")).first()
    docs, failed, hosts = float(pooled["n"] or 0), float(pooled["f"] or 0), float(pooled["h"])
    mean = failed / docs if docs else 0.0
    chance = mean * (1 - mean)
    beyond = (pooled["squares"] - docs * mean * mean) / chance - hosts if chance else 0.0
    if beyond <= 0 or docs <= hosts:  # hosts don't differ beyond chance
        rate, refused = F.lit(mean), F.lit(False)
    else:
        strength = max((docs - hosts) / beyond - 1, 0.0)
        rate = (f + F.lit(mean * strength)) / (n + F.lit(strength))
        deviation = F.sqrt(rate * (F.lit(1.0) - rate) / (n + F.lit(strength + 1)))
        refused = rate - F.lit(rules.deviations) * deviation > F.lit(max(rules.max_host_rate, mean))
    return own.select("host", "n_docs", "n_failed", rate.alias("rate"), refused.alias("refused"))


def judged(docs: DataFrame, host: str = "source", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Adds the counts, base_failed, host_refused and kept; `text` isn't returned."""
    mine = ("base_failed", "host_refused", "kept")
    counts = counted(docs.select(*(docs[f"`{c}`"] for c in docs.columns if c.lower() not in mine or c == host)), text)
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    alone = written(counts.withColumn("base_failed", failed), "rule-counts")
    name = free_name(alone, "refused_host")
    refused = written(host_rates(alone, host, rules).where("refused").select(F.col("host").alias(name)), "refused-hosts")
    few = refused.count() <= BROADCAST_HOSTS
    met = alone.join(F.broadcast(refused) if few else refused, alone[f"`{host}`"] == F.col(name), "left")
    return met.withColumn("host_refused", F.col(name).isNotNull()).withColumn("kept", ~F.col("base_failed") & ~F.col("host_refused")).drop(name)


def report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return judged(docs.select("doc_id", "source", "text"), rules=rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_refused")
