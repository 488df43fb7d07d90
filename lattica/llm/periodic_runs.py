"""Periodic run detection: repeated k-gram masking, then Main-Lorentz over what survives.

A run is a stretch of words with smallest period q, of at least max(`least`, `times` * q) words, that no neighbouring word
extends. Shifted by q it overlaps itself in `length - q` words, at least k = min over q of max(least, times * q) - q. So
each of its words lies in a k-gram that occurs again in the document (`times` is 2 or more), and words outside
repeated k-grams can't join runs. k-grams are compared exactly, by ranks of 2, 4, 8 ... words out of the ranks of
half their length; words are masked after each doubling, and most texts end there, with nothing left.

Surviving segments are halved again and again. A run lies within a block and crosses the block's middle for exactly one of the
halvings; with period q it then holds two words q apart around the middle, so for every q up to a third (1/times) of the block
the common extensions to both sides of the places (m, m + q) and (m - q, m) give it whole. Extensions are read from
the same ranks, by halved steps, for all blocks and periods of a segment at once. They are taken within the segment, not the block,
so every stretch found is maximal; the same one found at several middles is one, and of periods of one stretch the
smallest is the run's.

A text is one task's work, n log n of its words or less; memory is some 4 bytes a word and doubling and QUERIES places at a time.
Null and empty texts have no words and no runs. Repeated rows are judged each; extra columns pass through, and those named as
results are replaced. Empty tables give empty ones.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lattica.llm.common import free_name, lean, raw, ship

LEAST, TIMES = 24, 3
#: Places compared at a time.
QUERIES = 1 << 20

RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])


def minimum_overlap(least: int, times: int) -> int:
    """Least self-overlap of a run: length - q over all periods q."""
    if times < 2 or least < 2:
        raise ValueError("runs need two periods and two words at least")
    q = least // times  # max(least, times * q) - q falls up to here and rises after
    return min(max(least, times * p) - p for p in (q, q + 1) if p)


def ranks(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, and only for them."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int32)


def _joined(rank: np.ndarray, step: int) -> np.ndarray:
    """Ranks of stretches that are made of those at i and i + step."""
    key = rank[: len(rank) - step].astype(np.int64) * (int(rank.max()) + 1) + rank[step:]
    return np.unique(key, return_inverse=True)[1].astype(np.int32)


def _covered(rank: np.ndarray, width: int, n: int) -> np.ndarray:
    """Words within a stretch of `width` words that occurs again."""
    again = np.bincount(rank)[rank] > 1
    if not again.any():
        return np.zeros(n, bool)
    change = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(again)
    change[: len(rank)] += again
    change[at + width] -= 1
    return np.cumsum(change[:n]) > 0


def segments(rank: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Stretches of at least k words that all lie in repeated k-grams."""
    n, width = len(rank), 1
    if n <= k:
        return []
    grams, covered = rank, _covered(rank, 1, n) if k == 1 else None
    while width < k:
        step = min(width, k - width)  # k may be no power of two: the last step overlaps
        grams = _joined(grams, step)
        width += step
        covered = _covered(grams, width, n)
        if not covered.any():
            return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a > k]


class Extensions:
    """Common extensions of two places of a segment, by ranks of stretches of 1, 2, 4, 8 ... words."""

    def __init__(self, rank: np.ndarray) -> None:
        self.n, self.levels = len(rank), [rank]
        while 2 << (len(self.levels) - 1) < self.n:
            self.levels.append(_joined(self.levels[-1], 1 << (len(self.levels) - 1)))

    def same(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the stretches of 2^level words at i < j lie within the segment and are equal."""
        ok = (i >= 0) & (j + (1 << level) <= self.n)
        r = self.levels[level]
        return ok & (r[np.where(ok, i, 0)] == r[np.where(ok, j, 0)])

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and j on; i < j."""
        length = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            length += self.same(level, i + length, j + length).astype(np.int64) << level
        return length

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree before i and j; i < j."""
        length = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            back = length + (1 << level)
            length += self.same(level, i - back, j - back).astype(np.int64) << level
        return length


def _middles(n: int, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Middles of blocks, and for each the largest period to try, by levels of halving."""
    low, high = np.array([0]), np.array([n])
    while len(low):
        wide = high - low >= least
        low, high = low[wide], high[wide]
        middle = (low + high) // 2
        yield middle, (high - low) // times
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])


def _runs_of_segment(rank: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of a segment."""
    extend = Extensions(rank)
    half = minimum_overlap(least, times) // 2
    quick = min(max(half, 1).bit_length() - 1, len(extend.levels) - 1)  # of the overlap around a place one side has at least half
    found = []
    for middle, most in _middles(len(rank), least, times):
        for some in np.split(np.arange(len(middle)), np.flatnonzero(np.diff(np.cumsum(most) // QUERIES)) + 1) if len(middle) else ():
            m = np.repeat(middle[some], most[some])
            q = np.arange(len(m)) - np.repeat(np.cumsum(most[some]) - most[some], most[some]) + 1
            for i in (m, m - q):
                j = i + q
                may = np.flatnonzero((i >= 0) & (j <= len(rank)) & (extend.same(quick, i, j) | extend.same(quick, i - (1 << quick), j - (1 << quick))))
                a, b, p = i[may], j[may], q[may]
                ahead, back = extend.forward(a, b), extend.backward(a, b)
                length = ahead + back + p
                ok = length >= np.maximum(least, times * p)
                found.append(np.stack([(a - back)[ok], length[ok], p[ok]], axis=1))
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)  # a stretch's smallest period
    return rows[first]


def runs_of(rank: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a text given by its words' ranks, by start, then period."""
    out = []
    for a, b in segments(rank, minimum_overlap(least, times)):
        out += [(s + a, n, q) for s, n, q in _runs_of_segment(rank[a:b], least, times).tolist()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared exactly; then the first, then that of the smallest period."""
    best = None
    for s, n, q in runs:
        if best is None or (d := n * best[2] - best[1] * q) > 0 or d == 0 and (s, q) < (best[0], best[2]):
            best = (s, n, q)
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        change[s + q] += 1
        change[s + n] -= 1
    gone = np.cumsum(change) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=False) if not g]


def _detect(docs: DataFrame, text: str, new: list[StructField], row: Callable, keep: list[str]) -> DataFrame:
    schema = StructType([docs.schema[c] for c in keep] + new)
    arrow = to_arrow_schema(schema)

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist() if "doc_id" in keep else [None] * len(b)
            found = [row(i, t.split()) for i, t in zip(ids, raw(b.column(len(keep))), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), *(pa.array([f[k] for f in found], arrow.field(len(keep) + k).type) for k in range(len(new)))], schema=arrow)

    return docs.select(*(docs[f"`{c}`"] for c in keep), docs[f"`{text}`"]).mapInArrow(lean(detect), schema)


def detected(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Adds `runs` (array of start, length, period in words) and replaces the text by the one without repeated periods, its words joined by one space.

    A text without runs stays as it is.
    """
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != text and c.lower() != "runs"]
    minimum_overlap(least, times)

    def row(_, words: list[bytes]) -> tuple:
        runs = runs_of(ranks(words), least, times) if len(words) >= least else []
        return [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(collapsed(words, runs)).decode() if runs else None

    was = free_name(docs, "text_before")
    now = free_name(docs, "text_after")
    found = _detect(docs.withColumn(was, docs[f"`{text}`"]), text, [StructField("runs", ArrayType(RUN)), StructField(now, StringType())], row, [*keep, was])
    return found.select(*(found[f"`{c}`"] for c in keep), F.coalesce(now, was).alias(text), "runs")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a period written into every tenth document, as the registered query asks for."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[: n - a]


DIGEST = [StructField("n_runs", LongType()), *(StructField(n, LongType()) for n in ("start", "length", "period", "exponent_milli")), StructField("runs_sha256", StringType()), StructField("collapsed_sha256", StringType())]


def digest(doc_id: int | None, words: list[bytes]) -> tuple:
    words = planted(doc_id, words)
    runs = runs_of(ranks(words)) if len(words) >= LEAST else []
    best = strongest(runs)
    s, n, q = best or (None, None, None)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return len(runs), s, n, q, best and 1000 * n // q, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()


def report(docs: DataFrame) -> DataFrame:
    """Per document the runs' digest, as the registered query asks for; periods are planted into every tenth document."""
    ship(docs.sparkSession)
    return _detect(docs.select("doc_id", "text"), "text", DIGEST, digest, ["doc_id"])
