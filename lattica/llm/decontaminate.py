"""Benchmark decontamination with a generalised suffix automaton.

The automaton over the words of all normalised items recognises every word sequence that occurs
in any item. Each document's words are streamed through it once; the length of the longest suffix
that is still an item's passage says where windows end. Items of at least `window` words have one
window at each of their words; shorter ones are a window as a whole.

The items are a benchmark's, not the corpus: the automaton of `BLOCK_WORDS` item words is sent to
the executors, and more items make more blocks, each of them one pass, whose spans are united.
Documents never shuffle within a block.

Null or empty documents and items have no words: no window lies in them. Repeated items count by
their item_id once. Items without an id hit words but are not named. Repeated documents are judged
each. Extra columns pass through, and those whose names clash with a result are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lattica.llm.common import lean, raw, ship

#: Item words in one automaton: about 200 bytes each, so at most some 100 MB in a worker.
BLOCK_WORDS = 500_000

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Lower-cased words: digits, a-z and whatever isn't ASCII."""
    return data.translate(_FOLD).split()


class ItemAutomaton:
    """Generalised suffix automaton over word numbers; states say which windows end there."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]) for name, words in items if words]
        for _, t in texts:
            last = 0
            for w in t:
                last = self._extend(last, w)
        #: for each state that holds a window's length, the shortest state of its suffixes that still does
        self.holder = list(range(len(self.next)))
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            if up > 0 and self.length[up] >= window:
                self.holder[s] = self.holder[up]
        #: items whose window of the full length is the state's sequence of that length; those that are the state's as a whole
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        for name, t in texts:
            for state, length in self._windows(t):
                found = self.full.setdefault(state, set()) if length == window else self.short.setdefault(state, {}).setdefault(length, set())
                if name is not None:
                    found.add(name)
        self._short_above: dict[int, list[tuple[int, set[str]]]] = {}

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def _windows(self, t: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of each window of an item."""
        size = min(self.window, len(t))
        state = 0
        for i, w in enumerate(t):
            state = self.next[state][w]
            if size == self.window:
                if i + 1 >= size:
                    yield self.holder[state], size
            elif i + 1 == size:  # a short item as a whole
                at = state
                while self.length[self.link[at]] >= size:
                    at = self.link[at]
                yield at, size

    def _shorts(self, state: int) -> list[tuple[int, set[str]]]:
        """Short items that end where a match of this state ends."""
        found = self._short_above.get(state)
        if found is None:
            found, at = [], state
            while at > 0:
                if at in self.short:
                    found += self.short[at].items()
                at = self.link[at]
            self._short_above[state] = found
        return found

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [start, end) of word places under occurring windows, in order and disjoint; the items."""
        if not self.vocabulary:
            return [], set()
        spans: list[list[int]] = []
        items: set[str] = set()
        size, nxt, link, length, shorts = self.window, self.next, self.link, self.length, bool(self.short)
        state = matched = 0
        named = -1
        for i, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                state = matched = 0
                continue
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(w)
            if to is None:
                matched = 0
                continue
            state, matched = to, matched + 1
            best = 0
            if matched >= size:
                at = self.holder[state]
                if at in self.full:
                    best = size
                    if at != named:  # a passage that repeats itself names its items once
                        items |= self.full[at]
                        named = at
            if shorts:
                for n, names in self._shorts(state):
                    if n <= matched:
                        best = max(best, n)
                        items |= names
            if best:
                start = i + 1 - best
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = i + 1
                else:
                    spans.append([start, i + 1])
        return [(a, b) for a, b in spans], items


def blocks_of(items: DataFrame, item_id: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items in blocks of at most so many words (or one item); the driver holds one block at a time."""
    block, held = [], 0
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null")
    for r in rows.toLocalIterator(prefetchPartitions=False):
        words = words_of(r["t"].encode())
        if block and held + len(words) > block_words:
            yield block
            block, held = [], 0
        block.append((r["i"], words))
        held += len(words)
    yield block


def hits(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds n_words, span_starts and span_ends (word places, half-open) and items (ids, sorted) to every row."""
    spark = docs.sparkSession
    ship(spark)
    out = None
    for block in blocks_of(items, block_words=block_words):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))
        before = out is not None
        frame = out if before else docs
        out = _pass(frame, shared, window, text, before)
    return out


_built: dict[tuple[str, int], ItemAutomaton] = {}


def automaton_of(shared, window: int) -> ItemAutomaton:
    """The worker's automaton of a block, built by the first task that needs it."""
    key = (shared.value[0], window)
    if key not in _built:
        _built.clear()  # blocks follow one another
        _built[key] = ItemAutomaton(shared.value[1], window)
    return _built[key]


def _pass(docs: DataFrame, shared, window: int, text: str, before: bool) -> DataFrame:
    new = [StructField("n_words", LongType()), StructField("span_starts", ArrayType(IntegerType())), StructField("span_ends", ArrayType(IntegerType())), StructField("items", ArrayType(StringType()))]
    names = {f.name.lower() for f in new}
    keep = [c for c in docs.columns if c.lower() not in names]
    schema = StructType([docs.schema[c] for c in keep] + new)
    arrow = to_arrow_schema(schema)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(shared, window)
        for b in batches:
            n, starts, ends, found = [], [], [], []
            for k, data in enumerate(raw(b.column(text))):
                words = words_of(data)
                spans, items = automaton.match(words)
                if before:
                    spans = united(spans + list(zip(b.column("span_starts")[k].as_py(), b.column("span_ends")[k].as_py(), strict=True)))
                    items = items | set(b.column("items")[k].as_py())
                n.append(len(words))
                starts.append([s for s, _ in spans])
                ends.append([e for _, e in spans])
                found.append(sorted(items))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), *(pa.array(x, t.type) for x, t in zip((starts, ends, found), list(arrow)[-3:], strict=True))], schema=arrow)

    return docs.mapInArrow(lean(matched), schema)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    h = hits(docs.select("doc_id", "text"), items, window)
    n_hit = F.aggregate(F.zip_with("span_starts", "span_ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return h.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("span_starts") > 0).alias("contaminated"))


def without_spans(docs: DataFrame, items: DataFrame, window: int = 10, coverage: float = 0.5, text: str = "text") -> DataFrame:
    """Removes hit passages from each text; rows of which more than `coverage` of the words are hit go as a whole.

    A passage goes with the bytes between its first and last word. Rows without hits keep their text
    byte for byte, null stays null. Only the columns of `docs` are returned.
    """
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != text)).alias("row"), docs[f"`{text}`"].alias("text"))
    h = hits(packed, items, window)
    hit = F.aggregate(F.zip_with("span_starts", "span_ends", lambda a, b: b - a), F.lit(0), lambda s, x: s + x)
    schema = StructType([packed.schema["row"], packed.schema["text"]])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            starts, ends = b.column("span_starts").to_pylist(), b.column("span_ends").to_pylist()
            for k, (s, e) in enumerate(zip(starts, ends, strict=True)):
                if s:
                    texts[k] = cut_words(texts[k].encode(), s, e).decode()
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, arrow.field("text").type)], schema=arrow)

    done = h.where(hit <= F.col("n_words") * coverage).mapInArrow(lean(cut), schema)
    return done.select(*(F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns))


def cut_words(data: bytes, starts: list[int], ends: list[int]) -> bytes:
    folded = np.frombuffer(data.translate(_FOLD), np.uint8)
    inside = np.concatenate([[False], ~np.isin(folded, [0x20]), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[0::2], edges[1::2]
    out, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        out.append(data[at : first[s]])
        at = last[e - 1]
    return b"".join([*out, data[at:]])
