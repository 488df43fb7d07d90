"""Token counts by prefix dynamic programming.

The count of every prefix of a text is stored, and truncation and budget questions are read from
the store. No text is encoded again for them, and none is encoded by the library at all: of the
library only the normaliser and the pre-tokenizer of the given file are used, and the counts come
from its vocabulary and merges.

A piece is what the pre-tokenizer gives to byte-pair encoding. An encoding's beginning is the
encoding of the piece's beginning, and a row of tokens is an encoding exactly when each two
neighbours are one of their own; so the last token of a prefix is the only one that ends there, is
whole by itself and goes with the last token of the prefix that it leaves:

    tokens(piece[:i]) = tokens(piece[:i - len(t)]) + 1

Tokens at a word's end differ from those within, so two columns are kept: `inner`, the prefix with
more to come, and `end`, the prefix as a whole word, whose last token follows an inner prefix.

Runs between white space add up, as white space is in no token. For a run the differences of the
counts at each code point are remembered as two-byte numbers; a text's store is its runs' differences
one after the other, and its running sum is the count at each prefix. `stored` gives it as a binary column, and `answered` reads
answers for any limits and places from that column alone.

Where characters compose, a text is cut before each that composes with nothing before it. A prefix is the normal form up to
the last such place and the little behind it: where that reads on as the whole text does, its count is the whole text's at that
place, else the columns are continued by these few characters. So every text takes time in proportion to its length, but
for a base letter with a very long row of marks of changing classes, which is normalised anew for each of them.

The file must be a byte-pair model whose pieces hold no white space; others are refused. Special
strings count one each, as the library's default has it. Null is the empty text and has no tokens;
repeated rows are counted each; extra columns pass through `count_tokens`, and a column whose name
clashes with a result is replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate, pairwise
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from lattica.llm.common import raw, ship

#: Runs and pieces that a worker remembers: two generations of so many each, some 400 bytes a pair.
REMEMBERED = 400_000
#: Longest run in code points that is remembered.
SHORT = 64
#: Code points that the pre-tokenizer looks ahead, and one more.
AHEAD = 4
#: Code points of a part of a text between places where nothing composes, beyond which marks in a row are cut by themselves.
LONG_PART = 8

_SIGNS = ".,;:!?"
_WORD = re.compile(rf"([A-Za-z]+)([{_SIGNS}]?)\Z")


def _split(text: str) -> list[str]:
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return text.split(" ")


class Remembered(dict):
    """Answers by question; when full, those not asked for lately are forgotten."""

    def __init__(self, answer, size: int = REMEMBERED, longest: int = SHORT) -> None:
        super().__init__()
        self.answer, self.size, self.longest, self.old = answer, size, longest, {}

    def __missing__(self, question):
        found = self.old.get(question)
        if found is None:
            found = self.answer(question)
            if isinstance(question, str) and len(question) > self.longest:
                return found
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[question] = found
        return found


class Merges:
    """The vocabulary and merges of a byte-pair model with, or without, a suffix of words' ends."""

    def __init__(self, model: dict) -> None:
        if model.get("type") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("not a plain byte-pair model")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in reversed(list(enumerate(model["merges"])))}
        made = {a + b: k for (a, b), k in self.rank.items()}
        if any(made.get(part, -1) >= k for pair, k in self.rank.items() for part in pair):
            raise ValueError("a merge comes before its parts")
        n = len(self.suffix)
        #: for each beginning of a token that can come out whole: 1 if it is one itself, 2 if one with the suffix
        self.begins: dict[str, int] = {}
        for t in model["vocab"]:
            if self._edges(t) is None:
                continue
            text, flag = (t[:-n], 2) if n and t.endswith(self.suffix) else (t, 1 if n else 3)
            self.begins[text] = self.begins.get(text, 0) | flag
            for k in range(1, len(text)):
                self.begins.setdefault(text[:k], 0)
        self.longest = max(map(len, self.begins), default=1)
        self.edges = Remembered(self._edges)
        #: by token, whether another one may follow it
        self.goes: dict[str, dict[str, bool]] = {}
        self.known = 0
        #: the last piece and its columns, of which the next piece takes the common beginning
        self.held = ("", [0], [""], [0])

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            inner = token[: -len(self.suffix)]
            return [*inner[:-1], inner[-1] + self.suffix]
        return list(token)

    def _edges(self, token: str) -> tuple | None:
        """A token's first and last symbol while it is joined, each with the rank of the merge that ends it; None if it isn't joined to one."""
        parts = self.symbols(token)
        first, last = [], []
        while len(parts) > 1:
            rank, k = min((self.rank.get(p, 1 << 60), k) for k, p in enumerate(pairwise(parts)))
            if rank == 1 << 60:
                return None
            if k == 0:
                first.append((parts[0], rank))
            if k == len(parts) - 2:
                last.append((parts[-1], rank))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return ([*first, (token, 1 << 60)], [*last, (token, 1 << 60)]) if parts == [token] else None

    def _goes(self, token: str, after: str) -> bool:
        """Whether two tokens stay apart: nothing joins the symbols at their border before these are joined within."""
        left, right = self.edges[token][1], self.edges[after][0]
        i = j = 0
        while True:
            (x, until), (y, also) = left[i], right[j]
            rank = self.rank.get((x, y), 1 << 60)
            if rank < until and rank <= also and rank < 1 << 60:  # of equal ranks the leftmost is joined first
                return False
            if until == also == 1 << 60:
                return True
            if until <= also:
                i += 1
            else:
                j += 1

    def _follows(self, token: str, after: str) -> bool:
        if self.known >= 4 * REMEMBERED:
            self.goes.clear()
            self.known = 0
        self.known += 1
        found = self.goes.setdefault(token, {})[after] = self._goes(token, after)
        return found

    def table(self, piece: str) -> list[int]:
        """Tokens of piece[:i] as a whole word, for every i."""
        return self.columns(piece)[2]

    def columns(self, piece: str) -> tuple[list[int], list[str], list[int]]:
        """For every i: tokens of piece[:i] with more to come, the last of them, and tokens of piece[:i] as a whole word."""
        had, count, last, end = self.held
        same = 0
        for x, y in zip(piece, had, strict=False):
            if x != y:
                break
            same += 1
        rest = len(piece) - same
        count, last, end = count[: same + 1] + [0] * rest, last[: same + 1] + [""] * rest, end[: same + 1] + [0] * rest
        if rest:
            self._fill(piece, count, last, end, same, True)
        if not all(end[1:]):
            raise ValueError(f"no token of the vocabulary ends {piece[:50]!r} or a beginning of it")
        self.held = (piece, count, last, end)
        return count, last, end

    def _fill(self, piece: str, count: list[int], last: list[str], end: list[int], same: int, whole: bool) -> None:
        """The columns behind place `same`, up to which they are known; whole: place 0 is the piece's beginning."""
        begins, goes, suffix, size = self.begins, self.goes, self.suffix, len(piece)
        for k in range(max(0, same + 1 - self.longest), size):
            if k < same:
                if piece[k : same + 1] not in begins:
                    continue
                i = same
            else:
                i = k
            opens = whole and not k
            before, n = last[k], count[k] + 1
            if not before and not opens:
                raise ValueError(f"no token of the vocabulary ends {piece[:k]!r}")
            after = goes.get(before) or {}
            while i < size:
                i += 1
                part = piece[k:i]
                flags = begins.get(part)
                if flags is None:
                    break
                if flags & 1 and not last[i]:
                    may = True if opens else after.get(part)
                    if may is None:
                        may = self._follows(before, part)
                    if may:
                        last[i], count[i] = part, n
                if flags & 2 and not end[i]:
                    text = part + suffix
                    may = True if opens else after.get(text)
                    if may is None:
                        may = self._follows(before, text)
                    if may:
                        end[i] = n

    def extended(self, piece: str, count: list[int], last: list[str], at: int, more: str) -> int:
        """Tokens of piece[:at] + more as a whole word, out of the piece's columns: only tokens that end in `more` are looked for."""
        low = max(0, at - self.longest)
        text, same, rest = piece[low:at] + more, at - low, len(more)
        own, ends = count[low : at + 1] + [0] * rest, [0] * (same + 1 + rest)
        self._fill(text, own, last[low : at + 1] + [""] * rest, ends, same, not low)
        if not ends[-1]:
            raise ValueError(f"no token of the vocabulary ends {text[-50:]!r}")
        return ends[-1]


class RunCounter:
    """Differences of the counts at each code point, by run between white space."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.file = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(self.file["model"])
        special = sorted((t["content"] for t in self.file.get("added_tokens", [])), key=len, reverse=True)
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in self.file.get("added_tokens", [])):
            raise ValueError("special strings of this kind aren't counted")
        if [p for p, _ in self._cut("a b c.  d")] != [p for x in ("a", "b", "c.", "d") for p, _ in self._cut(x)]:
            raise ValueError("pieces of this file hold white space")
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        letters = "".join(map(chr, (*range(65, 91), *range(97, 123))))
        self.plain = self._normal(letters) == letters.lower() and all([p for p, _ in self._cut(letters.lower() + c)] == [letters.lower(), c] and self._normal(c) == c for c in _SIGNS) and not any(s[0] in _SIGNS or s[0].isalpha() for s in special)
        self.simple = Remembered(self._simple)
        self.mapped = Remembered(self._map)
        self.pieces = Remembered(self._piece)
        self.runs = Remembered(self._run)
        self.normals = Remembered(self._normal)
        self.wholes = Remembered(self._whole, longest=2 * SHORT)
        if any(x != y and (x in y or any(x.endswith(y[:k]) for k in range(1, min(len(x), len(y))))) for x in special for y in special):
            raise ValueError("special strings that share signs aren't counted")

    def _cut(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(text) if self.tokenizer.pre_tokenizer else [(text, (0, len(text)))]

    def _normal(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def _simple(self, c: str) -> str | None:
        """The normalised character, if it is one and doesn't depend on its neighbours."""
        if unicodedata.category(c)[0] == "M" or "ᄀ" <= c <= "ᇿ":
            return None
        out = self._normal(c)
        return out if len(out) == 1 else None

    def _map(self, c: str) -> str:
        """What byte-pair encoding gets for a character."""
        return "".join(p for p, _ in self._cut(c))

    def _piece(self, piece: str) -> bytes | tuple[int, ...]:
        """Counts at each code point of a piece of the normalised text, from the first on."""
        parts = [self.mapped[c] for c in piece]
        end = self.merges.table("".join(parts))
        counts = end[1:] if len(end) == len(piece) + 1 else [end[k] for k in accumulate(map(len, parts))]
        if 1 < len(piece) <= AHEAD and not piece.isalpha() and any(c.isalnum() for c in piece):  # a contraction, whose beginning reads otherwise
            counts = [n if k == len(piece) or len(cut := self._cut(piece[:k])) == 1 else sum(self.merges.table(p)[-1] for p, _ in cut) for k, n in enumerate(counts, 1)]
        return bytes(counts) if max(counts, default=0) < 256 else tuple(counts)

    def _whole(self, text: str) -> int:
        """Tokens of normalised text."""
        return sum(self.pieces[text[a:b]][-1] if b - a else 0 for _, (a, b) in self._cut(text))

    def _counts(self, run: str) -> list[int]:
        """The count at each code point of a run, from the first on."""
        if self.plain and (m := _WORD.match(run)):  # letters, and a sign behind them
            out = [*self.pieces[m[1].lower()]]
            return [*out, out[-1] + self.pieces[m[2]][0]] if m[2] else out
        norm = [self.simple[c] for c in run]
        if None in norm or self.special and self.special.search(run):
            return self._uneven(run)
        text, out, before = "".join(norm), [], 0
        for _, (a, b) in self._cut(text):
            out += [before] * (a - len(out))
            counts = self.pieces[text[a:b]]
            out += [before + n for n in counts]
            before = out[-1]
        return out + [before] * (len(text) - len(out))

    def _uneven(self, run: str) -> list[int]:
        """As _counts, where characters compose or special strings occur: between special strings by _composed, and 1 for each of them."""
        out, base, at = [], 0, 0
        for m in self.special.finditer(run) if self.special else ():
            counts = self._composed(run[at : m.end() - 1])  # a special string's beginning is ordinary text
            out += [base + n for n in counts]
            base += (counts[m.start() - at - 1] if m.start() > at else 0) + 1
            out.append(base)
            at = m.end()
        return out + [base + n for n in self._composed(run[at:])]

    def _places(self, text: str) -> list[int]:
        """Where a text can be cut so that its parts' normal forms follow each other: before what composes with nothing before it.

        Of many marks in a row, all of one class, those after one that stays as it is stay, too, and are cut, so that a part is short.
        """
        places = [k for k, c in enumerate(text) if not k or not (unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff")]
        more = []
        for a, b in pairwise([*places, len(text)]):
            if b - a <= LONG_PART:
                continue
            kind, k = unicodedata.combining(text[b - 1]), b
            while kind and k > a + 1 and unicodedata.combining(text[k - 1]) == kind and self._normal(text[k - 1]) == text[k - 1]:
                k -= 1
            if b - k > 3 and self._normal(text[a : k + 2])[-1:] == text[k + 1] and self._normal(text[a : k + 3])[-2:] == text[k + 1 : k + 3]:
                more += range(k + 2, b)
        return sorted([*places, *more]) if more else places

    def _composed(self, text: str) -> list[int]:
        """Counts at each code point of ordinary text: a prefix is the normal form up to the last place before it, and the little behind that."""
        if not text:
            return []
        places = [*self._places(text), len(text)]
        parts = [self.normals[text[a:b]] for a, b in pairwise(places)]
        norm = "".join(parts)
        if re.sub(" +", " ", norm) != self._normal(text):
            raise ValueError(f"a text whose parts compose: {text[:50]!r}")
        cuts = [span for _, span in self._cut(norm)]
        at, before = [0], 0
        for a, b in cuts:
            at += [before] * (a + 1 - len(at))
            at += [before + n for n in self.pieces[norm[a:b]]]
            before = at[-1]
        at += [before] * (len(norm) + 1 - len(at))
        ends, wide, out, x = [b for _, b in cuts], {}, [], 0
        for (a, b), part in zip(pairwise(places), parts, strict=True):
            for n in range(a + 1, b):
                tail = self.normals[text[a:n]]
                out.append(at[x + len(tail)] if part.startswith(tail) else self._spliced(norm, x, tail, cuts, ends, at, wide))
            x += len(part)
            out.append(at[x])
        return out

    def _spliced(self, norm: str, x: int, tail: str, cuts: list[tuple[int, int]], ends: list[int], at: list[int], wide: dict) -> int:
        """Tokens of norm[:x] + tail: pieces that end AHEAD before x stay, a long one that doesn't is continued from its columns."""
        k = bisect_right(ends, x - AHEAD)
        start = min(cuts[k][0], x) if k < len(cuts) else x
        if x - start <= SHORT:
            return at[start] + self.wholes[norm[start:x] + tail]
        near = x - SHORT // 2
        while near > start and norm[near] == "'":  # else it might begin a contraction
            near -= 1
        context = norm[near:x] + tail
        (_, (_, stop)), *rest = self._cut(context)
        behind = sum(self.pieces[context[a:b]][-1] for _, (a, b) in rest)
        if near + stop <= x:
            return at[near + stop] + behind
        if k not in wide:
            maps = [self.mapped[c] for c in norm[start : cuts[k][1]]]
            piece = "".join(maps)
            count, last, _ = self.merges.columns(piece)
            wide[k] = piece, count, last, [0, *accumulate(map(len, maps))]
        piece, count, last, offset = wide[k]
        return at[start] + self.merges.extended(piece, count, last, offset[x - start], "".join(self.mapped[c] for c in context[x - near : stop])) + behind

    def _run(self, run: str) -> bytes:
        counts = self._counts(run)
        return array("h", map(sub, counts, [0, *counts[:-1]])).tobytes()

    def prepare(self, texts: list[list[str]]) -> None:
        """Answers for the short runs of many texts, in an order in which one piece's columns begin like the last one's."""
        new: set[str] = set()
        for runs in texts:
            new.update([run for run in set(runs) if run not in self.runs])
        for run in sorted((r for r in new if len(r) <= SHORT), key=str.lower):
            self.runs[run]  # noqa: B018

    def differences(self, runs: list[str]) -> np.ndarray:
        """What each code point of a text, given by its runs, adds to the count."""
        return np.frombuffer(b"\0\0".join(map(self.runs.__getitem__, runs)), np.int16)


_counters: dict[str, RunCounter] = {}


def counter_of(path: str) -> RunCounter:
    """The worker's counter, which later tasks find as earlier ones left it."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = RunCounter(path)
    return _counters[path]


class PrefixTable:
    """Exact token counts at every prefix of one text."""

    def __init__(self, text: str | list[str], counter: RunCounter) -> None:
        """Of a text, or of the runs that it was split into."""
        self._sum(counter.differences(_split(text) if isinstance(text, str) else text))

    def _sum(self, differences: np.ndarray) -> None:
        self.counts = np.zeros(len(differences) + 1, np.int64)
        np.cumsum(differences, dtype=np.int64, out=self.counts[1:])

    @classmethod
    def of_store(cls, store: bytes) -> PrefixTable:
        """Of a text's stored differences."""
        out = cls.__new__(cls)
        out._sum(np.frombuffer(store, "<i2"))
        return out

    def at(self, chars: int) -> int:
        """Tokens of the first `chars` code points."""
        return int(self.counts[min(chars, len(self.counts) - 1)])

    def fit(self, limit: int) -> int:
        """Code points of the longest prefix of at most `limit` tokens; none for a negative limit."""
        found = np.flatnonzero(self.counts <= limit)
        return int(found[-1]) if len(found) else 0

    def between(self, start: int, end: int) -> int:
        """Tokens of text[start:end] where both places are at white space."""
        return self.at(end) - self.at(start)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens, over_limit and fit_chars, the code points of the longest prefix within the limit.

    `text` isn't returned; the other columns are. `tokenizer_path` is read on the executors, so it
    must name the same file on each of them, as an installed vocabulary does.
    """
    ship(docs.sparkSession)
    new = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType()), StructField("fit_chars", IntegerType())]
    names = {f.name.lower() for f in new}
    keep = [c for c in docs.columns if c != text and c.lower() not in names]
    schema = StructType([docs.schema[c] for c in keep] + new)
    arrow = to_arrow_schema(schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer_path)
        for b in batches:
            texts = raw(b.column(text))
            runs = [_split(x.decode()) for x in texts]
            counter.prepare(runs)
            tokens, fits = [], []
            for r in runs:
                table = PrefixTable(r, counter)
                tokens.append(int(table.counts[-1]))
                fits.append(table.fit(limit))
            n_bytes = [len(x) for x in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(fits, pa.int32())], schema=arrow)

    return docs.select(*(docs[f"`{c}`"] for c in keep), docs[f"`{text}`"]).mapInArrow(counted, schema)


def stored(docs: DataFrame, tokenizer_path: str, text: str = "text", store: str = "prefix_counts") -> DataFrame:
    """Adds the store: a binary column of two bytes a code point, what each adds to the count (little-endian, signed). `text` and the other columns stay."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c.lower() != store.lower()]
    schema = StructType([docs.schema[c] for c in keep] + [StructField(store, BinaryType())])
    arrow = to_arrow_schema(schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer_path)
        for b in batches:
            runs = [_split(x.decode()) for x in raw(b.column(text))]
            counter.prepare(runs)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([counter.differences(r).astype("<i2").tobytes() for r in runs], pa.binary())], schema=arrow)

    return docs.select(*(docs[f"`{c}`"] for c in keep)).mapInArrow(counted, schema)


def answered(counts: DataFrame, limits: Sequence[int] = (), places: Sequence[int] = (), spans: Sequence[tuple[int, int]] = (), store: str = "prefix_counts") -> DataFrame:
    """Answers read from the store alone, for any limits and places; neither text nor tokenizer is needed.

    Adds n_tokens; fit_<limit>, the code points of the longest prefix of at most so many tokens; at_<place>, the tokens of so many
    code points; between_<start>_<end>, the tokens that the code points from start to end add. A null store is that of an empty text.
    """
    ship(counts.sparkSession)
    new = ["n_tokens", *(f"fit_{n}" for n in limits), *(f"at_{n}" for n in places), *(f"between_{a}_{b}" for a, b in spans)]
    keep = [c for c in counts.columns if c.lower() not in new]
    schema = StructType([counts.schema[c] for c in keep] + [StructField(c, LongType()) for c in new])
    arrow = to_arrow_schema(schema)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tables = [PrefixTable.of_store(x or b"") for x in b.column(store).to_pylist()]
            columns = [[int(t.counts[-1]) for t in tables], *([t.fit(n) for t in tables] for n in limits), *([t.at(n) for t in tables] for n in places), *([t.between(*s) for t in tables] for s in spans)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in columns)], schema=arrow)

    return counts.select(*(counts[f"`{c}`"] for c in dict.fromkeys([*keep, store]))).mapInArrow(answer, schema)
