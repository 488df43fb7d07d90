"""Toxicity by class-conditional Kneser-Ney models.

Two models of word pairs, one of toxic and one of ordinary labelled documents, over the vocabulary
of words that at least `MIN_DOCS` of the sampled documents of a class hold; all other words are one
unknown word. In both, a pair backs off to its word in the class, a word to what both classes have
of it together, and this to its continuation count, the number of different words that it follows in
all documents, labelled or not. The last two are shared by the classes:

    P(w | v, class) = kept(v w) / n(v) + (1 - kept(v) / n(v)) P(w | class)
    P(w | class)    = kept(w) / n + (1 - kept / n) P(w)
    P(w)            = (both(w) - DISCOUNT) / both + the discounts' share of continuation(w)

The classes' counts are continuation counts, too: the documents that hold a word or pair, but once
for all that have the same two words before it, so that neither repetition within a document nor
copies and passages that many share are evidence. Of a count only that is kept which chance doesn't give: it is discounted by what the class would have of both
classes' count together, and `DEVIATIONS` deviations from it. So expressions that are
rare, or equally frequent in both classes, are left to the shared counts, and drop out of the ratio.

A document's measure is its log-likelihood under the toxic model less that under the ordinary one,
divided by its words. A logistic curve of this one number, through labelled documents that the
models haven't seen, makes it a score.

The class models are fitted on at most `rows` labelled documents (see `labelled.sample`) outside the
held-out fold, a fifth of them kept for the curve. Continuation counts, and scores, cover all
documents, each whole. Null and empty texts are measured as one unknown word. Without labels of both
classes every score is 0. Repeated rows are scored each; extra columns pass through, those with a
result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lattica.llm.common import forget, lean, ship, written
from lattica.llm.labelled import remainder, sample
from lattica.llm.ngram_join import word_hashes

#: Deviations from the expected count that chance is allowed.
DEVIATIONS = 4.0
DISCOUNT = 1.0
MIN_DOCS = 3
SAMPLE_ROWS = 12_000
#: The curve's numbers for measures times 100: keeps its slope near 1.
PERCENT = 100.0
CLASSES = ("toxic", "ordinary")
#: Word numbers take so many bits of a packed pair; 0 is the unknown word.
BITS = 26
#: Stands for any first word.
ANY = (1 << BITS) - 1

_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_FOLD).split()


def numbers(text: str | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(vocabulary.get, words, repeat(0)), np.int64, len(words))


def pairs(ids: np.ndarray) -> np.ndarray:
    """Each word packed with the one before it; the first follows the unknown word."""
    return np.concatenate([[0], ids[:-1]]) << BITS | ids


class Lookup:
    """Numbers by packed key, in open-addressed arrays; keys that aren't held give nan."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            trying = left[free]
            _, first = np.unique(slot[trying], return_index=True)
            put = trying[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            placed = np.zeros(len(keys), bool)
            placed[put] = True
            left = left[~placed[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = self.values[slot]
        wrong = np.flatnonzero(held != keys)
        out[wrong] = np.nan
        wrong = wrong[held[wrong] != -1]
        at = slot[wrong]
        while len(wrong):
            at = (at + 1) & ((1 << self.bits) - 1)
            held = self.keys[at]
            hit = held == keys[wrong]
            out[wrong[hit]] = self.values[at[hit]]
            go = ~hit & (held != -1)
            wrong, at = wrong[go], at[go]
        return out


def word_counts(fitted_on: DataFrame) -> DataFrame:
    """word, toxic, ordinary: labelled documents that hold it."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):  # a worker holds the words of so many texts
                part, found = b.slice(at, 100), {}
                for y, t in zip(part.column("label").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for w in set(words_of(t)):
                        found.setdefault(w, [0, 0])[y] += 1
                yield pa.record_batch([pa.array(found, pa.binary()), pa.array([n[1] for n in found.values()], pa.int64()), pa.array([n[0] for n in found.values()], pa.int64())], names=["word", "toxic", "ordinary"])

    return fitted_on.select("label", "text").mapInArrow(lean(counted), "word binary, toxic long, ordinary long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def contexts_of(text: str | None) -> np.ndarray:
    """A hash of the two words before each word."""
    h = word_hashes((text or "").lower().encode().translate(_FOLD))
    before = np.concatenate([np.zeros(2, np.uint64), h])[: len(h) + 1]
    return ((before[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ before[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def one_each(keys: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of a document, each with the least of its contexts."""
    order = np.lexsort((contexts, keys))
    keys, contexts = keys[order], contexts[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    return keys[first], contexts[first]


def class_counts(fitted_on: DataFrame, vocabulary) -> DataFrame:
    """pair, toxic, ordinary: of words (pairs whose first word is ANY) and pairs, the different contexts that they have in labelled documents, one for a document."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, t in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids, where = numbers(t, vocabulary.value), contexts_of(t)
                found = one_each(np.concatenate([ids | ANY << BITS, pairs(ids)]), np.concatenate([where, where]))
                yield pa.record_batch([pa.array(np.full(len(found[0]), y, np.int32)), *map(pa.array, found)], names=["label", "pair", "context"])

    different = fitted_on.select("label", "text").mapInArrow(lean(seen), "label int, pair long, context long").distinct()
    return different.groupBy("pair").agg(F.sum("label").cast("long").alias("toxic"), F.count_if(F.col("label") == 0).alias("ordinary"))


def different(had: np.ndarray, more: list[np.ndarray]) -> np.ndarray:
    """The different numbers of all arrays, sorted in place."""
    every = np.concatenate([had, *more])
    every.sort()
    return every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every


def continuations(docs: DataFrame, vocabulary) -> DataFrame:
    """w, n: the different words that a vocabulary word follows, in all documents."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had, held, n = np.zeros(0, np.int64), [], 0
        for b in batches:
            for t in b.column("text").to_pylist():
                p = pairs(numbers(t, vocabulary.value))
                held.append(p[(p & ((1 << BITS) - 1)) > 0])
                n += len(p)
                if n > 700_000:
                    had, held, n = different(had, held), [], 0
                    if len(had) > 1_500_000:
                        yield pa.record_batch([pa.array(had)], names=["pair"])
                        had = np.zeros(0, np.int64)
        yield pa.record_batch([pa.array(different(had, held))], names=["pair"])

    distinct = docs.select("text").mapInArrow(lean(seen), StructType([StructField("pair", LongType())])).repartition("pair").distinct()  # tasks gave each pair once: nothing to sum before the shuffle
    return distinct.groupBy(_last_of("pair").alias("w")).agg(F.count(F.lit(1)).alias("n"))


def kept(n, expected, sqrt=np.sqrt, most=np.maximum):
    """What a count is more than chance gives."""
    return most(n - expected - DEVIATIONS * sqrt(expected + 1.0), 0.0)


class Models:
    """Log ratios toxic to ordinary: of words, of contexts whose pair neither class keeps, and of kept pairs."""

    def __init__(self, n: int, words, contexts, pair_rows, following) -> None:
        """words: w and the classes' counts; contexts: v, n(v) and kept(v) by class; pair_rows: pair and what is kept by class; following: w, n."""
        shared = np.full(n, 0.5)
        shared[following["w"].to_numpy()] = following["n"].to_numpy()
        shared /= shared.sum()
        total = {c: max(float(words[c].sum()), 1.0) for c in CLASSES}
        both = (words["toxic"] + words["ordinary"]).to_numpy() / sum(total.values())
        less = np.zeros(n)
        less[words["w"].to_numpy()] = np.maximum(both - DISCOUNT / sum(total.values()), 0)
        shared = less + (1 - less.sum()) * shared
        chance, weight, seen = {}, {}, {}
        for c in CLASSES:
            own = np.zeros(n)
            own[words["w"].to_numpy()] = kept(words[c].to_numpy(), both * total[c])
            own[0] = 0
            chance[c] = (own + (total[c] - own.sum()) * shared) / total[c]
            seen[c], used = np.zeros(n), np.zeros(n)
            seen[c][contexts["v"].to_numpy()] = contexts[c].to_numpy()
            used[contexts["v"].to_numpy()] = contexts[f"{c}_kept"].to_numpy()
            weight[c] = 1 - used / np.maximum(seen[c], 1)
        self.word = np.log(chance["toxic"] / chance["ordinary"])
        self.context = np.log(weight["toxic"] / weight["ordinary"])
        key = pair_rows["pair"].to_numpy().astype(np.int64)
        v, w = key >> BITS, key & ((1 << BITS) - 1)
        p = {c: pair_rows[c].to_numpy() / np.maximum(seen[c][v], 1) + weight[c][v] * chance[c][w] for c in CLASSES}
        self.pair = Lookup(key, np.log(p["toxic"] / p["ordinary"]))

    def measure(self, ids: np.ndarray) -> float:
        """The text's log ratio a word."""
        if not len(ids):
            return float(self.word[0])
        r = self.word[ids]
        r[1:] += self.context[ids[:-1]]
        r[0] += self.context[0]
        of_pair = self.pair.get(pairs(ids))
        has = ~np.isnan(of_pair)
        r[has] = of_pair[has]
        return float(r.mean())


def _first_of(pair: str):
    return F.shiftright(pair, BITS)


def _last_of(pair: str):
    return F.col(pair).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))


def _kept_pairs(both: DataFrame, contexts: DataFrame) -> DataFrame:
    """v, and pair with what each class keeps of it, of the pairs of which a class keeps any."""
    joined = both.withColumn("v", _first_of("pair")).join(contexts.select("v", *(F.col(c).alias(f"{c}_all") for c in CLASSES)), "v")
    share = (F.col("toxic") + F.col("ordinary")) / (F.col("toxic_all") + F.col("ordinary_all"))
    rest = [kept(F.col(c), share * F.col(f"{c}_all"), F.sqrt, lambda x, least: F.greatest(x, F.lit(least))).alias(c) for c in CLASSES]
    return joined.where(_last_of("pair") > 0).select("v", "pair", *rest).where("toxic > 0 OR ordinary > 0")


def fit(chosen: DataFrame, docs: DataFrame):
    """Vocabulary and models, sent to the executors: both bounded by the sample; None without both classes."""
    spark = docs.sparkSession
    counts = written(word_counts(chosen), "words")
    rest = counts.agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).first().asDict()
    if not rest["toxic"] or not rest["ordinary"]:
        forget(counts)
        return None
    known = counts.where((F.col("toxic") >= MIN_DOCS) | (F.col("ordinary") >= MIN_DOCS)).select("word").orderBy("word").toArrow().to_pandas()
    vocabulary = spark.sparkContext.broadcast({bytes(w): i for i, w in enumerate(known["word"], 1)})
    found = written(class_counts(chosen, vocabulary), "pairs")
    words = found.where(_first_of("pair") == ANY).select(_last_of("pair").alias("w"), *CLASSES).orderBy("w").toArrow().to_pandas()  # a row for each word at most
    both = found.where(_first_of("pair") != ANY)
    of_context = both.groupBy(_first_of("pair").alias("v")).agg(*(F.sum(c).alias(c) for c in CLASSES))
    over = written(_kept_pairs(both, of_context), "over")
    used = over.groupBy("v").agg(*(F.sum(c).alias(f"{c}_kept") for c in CLASSES))
    contexts = of_context.join(used, "v", "left").na.fill(0.0).toArrow().to_pandas()  # a row for each word at most
    rows = over.orderBy("pair").toArrow().to_pandas()  # of the sample's pairs those that a class has beyond chance
    following = continuations(docs, vocabulary).toArrow().to_pandas()
    for t in (counts, found, over):
        forget(t)
    return spark.sparkContext.broadcast((vocabulary.value, Models(len(known) + 1, words, contexts, rows, following)))


def curve(y: np.ndarray, x: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, lightly regularised."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(2)
    keep = np.array([1e-2, 1e-4])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9), x.T @ (p - y) + keep * w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _measured(docs: DataFrame, model, keep: str) -> DataFrame:
    """Column keep, and the measure of column text; the text itself isn't returned."""
    schema = StructType([docs.schema[keep], StructField("measure", DoubleType())])
    arrow = to_arrow_schema(schema)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, models = model.value
        for b in batches:
            texts = b.column("text") if "text" in b.schema.names else b.column(keep).field("text")
            x = [models.measure(numbers(t.as_py(), vocabulary)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array(x, pa.float64())], schema=arrow)

    return docs.mapInArrow(lean(take), schema)


def _scored(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """row, the document, and score."""
    ship(docs.sparkSession)
    chosen = written(sample(docs, labels, label, folds, held_out, rows), "sample")
    fold = F.pmod("order", F.lit(5))
    model = fit(chosen.where(fold != 0), docs)
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    if model is None:
        forget(chosen)
        return packed.withColumn("score", F.lit(0.0))
    seen = _measured(chosen.where(fold == 0).select("label", "text"), model, "label").orderBy("label", "measure").toArrow().to_pandas()
    slope, offset = curve(seen["label"].to_numpy(float), seen["measure"].to_numpy() * PERCENT) if seen["label"].nunique() == 2 else (1.0, -1.0)
    forget(chosen)
    odds = F.col("measure") * (slope * PERCENT) + offset
    return _measured(packed, model, "row").select("row", (F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))).alias("score"))


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents with score (likelihood of label 1) and predicted; see the module's docstring."""
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    out = _scored(docs, labels, label, folds, held_out, rows)
    return out.select(*(F.col(f"row.`{c}`") for c in keep), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score under the threshold, with their own columns alone."""
    out = _scored(docs, labels, "toxic", 5, 0, SAMPLE_ROWS)
    return out.where(F.col("score") < threshold).select(*(F.col(f"row.`{c}`") for c in docs.columns))


__all__ = ["Lookup", "Models", "report", "scored", "without_toxic"]
