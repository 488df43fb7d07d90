"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

Words are runs of letters, of digits or of other signs. Features are hashed single words, hashed
word pairs, and pairs of word shapes (capitals, signs, digits and so on); a pair of a word with
itself is one feature of its own. A text's vector holds each feature's share of the text, so a
score is the mean of its features' weights: a sparse dot product.

The model is fitted on at most `rows` labelled documents outside the held-out fold, whole and of
bounded bytes together (see `labelled.sample`), streamed in the
order of their id hashes through one task, which follows the regularised leader coordinate by
coordinate. All documents are scored, each whole. Null and empty texts have no features and get the
bias. Without any label the score is 0.5. Repeated rows are scored each; extra columns pass through
`scored`, and its result columns replace those of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lattica.llm.common import lean, raw, ship
from lattica.llm.labelled import remainder, sample

BITS = 18
SAMPLE_ROWS = 8_000
EPOCHS = 3
#: A weight's vector entry for a feature that all of a text would have.
SCALE = 20.0
ALPHA, BETA, L1, L2 = 0.2, 1.0, 0.02, 0.1
REMEMBERED = 400_000

_WORD = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
_MASK = np.uint64((1 << BITS) - 1)
_SAME = np.uint64(0x51ED270B_12345671)


class _Words(dict):
    """Hash of a word, its shape in the three lowest bits."""

    def __missing__(self, word: bytes) -> int:
        first = word[:1]
        if first.isdigit():
            shape = 0
        elif not (first.isalpha() or first >= b"\x80"):
            shape = 1 if len(word) == 1 else 2
        elif len(word) > 1 and word.isupper():
            shape = 3
        elif first.isupper():
            shape = 4
        else:
            shape = 5 if word.islower() or first >= b"\x80" else 6
        value = xxhash.xxh3_64_intdigest(word.lower()) & ~7 | shape
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def features(data: bytes, words: _Words) -> np.ndarray:
    """Feature numbers, one for each occurrence."""
    found = _WORD.findall(data)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return np.zeros(0, np.int64)
    shape, h = h & np.uint64(7), h >> np.uint64(3)
    single = _mix(h) & _MASK
    pair = _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    pair[h[:-1] == h[1:]] = _SAME
    shapes = _mix(shape[:-1] * np.uint64(8) + shape[1:] + np.uint64(77))
    return np.concatenate([single, pair & _MASK, shapes & _MASK]).astype(np.int64)


def train(fitted_on: DataFrame, epochs: int = EPOCHS) -> tuple[float, np.ndarray]:
    """Bias and weights; from order, label and text."""
    ship(fitted_on.sparkSession)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, examples = _Words(), []
        for b in batches:
            for y, data in zip(b.column("label").to_pylist(), raw(b.column("text")), strict=True):
                f = features(data, words)
                at, n = np.unique(f, return_counts=True)
                examples.append((y, at.astype(np.int32), (n * (SCALE / max(1, len(f)))).astype(np.float32)))
        z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

        def weights(i):
            return np.where(np.abs(z[i]) <= L1, 0.0, (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

        bias = np.array([1 << BITS], np.int32)
        for _ in range(epochs if examples else 0):
            for y, at, x in examples:
                i, v = np.concatenate([at, bias]), np.concatenate([x, [1.0]])
                w = weights(i)
                p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
                g = (p - y) * v
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
                n[i] += g * g
        yield pa.record_batch({"weights": pa.array([weights(np.arange(len(z))).astype(np.float32).tobytes()], pa.binary())})

    one = fitted_on.repartition(1).sortWithinPartitions("order", "label", "text").select("label", "text")  # bounded rows
    found = one.mapInArrow(lean(follow), "weights binary").collect()
    w = np.frombuffer(found[0]["weights"], np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)
    return float(w[-1]), w[:-1]


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Adds score (likelihood of label 1) and predicted; text isn't returned."""
    spark = docs.sparkSession
    bias, weights = train(sample(docs, labels, label, folds, held_out, rows))
    model = spark.sparkContext.broadcast((bias, weights))  # 1 MB
    new = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    keep = [c for c in docs.columns if c != "text" and c.lower() not in ("score", "predicted")]
    schema = StructType([docs.schema[c] for c in keep] + new)
    arrow = to_arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bias, weights), words = model.value, _Words()
        for b in batches:
            out = []
            for data in raw(b.column("text")):
                f = features(data, words)
                out.append(bias + SCALE * float(weights[f].mean(dtype=np.float64)) if len(f) else bias)
            p = 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -35, 35)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema=arrow)

    return docs.select(*(docs[f"`{c}`"] for c in [*keep, "text"])).mapInArrow(lean(score), schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


__all__ = ["features", "report", "sample", "scored", "train"]
