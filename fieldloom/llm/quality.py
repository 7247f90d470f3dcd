"""Quality classifier by supervised subword embeddings (operator 6).

Every word and its character n-grams have learnt vectors in hashed buckets, and
so has the pair of a word with itself. A document is the average of all these
vectors, and a softmax
layer turns it into the probability of each label. Vectors and layer are trained
by numpy stochastic gradient descent on a sample of labelled rows; ``bound`` caps
that sample (rows; ``common.SAMPLE_BYTES`` caps its text). For scoring, the layer is folded into the vectors, so that each
distinct word has one number, which workers remember; whole texts are scored.

Null and empty texts have no words and get the share of label 1 in the sample.
Without labelled rows every score is 0.5. Repeated rows score alike; a null doc_id counts as not held out;
an empty table gives an empty result; other columns are ignored, whatever their names. What a
worker remembers is bounded, so very long texts are scored whole in pieces.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled_sample, remainder, strings, table

BUCKETS, DIM, SHORT, LONG = 1 << 17, 8, 2, 4
BOUND, EPOCHS, RATE, THRESHOLD = 4000, 6, 0.5, 0.7


#: The bucket of the pair "a word and the same word again", the one word bigram that is kept whatever the word, and its weight.
SAME, SAME_WEIGHT = 0, 8


def features(word: str) -> list[int]:
    """The buckets of a word and of its character n-grams."""
    raw = f"<{word}>".encode("utf-8", "replace")
    # where characters begin, and the end
    at = range(len(raw) + 1) if raw.isascii() else [i for i, b in enumerate(raw) if b & 0xC0 != 0x80] + [len(raw)]
    hashed = [zlib.crc32(raw[i:j]) % BUCKETS for n in range(SHORT, LONG + 1) for i, j in zip(at, at[n:])]
    return [zlib.crc32(raw, 7) % BUCKETS, *hashed]


def _document(text: str, known) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    again = SAME_WEIGHT * sum(map(operator.eq, words, words[1:]))
    buckets, counts = np.unique(np.concatenate([known(w) for w in words] + [np.full(again, SAME)]), return_counts=True)
    return buckets, (counts / counts.sum()).astype(np.float32)


class Model:
    """One number for each bucket: its vector through the softmax layer (label 1 against label 0)."""

    def __init__(self, weights: np.ndarray, bias: float, prior: float):
        self.weights, self.bias, self.prior = weights, bias, prior


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    y = np.array([r[1] for r in rows], np.int64)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Model(np.zeros(BUCKETS, np.float32), math.log(p / (1 - p)), p)
    known = lru_cache(maxsize=200_000)(lambda w: np.array(features(w), np.int32))
    docs = [_document(r[0], known) for r in rows]
    known.cache_clear()
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            lr = rate * (1 - done / steps)
            done += 1
            buckets, shares = docs[i]
            if not len(buckets):
                continue
            own = vectors[buckets]
            hidden = shares @ own
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ layer
            layer -= lr * np.outer(p, hidden)
            bias -= 0.1 * lr * p
            # an average of many vectors moves each by little: the step is by the document, not by its length
            vectors[buckets] = own - (lr * len(buckets) ** 0.5) * shares[:, None] * back
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]), prior)


class Scorer(dict):
    """A word -> its place in two arrays: the sum over its buckets, and their number."""

    def __init__(self, model: Model, cache: int = 300_000):
        super().__init__()
        self.of, self.cache, self.model = model.weights.tolist(), cache, model
        self.sums, self.sizes = np.zeros(cache + 1), np.zeros(cache + 1)
        self.old: tuple[dict[str, int], np.ndarray, np.ndarray] = ({}, self.sums, self.sizes)

    def _turn(self) -> None:
        """Begin a new generation; the last one stays in reach, so that frequent words are not hashed again."""
        self.old = (dict(self), self.sums, self.sizes)
        self.sums, self.sizes = np.zeros(self.cache + 1), np.zeros(self.cache + 1)
        self.clear()

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        known = self.old[0].get(word)
        if known is not None:
            self.sums[k], self.sizes[k] = self.old[1][known], self.old[2][known]
            return k
        own = features(word)
        self.sums[k], self.sizes[k] = sum(map(self.of.__getitem__, own)), len(own)
        return k

    def score(self, text: str) -> float:
        words = text.split()
        if not words:
            return self.model.prior
        size = float(SAME_WEIGHT * sum(map(operator.eq, words, words[1:])))
        total = size * self.of[SAME]
        for lo in range(0, len(words), 100_000):
            if len(self) + 100_000 > self.cache:
                self._turn()
            k = np.fromiter(map(self.__getitem__, words[lo : lo + 100_000]), np.int64)
            total, size = total + self.sums[k].sum(), size + self.sizes[k].sum()
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total / size + self.model.bias))))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # half a MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value)
        for batch in batches:
            scores = [own.score(t.as_py()) for t in strings(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns, that score at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t.as_py()) >= threshold for t in strings(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(run, schema)


def quality_model(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    return train(labelled_sample(docs, labels, "quality", remainder("doc_id", 4) != 2, bound))


def op6_quality(spark: SparkSession, sf_dir: str, bound: int = BOUND) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, quality_model(docs, table(spark, sf_dir, "labels"), bound))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
