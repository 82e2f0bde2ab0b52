"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

The model is fitted on a bounded sample of labelled rows (SAMPLE_ROWS, and SAMPLE_TERMS features in
all); it is a vector of 2**bits weights, so what is broadcast does not grow with the data. Every
text is scored whole as a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import id_and_text
from .words import Words, mix, slices, words_of

BITS = 20
SAMPLE_ROWS = 8_000
SAMPLE_TERMS = 4_000_000
SCALE = 16.0


def features(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, word pairs and word endings of all texts: bucket and text index of each.

    A pair of equal words is one feature, whatever the word: so stuttering texts are recognised by
    words that no labelled text had.
    """
    texts, mask = words.texts(), np.uint64((1 << bits) - 1)
    single = words.hashes(4)
    pairs, inside = words.windows(single, 2, 5)
    pairs[:-1][single[1:] == single[:-1]] = 0
    tails = mix(_tail(words))
    buckets = np.concatenate([single & mask, pairs[inside] & mask, tails & mask]).astype(np.int64)
    return buckets, np.concatenate([texts, texts[inside], texts])


def _tail(words: Words) -> np.ndarray:
    """The last two bytes of each word as a number: what a word ends in, for words never seen."""
    last = words.data[words.ends - 1].astype(np.uint64)
    before = words.data[np.maximum(words.ends - 2, words.starts)].astype(np.uint64)
    return last | before << np.uint64(8) | np.uint64(1 << 20)


@dataclass
class Model:
    """Weights by bucket. A text's score is sigmoid(bias + scale * mean weight of its features)."""

    weights: np.ndarray
    bias: float
    bits: int

    def scores(self, texts: pa.Array) -> np.ndarray:
        words = words_of(texts)
        buckets, owner = features(words, self.bits)
        n = len(words.first) - 1
        total = np.bincount(owner, self.weights[buckets], n)
        count = np.maximum(np.bincount(owner, minlength=n), 1)
        return 1 / (1 + np.exp(-np.clip(self.bias + SCALE * total / count, -35, 35)))


def _samples(texts: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text with their weights: SCALE times the share of the features."""
    words = words_of(texts)
    buckets, owner = features(words, bits)
    order = np.argsort(owner, kind="stable")
    for own in np.split(buckets[order], np.cumsum(np.bincount(owner, minlength=len(words.first) - 1))[:-1]):
        kinds, counts = np.unique(own, return_counts=True)
        yield kinds, counts * (SCALE / max(len(own), 1))


class Ftrl:
    """Follow-the-regularised-leader per coordinate: z and n give the weight at any time."""

    def __init__(self, bits: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weight(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weight(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", bits: int = BITS, rows: int = SAMPLE_ROWS, terms: int = SAMPLE_TERMS, epochs: int = 4) -> Model:
    """Learns from documents that have a label 0 or 1.

    Rows without a label, or with contradicting labels, teach nothing. The sample holds the rows
    with the smallest hash of their id, at most `rows` of them and, together, `terms` distinct
    features: both bounds keep what reaches the driver small at any input size. Without any
    labelled row the model scores 0.5.
    """
    marked = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("y in (0, 1) and doc_id is not null")
    marked = marked.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("doc_id", "y")
    # ids decide before any text moves; the chosen ids number at most `rows`
    known = id_and_text(docs, key, text).select("doc_id").where("doc_id is not null").distinct()
    chosen = marked.join(known, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    schema = "doc_id long, y double, buckets array<int>, parts array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = list(_samples(batch.column("text"), bits))
            sizes = np.append(0, np.cumsum([len(k) for k, _ in got]))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([x[i] for x in got]), kind)) for i, kind in ((0, pa.int32()), (1, pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *lists], names=["doc_id", "y", "buckets", "parts"])

    taught = id_and_text(docs, key, text).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(run, schema)
    # a window over the sample only: the features before a row decide whether it still fits
    before = F.sum(F.size("buckets")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("buckets"), F.xxhash64("parts")).rowsBetween(Window.unboundedPreceding, -1))
    found = taught.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < terms)

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(bits), []
        for chunk in batches:
            ends = chunk.column("buckets").offsets.to_numpy()
            at, x = chunk.column("buckets").values.to_numpy(), chunk.column("parts").values.to_numpy()
            seen += [(at[a:b], x[a:b], y) for y, a, b in zip(chunk.column("y").to_pylist(), ends, ends[1:])]
        order = np.random.Generator(np.random.PCG64(8))
        for _ in range(epochs if seen else 0):
            for i in order.permutation(len(seen)):
                at, x, y = seen[i]
                model.learn(np.append(at, 1 << bits), np.append(x, 1).astype(np.float64), y)
        w = model.weight(np.arange((1 << bits) + 1))
        yield pa.RecordBatch.from_arrays([pa.array([w[:-1].astype("<f4").tobytes()], pa.binary()), pa.array([float(w[-1])])], names=["weights", "bias"])

    # the bounded sample is one task's work: only the weights reach the driver
    made = found.select("y", "buckets", "parts").coalesce(1).mapInArrow(learned, "weights binary, bias double").collect()
    if not made:
        return Model(np.zeros(1 << bits, np.float32), 0.0, bits)
    return Model(np.frombuffer(made[0]["weights"], "<f4"), made[0]["bias"], bits)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Adds the probability of label 1 to every row, map-side. Null and empty texts get the bias alone."""
    rest = [c for c in docs.columns if c != into]
    schema = docs.select(*rest).withColumn(into, F.lit(0.0)).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(sent.value.scores(batch.column(text)))], names=[*rest, into])

    return docs.select(*rest).mapInArrow(run, schema)
