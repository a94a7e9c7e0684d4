"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text (present or not): words, word pairs, and pairs that skip one or two words,
hashed to 2^20 places.  Training follows the FTRL-proximal rule: every coordinate has its own rate
from its squared gradients, and L1 keeps all but the telling coordinates at exactly zero, so the
model is a short list of (place, weight) that is broadcast.

The fit reads a bounded sample of labelled rows: at most ``PER_CLASS`` doc_ids of each label, the smallest
by hash.  Their texts train in shards of about ``SHARD_BYTES`` (at that bound usually one), each over
whole texts in one task that holds its features; the shards' weights are averaged by their rows.  Scoring is one narrow
pass over all documents.

Defined cases: null or empty text has only the bias; texts of any length are used whole; rows without a label do not train; a doc_id
labelled more than once counts as toxic if any label says so; repeated rows of a labelled doc_id each train, and each are scored, alike; ties in the
order of training fall to (doc_id, text); other columns are not read, so none can clash; without any label of either class the
model is empty and every score is 0.5; an empty table gives no rows.

:func:`toxicity` fits the model when it is called.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import byte_slices, crc_col, cut, id_text, mixed, plain_words, word_hashes

BITS = 20
PER_CLASS = 6000
EPOCHS = 6
SHARD_BYTES = 64 << 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 1.0


def places(text: str) -> np.ndarray:
    """Hashed features of a text, with repeats."""
    h = word_hashes(plain_words(text))
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    parts = [mixed(h)]
    for gap in (1, 2, 3):
        if len(h) > gap:
            parts.append(mixed(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(gap)))
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """The last coordinate is the bias, which is not thinned."""

    def __init__(self, size: int = 1 << BITS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(np.unique(at).astype(np.int64), len(self.z) - 1)
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.n)
        w = self.weights(at)
        return at[w != 0], w[w != 0]


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def sample_ids(labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, label) of the bounded sample."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col("toxic") >= 1, 1).otherwise(0)).alias("label"))
    )
    order = F.xxhash64("doc_id")
    one = lambda c: known.where(F.col("label") == c).orderBy(order, "doc_id").limit(per_class)
    return one(0).unionByName(one(1))


def fit(docs: DataFrame, labels: DataFrame, learns: Column | None = None, per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights.  ``learns``: condition on doc_id for a labelled row to be used."""
    if learns is not None:
        labels = labels.where(learns)
    sample = sample_ids(labels, per_class)
    rows = id_text(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    rows = cut(rows)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    dealt = rows.repartition(shards).sortWithinPartitions(F.xxhash64("doc_id", F.lit(1)), "doc_id", "text")

    def train(batches):
        features, ends, marks = [], [0], []
        for ids, texts, labels_ in ((b.column(0), b.column(1), b.column(2)) for b in batches):
            for text, y in zip(texts.to_pylist(), labels_.to_pylist()):
                features.append(np.unique(places(text)).astype(np.uint32))
                ends.append(ends[-1] + len(features[-1]))
                marks.append(y)
        if len(set(marks)) < 2:
            return
        flat = np.concatenate(features)
        del features
        model = Ftrl()
        for _ in range(EPOCHS):
            for a, b, y in zip(ends[:-1], ends[1:], marks):
                model.learn(flat[a:b], y)
        at, w = model.sparse()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w * len(marks))], names=["place", "weight"])
        # how many rows this shard trained on, once
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([float(len(marks))])], names=["place", "weight"])

    got = {r["place"]: r["weight"] for r in dealt.mapInArrow(train, "place long, weight double").groupBy("place").agg(F.sum("weight").alias("weight")).collect()}
    trained = got.pop(-1, 1.0)
    at = np.array(sorted(got), dtype=np.int64)
    return at, np.array([got[k] / trained for k in at.tolist()])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches):
        at, w = shared.value
        dense = np.zeros((1 << BITS) + 1)
        dense[at] = w
        bias = dense[-1]
        for ids, texts in byte_slices(batches):
            out = []
            for text in texts:
                own = places(text)
                own = np.unique(own[dense[own] != 0])
                out.append(sigmoid(bias + dense[own].sum()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return id_text(docs).mapInArrow(go, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from rows with crc32(doc_id) mod 3 not 1."""
    rest = crc_col(F.col("doc_id").cast("long")) % 3
    model = fit(docs, labels, rest != 1)
    return score(docs, model).select("doc_id", (rest == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
