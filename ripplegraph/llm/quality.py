"""Supervised quality classifier on subword embeddings.

A text is the mean of the learned vectors of its words and of the character n-grams in them, all hashed into one
table; a linear layer and a softmax give the class probabilities. Vectors and layer are trained together by
stochastic gradient descent in numpy on the driver, over the whole texts of a bounded sample of labelled rows
(MAX_ROWS). As the mean and the layer are linear, scoring first multiplies the vectors by the layer: then each
feature has one number, and a text's score is the logistic function of their mean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, code_points, mix, owner, remainder, run_hashes, runs, spaces, table, text_or_empty

BUCKETS = 1 << 18
DIM, EPOCHS, RATE, SEED = 12, 6, 0.6, 7
MAX_ROWS = 4000  #: labelled texts that are learned from at most
GRAMS = (3, 4)
LAGS = 6  #: a word like the one so many places before gives a feature of its own: vectors of repetition
CONSTANT = 8  #: times the constant feature counts, so that a few words alone don't decide


def features(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts, and the index of the text of each. Every text has the constant feature, bucket 0."""
    codes, starts = code_points(texts)
    gap = spaces()[codes]
    c = np.where(gap, 0, codes).astype(np.uint64)
    begin, end = runs(~gap)
    word, text = run_hashes(codes, begin, end), owner(begin, starts)
    out = [np.zeros(CONSTANT * len(texts), np.int64), (word % np.uint64(buckets - LAGS - 1)).astype(np.int64) + LAGS + 1]
    of = [np.repeat(np.arange(len(texts)), CONSTANT), text]
    for k in range(1, LAGS + 1):
        same = np.flatnonzero((word[k:] == word[:-k]) & (text[k:] == text[:-k])) + k
        out.append(np.full(len(same), k))
        of.append(text[same])
    for n in GRAMS:  # windows whose inner characters are no white space; the outer ones may be word borders
        size = max(0, len(c) - n + 1)
        inner = np.ones(size, np.bool_)
        for k in range(1, n - 1):
            inner &= c[k : size + k] != 0
        at = np.flatnonzero(inner)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[at + k]
        out.append((mix(h) % np.uint64(buckets - LAGS - 1)).astype(np.int64) + LAGS + 1)
        of.append(owner(at + 1, starts))
    return np.concatenate(out), np.concatenate(of)


def train(texts: list[str], labels: np.ndarray, seed: int = SEED, epochs: int = EPOCHS) -> np.ndarray:
    """The weight of each feature for label 1 against label 0."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = np.zeros((DIM, 2), np.float32)
    bags = []
    for t in texts:
        ids, count = np.unique(features([t])[0], return_counts=True)
        bags.append((ids, (count / count.sum()).astype(np.float32)))
    steps, total = 0, max(1, epochs * len(texts))
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            ids, share = bags[i]
            rate = np.float32(RATE * (1 - steps / total))
            steps += 1
            own = vectors[ids]
            hidden = share @ own
            z = hidden @ layer
            e = np.exp(z - z.max())
            error = e / e.sum()
            error[labels[i]] -= 1
            back = layer @ error
            layer -= rate * np.outer(hidden, error)
            vectors[ids] = own - rate * share[:, None] * back
    return vectors @ (layer[:, 1] - layer[:, 0])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Learn from labelled rows: at most max_rows labels of 0 or 1, chosen by a hash of the id.

    The chosen ids (a bounded number) are broadcast to find their texts in one scan; these come to the driver.
    Without any labelled text every score is 0.5.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    some = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    got = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(some), "id").select("id", "text", "label").toArrow().to_pandas()
    got = got.sort_values(["id", "text"])
    return train(got["text"].tolist(), got["label"].to_numpy())


def scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    ids, text = features(texts, len(weights))
    total = np.bincount(text, weights[ids], len(texts))
    return 1 / (1 + np.exp(-total / np.bincount(text, minlength=len(texts))))


def scorer(spark: SparkSession, weights: np.ndarray):
    """A function of a text column: the probability of label 1. Null and empty texts have the same score, that of the constant feature."""
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = [scores(part, shared.value) for part in chunks([t or "" for t in texts.to_pylist()])]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return score


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores at least the threshold, with the columns of docs."""
    score = scorer(docs.sparkSession, fit(docs, labels.filter(remainder(F.col("doc_id"), 3) != 1)))
    return docs.filter(score(F.col("text").cast("string")) >= threshold)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    score = scorer(spark, fit(docs, labels.filter(remainder(F.col("doc_id"), 3) != 1)))
    out = docs.select("doc_id", held.alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
