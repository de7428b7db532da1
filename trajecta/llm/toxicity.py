"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed n-grams of characters, digits and punctuation included. Each is scaled by the
log ratio of its smoothed shares among toxic and other texts, and a logistic regression is trained on the scaled features. Only the n-grams that
tell the classes apart best are kept, so a text's score is a sum over few table hits.

N-grams are counted in all labelled training texts, in a distributed aggregate; its result is bounded by the buckets.
The regression uses a bounded sample, ``per_class`` texts of each label, as sparse vectors that stay on the executors: L-BFGS
sums gradients there and stops by tolerance. The driver holds what is as long as the features. The intercept is set for
the labels' real frequencies.

Defined results: a null or empty text has no n-grams and gets the intercept's score; without both labels every
score is the share of label 1 (0.5 if nothing is labelled); labels other than 0 and 1, and null ids, are not used; repeated rows
count each; an id that is labelled both ways counts for both labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.llm.features import VISIBLE, ngrams, sample_per_class
from trajecta.llm.shared import crc_of_id, map_arrow, materialise, slices, texts

#: The longest hold most word stems.
SIZES = (3, 5, 7)
BITS = 22
PER_CLASS = 2500
FEATURES = 40_000
#: Buckets that a task's counts are sent together for.
RANGE = 1 << 16
#: Texts that an n-gram must be in to be a feature.
LEAST_TEXTS = 4
#: The regression's penalty, tolerance and most steps.
RIDGE, TOLERANCE, STEPS = 1e-5, 1e-6, 200
#: Features on each side that give a weight to one that isn't in the sample.
NEAR = 100


def distinct(bucket: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique((text << BITS) | bucket)
    return keys & ((1 << BITS) - 1), keys >> BITS


def packed(counts: np.ndarray) -> bytes:
    """Byte planes of counts, of which most are 0 or small."""
    return pa.compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def count(found: DataFrame) -> DataFrame:
    """``bucket, n0, n1``: texts of each label by n-gram, of rows with ``text`` and ``label``; buckets in LEAST_TEXTS texts or more. Bucket -1 has
    all texts. A task sends its counts as compressed ranges of buckets, so the shuffle grows with tasks and not with n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_of, last, rows = np.zeros((2, 1 << BITS), np.int32), np.empty(1 << BITS, np.int32), np.zeros(2, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", 500_000):
                for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    bucket, _ = ngrams([text], SIZES, BITS, VISIBLE)
                    place = np.arange(len(bucket), dtype=np.int32)
                    last[bucket] = place
                    texts_of[label, bucket[last[bucket] == place]] += 1
                    rows[label] += 1
        if rows.any():
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([packed(rows[k : k + 1])]) for k in (0, 1))], names=["range", "n0", "n1"])
            for start in range(0, 1 << BITS, RANGE):
                some = texts_of[:, start : start + RANGE]
                yield pa.RecordBatch.from_arrays([pa.array([start // RANGE], pa.int32()), *(pa.array([packed(some[k])]) for k in (0, 1))], names=["range", "n0", "n1"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, None

        def result():
            if at is not None:
                some = np.flatnonzero(sums.sum(0) >= (LEAST_TEXTS if at >= 0 else 0))
                yield pa.RecordBatch.from_arrays([pa.array((some + at * RANGE if at >= 0 else some - 1).astype(np.int32)), *(pa.array(sums[k, some]) for k in (0, 1))], names=["bucket", "n0", "n1"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["range"] != at:
                    yield from result()
                    at, sums = r["range"], np.zeros((2, RANGE if r["range"] >= 0 else 1), np.int64)
                for k in (0, 1):
                    sums[k] += unpacked(r[f"n{k}"], sums.shape[1])
        yield from result()

    sent = map_arrow(found.select("label", "text"), run, "range int, n0 binary, n1 binary")
    return materialise(map_arrow(sent.repartition("range").sortWithinPartitions("range"), add, "bucket int, n0 long, n1 long"), "toxicity-counts")


def choose(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, log ratios) of the features: the n-grams of the largest ratio times difference of shares."""
    total = counts.where("bucket < 0").first()
    if total is None or not total.n0 or not total.n1:
        return np.empty(0, np.int64), np.empty(0)
    p, q = ((F.col(f"n{k}") + 0.5) / (total[f"n{k}"] + 1) for k in (1, 0))
    ratio = F.log(p / q)
    best = counts.where("bucket >= 0").select("bucket", ratio.alias("ratio"), (F.abs(ratio) * F.abs(p - q)).alias("gain")).where("gain > 0").orderBy(F.desc("gain"), "bucket").limit(FEATURES)
    got = best.select("bucket", "ratio").toArrow()
    bucket, ratio = got.column("bucket").to_numpy().astype(np.int64), got.column("ratio").to_numpy()
    order = np.argsort(bucket)
    return bucket[order], ratio[order]


def filled(weights: np.ndarray, ratio: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Weights in which features that no sampled text has get the mean weight of those next to them in ratio."""
    order = np.flatnonzero(seen)[np.argsort(ratio[seen], kind="stable")]
    if not len(order):
        return weights
    sums, place = np.concatenate([[0], np.cumsum(weights[order])]), np.searchsorted(ratio[order], ratio[~seen])
    low, high = np.clip(place - NEAR, 0, max(0, len(order) - NEAR)), np.clip(place + NEAR, min(NEAR, len(order)), len(order))
    out = weights.copy()
    out[~seen] = np.maximum((sums[high] - sums[low]) / (high - low), 0)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Learns from the labelled rows; rows whose crc32(id) mod 5 is 0 are left out."""
    usable = labels.where(F.col(label_col).isin(0, 1) & (crc_of_id(id_col) % 5 != 0))
    counts = {r[0]: r[1] for r in usable.groupBy(label_col).count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    none = (np.empty(0, np.int64), np.empty(0))
    if not counts.get(0) or not counts.get(1):
        return *none, {0.0: -20.0, 1.0: 20.0}.get(share, 0.0)
    rows = texts(docs, id_col, text_col)
    labelled = usable.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).distinct()
    # labels grow with the texts, so they are dealt by id, not broadcast
    training = rows.where(crc_of_id() % 5 != 0).join(labelled.hint("shuffle_hash"), "doc_id").select("label", "text")
    chosen, scale = choose(count(training))
    if not len(chosen):
        return *none, math.log(share / (1 - share))
    sample = sample_per_class(usable, label_col, per_class, id_col)
    vectors = materialise(scaled(rows.join(F.broadcast(sample), "doc_id"), chosen, scale), "toxicity-sample")
    n0, n1 = (vectors.where(F.col("label") == k).count() for k in (0, 1))
    if not n0 or not n1:
        return *none, math.log(share / (1 - share))
    balanced = vectors.withColumn("weight", F.when(F.col("label") == 1, 0.5 / n1).otherwise(0.5 / n0))
    regression = LogisticRegression(weightCol="weight", regParam=RIDGE, tol=TOLERANCE, maxIter=STEPS, standardization=False).fit(balanced)
    weights = regression.coefficients.toArray()
    return chosen, filled(weights, scale, weights != 0) * scale, regression.intercept + math.log(share / (1 - share))


def scaled(rows: DataFrame, chosen: np.ndarray, scale: np.ndarray) -> DataFrame:
    """``label, features`` of rows with ``label, text``: sparse vectors of the log ratios of the features that a text has."""
    shared = rows.sparkSession.sparkContext.broadcast((chosen, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, scale = shared.value
        number = np.full(1 << BITS, -1, np.int32)
        number[chosen] = np.arange(len(chosen))
        for whole in batches:
            for batch in slices(whole, "text", 500_000):
                found = []
                for text in batch.column("text").to_pylist():
                    column = number[ngrams([text], SIZES, BITS, VISIBLE)[0]]
                    found.append(np.unique(column[column >= 0]))
                flat = np.concatenate(found)
                edges = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32())
                n = len(found)
                vector = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, len(chosen), np.int32)), pa.ListArray.from_arrays(edges, pa.array(flat, pa.int32())), pa.ListArray.from_arrays(edges, pa.array(scale[flat]))]
                features = pa.StructArray.from_arrays(vector, names=["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.float64()), features], names=["label", "features"])

    return map_arrow(rows.select("label", "text"), run, T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())]))


def score(docs: DataFrame, id_col: str, text_col: str, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """``doc_id, score`` of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, weights, intercept = shared.value
        number = np.full(1 << BITS, -1, np.int32)
        number[chosen] = np.arange(len(chosen))
        for whole in batches:
            for batch in slices(whole, "text", 1_000_000):
                bucket, text = ngrams(batch.column("text").to_pylist(), SIZES, BITS, VISIBLE)
                hit = number[bucket] >= 0
                bucket, text = distinct(bucket[hit], text[hit])
                z = np.bincount(text, weights[number[bucket]], batch.num_rows) + intercept
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], names=["doc_id", "score"])

    rows = texts(docs, id_col, text_col)
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted``. Rows whose crc32(id) mod 5 is 0 are held out of training."""
    model = fit(docs, labels, id_col, text_col, label_col, per_class)
    return score(docs, id_col, text_col, model).select(
        "doc_id", F.coalesce(crc_of_id() % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
