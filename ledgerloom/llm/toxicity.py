"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct runs of 3 to 6 characters (UTF-8 bytes; A-Z lower-cased, other ASCII but letters as one
space, so that runs see where words begin), hashed into 2**20 buckets. A bucket's ratio is
log((p / |p|) / (q / |q|)), p and q being its smoothed counts in toxic and other training texts. Buckets in fewer than
``MIN_TEXTS`` training texts, or with a ratio near zero, are left out. A logistic regression with L2 penalty is fitted
to the features times their ratios; its product with the ratios is one weight for each bucket.

Training reads at most about ``sample`` labelled rows, dealt by a hash of doc_id, in tasks (of a doc_id with several texts
all different ones count, and are dealt by a hash where they would be more than that); the table of ratios and the
weights hold 2**20 entries at most. Scoring reads every whole text, null as empty (its score is the intercept's).
A doc_id labelled several times is toxic if any label says so; null labels and null doc_ids are no training rows. With
no toxic or no other training row all scores are the share of toxic rows (0 without rows). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._arrays import long_lists, mix, slices
from ._spark import chosen, clean_text, fresh, materialize

#: Labelled rows that a classifier is fitted to, about.
SAMPLE = 12_000
BUCKETS = 1 << 20
ORDERS = (3, 4, 5, 6)
MIN_TEXTS = 3
MIN_RATIO = 1.0
SMOOTHING = 1.0
PENALTY = 0.5
STEPS = 200
#: Weight of a toxic training row against another's.
TOXIC_WEIGHT = 3.0


def _codes() -> np.ndarray:
    table = np.full(256, ord(" "), dtype=np.uint8)
    for c in range(128):
        if chr(c).isalpha():
            table[c] = ord(chr(c).lower())
    table[128:] = np.arange(128, 256)
    return table


def buckets(data: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of one text's n-grams; of ``known`` ones only, where given."""
    text = _codes()[data]
    if len(text) > 1:  # one space for several
        text = text[np.concatenate(([True], (text[1:] != 32) | (text[:-1] != 32)))]
    text = np.concatenate((np.full(1, 32, np.uint8), text, np.full(1, 32, np.uint8))).astype(np.uint64)
    out, run = [], text.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(run) < 2:
            break
        run = (run[:-1] << np.uint64(8)) | text[n - 1 :]
        if n in ORDERS:
            found = (mix(run + np.uint64(n << 56)) >> np.uint64(44)).astype(np.int32)
            out.append(found if known is None else found[known[found]])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.int32)


def each_text(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, offsets in slices(column):
        for a, b in zip(offsets[:-1], offsets[1:]):
            yield data[a:b]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), each_text(batch.column("text"))):
            both[label, buckets(text)] += 1
    used = np.flatnonzero(both.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(both[1, used]), pa.array(both[0, used])], ["bucket", "toxic", "other"])


def _select(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value != 0
        for batch in batches:
            rows = [buckets(t, known) for t in each_text(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), long_lists(rows, pa.int32())], ["label", "buckets"])

    return run


def fit_logistic(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (of buckets, ratios included) and intercept, by accelerated gradient steps over all rows."""
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, dtype=np.int32)
    used, column = np.unique(flat, return_inverse=True)
    value, owner, n = ratios[used][column].astype(np.float64), np.repeat(np.arange(len(rows)), sizes), len(rows)
    times = lambda w: np.bincount(owner, weights=value * w[column], minlength=n)
    back = lambda g: np.bincount(column, weights=value * g[owner], minlength=len(used))
    v = np.ones(len(used))
    for _ in range(8):  # the largest curvature
        v = back(times(v)) + 1e-12
        largest = np.linalg.norm(v)
        v /= largest
    weight = np.where(labels > 0, TOXIC_WEIGHT, 1.0)
    step = 1 / (0.25 * TOXIC_WEIGHT * (largest + n) + PENALTY)
    w, b = np.zeros(len(used)), float(np.log((labels.mean() + 1e-6) / (1 - labels.mean() + 1e-6)))
    w0, b0 = w, b
    for k in range(STEPS):
        ww, bb = w + k / (k + 3) * (w - w0), b + k / (k + 3) * (b - b0)
        g = weight * (1 / (1 + np.exp(-np.clip(times(ww) + bb, -30, 30))) - labels)
        w0, b0 = w, b
        w, b = ww - step * (back(g) + PENALTY * ww), bb - step * 4 * g.sum()
    out = np.zeros(BUCKETS, dtype=np.float32)
    out[used] = w * ratios[used]
    return out, b


def _fit(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            column = batch.column("buckets")
            flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            rows += [flat[a:b] for a, b in zip(at[:-1], at[1:])]
            labels += batch.column("label").to_pylist()
        if not rows:
            return
        weights, intercept = fit_logistic(rows, np.array(labels, dtype=float), shared.value)
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(weights[used].astype(float), intercept))], ["bucket", "weight"])

    return run


@dataclass
class Classifier:
    """weights: of each bucket; intercept: of an empty text."""

    weights: np.ndarray
    intercept: float

    def scores(self, docs: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
        """docs with the column ``score``: the probability that the text is toxic."""
        shared = docs.sparkSession.sparkContext.broadcast(self.weights)  # 4 MB, whatever the input
        intercept = self.intercept

        @F.pandas_udf("double")
        def run(texts: pd.Series) -> pd.Series:
            weights = shared.value
            known = weights != 0
            out = [weights[buckets(np.frombuffer(t, dtype=np.uint8), known)].sum(dtype=float) for t in texts]
            return pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, dtype=float) + intercept, -500, 500))))

        return docs.withColumn(score, run(clean_text(docs, text)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """A classifier of docs (doc_id, text) from labels (doc_id, label 0 or 1)."""
    spark = docs.sparkSession
    marked = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    marked = materialize(marked, "labels")
    ids = marked.where(chosen(F.xxhash64(F.lit(11), "doc_id"), sample, marked.count()))
    # The chosen ids are about ``sample``; a repeated text of an id counts once.
    rows = docs.select("doc_id", clean_text(docs).alias("text")).join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "text"])
    rows = materialize(rows.select("label", "text"), "sample")
    n = rows.count()
    if n > 1.25 * sample:  # ids with several texts: some of these
        rows = materialize(rows.where(chosen(F.xxhash64(F.lit(12), "text", F.monotonically_increasing_id()), sample, n)), "sample")
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not seen.get(0) or not seen.get(1):
        share_toxic = 1.0 if seen.get(1) else 0.0
        return Classifier(np.zeros(BUCKETS, dtype=np.float32), 500.0 if share_toxic else -500.0)
    counts = rows.mapInArrow(_count, "bucket long, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    table = counts.where(F.col("toxic") + F.col("other") >= MIN_TEXTS).toArrow()  # BUCKETS rows at most
    p, q = table.column("toxic").to_numpy() + SMOOTHING, table.column("other").to_numpy() + SMOOTHING
    ratio = np.log((p / (seen[1] + 2 * SMOOTHING)) / (q / (seen[0] + 2 * SMOOTHING)))
    ratios = np.zeros(BUCKETS, dtype=np.float32)
    ratios[table.column("bucket").to_numpy()] = np.where(np.abs(ratio) >= MIN_RATIO, ratio, 0)
    shared = spark.sparkContext.broadcast(ratios)
    chosen_rows = materialize(rows.mapInArrow(_select(shared), "label int, buckets array<int>"), "features")
    found = chosen_rows.repartition(1).mapInArrow(_fit(shared), "bucket long, weight double").toArrow()
    bucket, weight = found.column("bucket").to_numpy(), found.column("weight").to_numpy()
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[bucket[bucket >= 0]] = weight[bucket >= 0]
    return Classifier(weights, float(weight[bucket < 0][0]))


def learned(doc_id: Column) -> Column:
    """Whether labels of this document may be learned from: crc32(doc_id as text) mod 3 isn't 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def train_on_learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """A classifier from the toxic column of the labels of documents that may be learned from."""
    return train(docs, labels.where(learned(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label")), sample)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The documents that score below the threshold."""
    score = fresh(docs, "score")
    return train_on_learned(docs, labels, sample).scores(docs, score=score).where(F.col(score) < threshold).drop(score)
