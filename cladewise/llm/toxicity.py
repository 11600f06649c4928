"""Toxicity by FTRL-proximal logistic regression over hashed words, bigrams and skip-grams.

A document has each feature at most once. The model keeps for every coordinate the sums z and n of the proximal update, so each has
a learning rate of its own, and the L1 term leaves most weights at zero: what is broadcast are the weights that are not. It is
fitted on about ``PER_CLASS`` labelled rows of each label, chosen by hash, in an order of hashes; the intercept is then set
back to the share of the label among all labelled rows of the training fold. Features in fewer than ``MIN_DOCS`` of its rows are left out. Scoring reads every text whole, looks the features
up and adds the weights of the distinct ones; no text is shuffled.

Defined cases: null text is scored as empty text, which has the intercept's score; null labels and labels without a document are not
learned; repeated rows are scored each, very long texts whole; a score of just ``CUT`` counts as label 1; an empty table gives an empty result; without both labels in training every score is the share of label 1 (0 if there is none); other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parallel import dealt
from .common import documents, mix, slices
from .hashed_text import distinct, grams, labelled_sample
from .language_id import fold

BITS = 22
SKIP = 1
PER_CLASS = 6000
MIN_DOCS = 3
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 2.0, 0.1
BIAS_ALPHA = 0.3
CUT = 0.7
FEATURES = "id long, label int, features array<int>"
SCORED = "doc_id long, held_out boolean, score double"


class Ftrl:
    """Weights by coordinate: w = -(z - sign(z) L1) / ((BETA + sqrt(n)) / ALPHA + L2) where |z| exceeds L1, else 0."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32)
        self.bias, self.bias_n = 0.0, 0.0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias, -35, 35)))
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        # the intercept has no L1 term
        self.bias_n += g * g
        self.bias -= BIAS_ALPHA / (BETA + np.sqrt(self.bias_n)) * g


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            feature, of = distinct(*grams(part.column("text"), BITS, SKIP), BITS)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32)), pa.array(feature.astype(np.int32)))
            yield pa.record_batch([part.column("id"), part.column("label"), lists], names=["id", "label", "features"])


def fit(rows: DataFrame, given: DataFrame, per_class: int = PER_CLASS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Numbers and weights of the features that have one, and the intercept, from rows (id, text) and labels (id, label)."""
    count, sample = labelled_sample(rows, given, "label", per_class)
    empty = np.zeros(0, np.int64), np.zeros(0)
    if not (count.get(0) and count.get(1)):
        return *empty, 35.0 if count.get(1) else -35.0
    found = sample.repartition(sample.sparkSession.sparkContext.defaultParallelism).mapInArrow(_extract, FEATURES).toArrow()
    ids, labels = found["id"].to_numpy(), found["label"].to_numpy()
    lists = found["features"].combine_chunks()
    size, feature = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    often = np.bincount(feature, minlength=1 << BITS) >= MIN_DOCS
    keep = often[feature]
    feature, of = feature[keep], np.repeat(np.arange(len(ids)), size)[keep]
    bounds = np.searchsorted(of, np.arange(len(ids) + 1))
    del found, lists, keep, of, often
    order = np.lexsort((labels, mix(ids.astype(np.uint64))))
    model = Ftrl()
    for _ in range(epochs):
        for i in order:
            model.learn(feature[bounds[i] : bounds[i + 1]], int(labels[i]))
    drawn = np.bincount(labels, minlength=2)
    bias = model.bias + np.log(count[1] / count[0]) - np.log(drawn[1] / drawn[0])
    at = np.flatnonzero(np.abs(model.z) > L1)
    return at, model.weights(at), float(bias)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = model.value
        index = np.zeros(1 << BITS, bool)
        index[at] = True
        for batch in batches:
            for part in slices(batch):
                feature, of = grams(part.column("text"), BITS, SKIP)
                known = index[feature]
                feature, of = distinct(feature[known], of[known], BITS)
                total = bias + np.bincount(of, w[np.searchsorted(at, feature)] if len(at) else None, part.num_rows)
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "held_out", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Learns from the labels of rows that are not held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    given = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.filter("not held_out").select(F.col("doc_id").alias("id"), "text"), given, per_class))
    return dealt(rows).mapInArrow(_score(model), SCORED).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 3) == 1)


QUERIES = {"op2_toxicity": op2_toxicity}
SQL: dict[str, str] = {}
