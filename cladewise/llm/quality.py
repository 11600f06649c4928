"""Quality by ordinal regression with cumulative links.

A document of n words has the features of its words: the word (lower-cased), its shape (letters by case, digits and signs, runs as
one) and the pair of its shape and the next one's (told apart if the next word is the same), hashed; each counts with its share of n. P(grade <= k) = sigmoid(t_k - w.x): all grades
share the weights w, the thresholds t_0 < t_1 < ... are kept in order by learning the logarithms of their distances. The model is
fitted on about ``PER_GRADE`` rated rows of each grade, chosen by hash, by per-coordinate steps in an order of hashes;
probabilities are then put back to the shares that the grades have among all rated rows. A document gets its expected grade and
its tail probability, that of the grade ``good`` or better, by which it is kept or rejected.

Scoring reads every text whole and adds weights word by word; no text is shuffled, and the broadcast model has 2^BITS weights.

Defined cases: null text is scored as empty text (no features: thresholds alone decide); null ratings and ratings without a document are not
learned; repeated rows are scored each, very long texts whole; a probability of just ``KEEP`` is kept; an empty table gives an empty result; with fewer than two grades rated every document gets that grade (kept, if there is none);
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.parallel import dealt
from .common import documents, mix, slices, span_hashes, text_buffer, words
from .hashed_text import labelled_sample
from .language_id import fold

BITS = 18
PER_GRADE = 4000
EPOCHS = 8
RATE = 0.5
L2 = 1e-6
KEEP = 0.5
FEATURES = "id long, grade int, features array<int>, counts array<int>, n int"

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")


def _features(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers with repeats (three a word), the text of each, and the number of words of each text."""
    data, offsets = text_buffer(arr)
    starts, ends, first = words(data, offsets)
    lower = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    word = span_hashes(lower, starts, ends)
    kind = _CLASS[data]
    own = np.ones(len(kind), bool)
    own[1:] = kind[1:] != kind[:-1]
    own[starts] = True
    at = np.cumsum(own)
    before = lambda i: np.where(i > 0, at[i - 1], 0) if len(at) else i
    shape = span_hashes(kind[own], before(starts), before(ends), seed=19)
    following = np.append(shape[1:], np.uint64(0)) if len(shape) else shape
    last = np.zeros(len(shape), bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    same = np.append(word[1:] == word[:-1], False) & ~last if len(word) else last
    pair = mix(shape + np.uint64(3) * np.where(last, np.uint64(0), following) + same.astype(np.uint64))
    n = np.diff(first)
    of = np.repeat(np.arange(len(n)), n)
    h = np.concatenate([word, shape, pair])
    return (h >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([of, of, of]), n


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            feature, of, n = _features(part.column("text"))
            both, count = np.unique(of << BITS | feature, return_counts=True)
            offsets = pa.array(np.searchsorted(both >> BITS, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (both & (1 << BITS) - 1, count)]
            yield pa.record_batch([part.column("id"), part.column("grade"), *lists, pa.array(n.astype(np.int32))], names=["id", "grade", "features", "counts", "n"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class CumulativeLink:
    """Weights and thresholds of K grades, learned one row at a time."""

    def __init__(self, grades: int):
        self.w, self.gw = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
        self.first, self.gaps = 0.0, np.zeros(grades - 2)
        self.gt = np.full(grades - 1, 1e-3)

    def thresholds(self) -> np.ndarray:
        return self.first + np.append(0.0, np.cumsum(np.exp(self.gaps)))

    def learn(self, at: np.ndarray, x: np.ndarray, grade: int) -> None:
        t, score = self.thresholds(), self.w[at] @ x
        up = _sigmoid(t[grade] - score) if grade < len(t) else 1.0
        low = _sigmoid(t[grade - 1] - score) if grade else 0.0
        p = max(up - low, 1e-9)
        d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
        # gradients of -log p: by the score, and by each threshold
        g = (d_up - d_low) * x + L2 * self.w[at]
        self.gw[at] += g * g
        self.w[at] -= RATE / np.sqrt(self.gw[at]) * g
        by_t = np.zeros(len(t))
        if grade < len(t):
            by_t[grade] -= d_up
        if grade:
            by_t[grade - 1] += d_low
        tail = np.cumsum(by_t[::-1])[::-1]  # the first threshold moves all, each gap all behind it
        step = np.append(tail[0], tail[1:] * np.exp(self.gaps))
        self.gt += step * step
        step *= RATE / 4 / np.sqrt(self.gt)
        self.first -= step[0]
        self.gaps -= step[1:]


def probabilities(score: np.ndarray, thresholds: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """(rows, grades), weighted by ``prior``: each grade's share of all rows over its share of the rows fitted on."""
    below = _sigmoid(thresholds[None, :] - score[:, None])
    p = np.diff(np.column_stack([np.zeros(len(score)), below, np.ones(len(score))]), axis=1) * prior
    return p / p.sum(axis=1, keepdims=True)


def fit(rows: DataFrame, given: DataFrame, per_grade: int = PER_GRADE, epochs: int = EPOCHS) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Grades in order, weights, thresholds and prior weights of the grades, from rows (id, text) and ratings (id, grade)."""
    count, sample = labelled_sample(rows, given, "grade", per_grade)
    grades = sorted(count)
    if len(grades) < 2:
        return grades, np.zeros(1 << BITS), np.zeros(0), np.ones(1)
    found = sample.repartition(sample.sparkSession.sparkContext.defaultParallelism).mapInArrow(_extract, FEATURES).toArrow()
    # flat arrays: an object for each row and list would take the driver's memory for good
    ids, graded, n = (found[c].to_numpy() for c in ("id", "grade", "n"))
    lists = found["features"].combine_chunks()
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    feature, times = lists.flatten().to_numpy(), found["counts"].combine_chunks().flatten().to_numpy()
    del found, lists
    order = np.lexsort((graded, ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    y = np.searchsorted(grades, graded)
    model = CumulativeLink(len(grades))
    for _ in range(epochs):
        for i in order:
            own = slice(bounds[i], bounds[i + 1])
            model.learn(feature[own], times[own] / max(1, n[i]), int(y[i]))
    drawn = np.bincount(y, minlength=len(grades))
    del feature, times
    pa.default_memory_pool().release_unused()
    prior = np.array([count[g] for g in grades]) / np.maximum(drawn, 1)
    return grades, model.w, model.thresholds(), prior / prior.max()


def _score(model, good: int, text: str, carried: list[str]):
    """The carried columns, then the expected grade and the tail probability."""
    names = [*carried, *_added(carried)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades, w, thresholds, prior = model.value
        values = np.array(grades or [good], float)
        for batch in batches:
            for part in slices(batch, text):
                feature, of, n = _features(part.column(text))
                p = probabilities(np.bincount(of, w[feature], part.num_rows) / np.maximum(n, 1), thresholds, prior)
                yield pa.record_batch([*(part.column(c) for c in carried), pa.array(p @ values), pa.array(p[:, values >= good].sum(axis=1))], names=names)

    return run


def _added(carried: list[str]) -> list[str]:
    """Names of the two scores that none of the carried columns has."""
    out = ["expected_grade", "tail_prob"]
    while {*out} & {c.lower() for c in carried}:
        out = [f"_{c}" for c in out]
    return out


def _scored(rows: DataFrame, ratings: DataFrame, held_out: Column, good: int, id_col: str, text_col: str, grade_col: str, per_grade: int, carried: list[str]) -> DataFrame:
    given = ratings.select(F.col(id_col).cast("long").alias("id"), F.col(grade_col).cast("int").alias("grade")).filter("id is not null and grade is not null")
    learned = rows.filter(~held_out).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    model = rows.sparkSession.sparkContext.broadcast(fit(learned, given, per_grade))
    schema = StructType([*(f for f in rows.schema if f.name in carried), *(StructField(c, DoubleType()) for c in _added(carried))])
    return dealt(rows).mapInArrow(_score(model, good, text_col, [f.name for f in schema[:-2]]), schema)


def rate_quality(docs: DataFrame, ratings: DataFrame, held_out: Column, good: int = 1, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", per_grade: int = PER_GRADE) -> DataFrame:
    """One row per document: doc_id, held_out, expected_grade, tail_prob, kept. Learns from ratings of rows that are not held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    given = ratings.select(F.col(id_col).alias("doc_id"), F.col(grade_col).alias("grade"))
    return _scored(rows, given, F.col("held_out"), good, "doc_id", "text", "grade", per_grade, ["doc_id", "held_out"]).withColumn("kept", F.col("tail_prob") >= KEEP)


def keep_quality(docs: DataFrame, ratings: DataFrame, good: int = 1, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", per_grade: int = PER_GRADE) -> DataFrame:
    """The rows of docs that are kept, all columns."""
    scored = _scored(docs, ratings, F.lit(False), good, id_col, text_col, grade_col, per_grade, docs.columns)
    return scored.filter(F.col(scored.columns[-1]) >= KEEP).select(docs.columns)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 5) == 0)


QUERIES = {"op8_quality": op8_quality}
SQL: dict[str, str] = {}
