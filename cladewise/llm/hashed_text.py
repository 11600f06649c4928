"""Hashed text features of the two text models: distinct word n-grams of a document as numbers below a power of two."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, span_hashes, text_buffer, window_hashes

_INNER = np.zeros(256, bool)
_INNER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters, digits and bytes beyond ASCII (lower-cased), and the first token of each text."""
    inside = _INNER[data]
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, ends, np.searchsorted(starts, offsets)


def pair_hashes(word: np.ndarray, first: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ordered pairs of words ``gap`` apart in one text, and the text of each."""
    at, of = ranges(first[:-1], np.maximum(np.diff(first) - gap, 0))
    pair = np.empty(2 * len(at), np.uint64)
    pair[0::2], pair[1::2] = word[at], word[at + gap]
    return window_hashes(pair, np.arange(0, 2 * len(at), 2), 2, 61 + gap), of


def grams(arr: pa.Array, bits: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, bigrams and skip-grams of up to ``skip`` words between, and the text of each; with repeats."""
    data, offsets = text_buffer(arr, lower_ascii=True)
    starts, ends, first = tokens(data, offsets)
    word = span_hashes(data, starts, ends)
    parts = [(word, np.repeat(np.arange(len(first) - 1), np.diff(first)))] + [pair_hashes(word, first, g) for g in range(1, skip + 2)]
    h, of = (np.concatenate(x) for x in zip(*parts, strict=True))
    return (h >> np.uint64(64 - bits)).astype(np.int64), of


def distinct(feature: np.ndarray, of: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(of.astype(np.int64) << bits | feature)
    return both & (1 << bits) - 1, both >> bits


def labelled_sample(rows: DataFrame, given: DataFrame, label: str, limit: int) -> tuple[dict[int, int], DataFrame]:
    """How many labelled rows each label has, and (id, label, text) of about ``limit`` of each: those whose hash is below limit / count.

    rows (id, text) meet the labels by identifier alone; texts are then read for the sample's identifiers, which are broadcast
    (about ``limit`` for each label), so no text is shuffled and no label is gathered in one task.
    """
    known = rows.select("id").join(given, "id")
    count = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}
    share = F.lit(0.0)
    for value, n in count.items():
        share = F.when(F.col(label) == value, min(1.0, limit / n)).otherwise(share)
    chosen = known.filter(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30)) < share * (1 << 30)).distinct()
    return count, rows.join(F.broadcast(chosen), "id").select("id", label, "text")
