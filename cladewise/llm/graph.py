"""Connected components: local contraction, then alternating star contractions between what is left.

Edges are dealt into parts of at most about ``PART`` (a bound on a task's memory); each part is reduced to one edge from every node to the
least node it reaches there. With more than one part, star steps follow, each a grouped minimum and a join, whatever the degrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


PART = 2_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, node) for every node of the edges that is not the least of its component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[rest]], ids[rest]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        a, b = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c in ("lo", "hi"))
        yield pa.record_batch([pa.array(x) for x in stars(a, b)], names=["lo", "hi"])


def components(scratch: Scratch, edges: DataFrame, name: str, max_steps: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has an edge (columns a, b)."""

    def least(e: DataFrame, key: str, other: str) -> DataFrame:
        return e.groupBy(key).agg(F.min(other).alias("m"))

    parts = max(1, -(-edges.count() // PART))
    pairs = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi")
    now = scratch.table(pairs.repartition(parts).mapInArrow(_contract, "lo long, hi long"), f"{name}-0")
    seen = None
    for step in range(1, max_steps if parts > 1 else 1):
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        # large star: the larger neighbours of u go to the least of u and its neighbours
        large = both.filter("v > u").join(least(both, "u", "v").select("u", F.least("u", "m").alias("m")), "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = least(large, "hi", "lo")
        small = large.join(low, "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).filter("lo < hi").unionByName(low.select(F.col("m").alias("lo"), "hi")).distinct()
        after = scratch.table(small, f"{name}-{step}")
        sums = after.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("lo", "hi"), F.lit(1 << 31)))).first()
        scratch.drop(f"{name}-{step - 1}")
        now = after
        if tuple(sums) == seen:
            break
        seen = tuple(sums)
    else:
        if parts > 1:
            raise RuntimeError("components did not settle")
    heads = now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(heads)
