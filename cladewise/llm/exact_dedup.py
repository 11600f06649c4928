"""Exact dedup by a content sort.

Normalised texts (white space ``[\\x20\\x09-\\x0D]`` deleted) are range-partitioned between sampled splitters and sorted externally, so
equal ones stand next to each other; each is compared in full with its neighbour. The splitter key is a short head, a hash of the
whole text, the length and the identifier: splitters stay small however long the texts are, and a group of copies that is larger
than a partition is cut between neighbouring partitions rather than gathered in one. The pieces of such a group are put together
from one summary row per run of equal texts.

Defined cases: null text counts as empty; empty texts are equal to each other; of equal texts the one with the most code points,
then the smallest identifier stays (null identifiers last); rows repeated in full are counted each, and exactly one of them is kept;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents

BLANKS = "[\\x20\\x09-\\x0D]"
HEAD = 24


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one partition to one row for each document and, at its end, one for each run of equal texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("chars", pa.int64()), ("run", pa.int64()), ("sha", pa.binary()), ("size", pa.int64())])
    run, last, sha, size, head = -1, None, b"", 0, (None, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        norm, ids, chars = batch.column("norm"), batch.column("doc_id"), batch.column("chars")
        new = np.ones(len(norm), bool)
        new[1:] = ~pc.equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        new[0] = last is None or norm[0].as_py() != last
        at = np.flatnonzero(new)
        shas, ends = [sha], []
        bounds = np.append(at, len(norm))
        size += int(bounds[0])
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if run + i >= 0:
                ends.append((*head, run + i, sha, size))
            sha, size, head = hashlib.sha256(norm[int(a)].as_py()).digest(), int(b - a), (ids[int(a)].as_py(), chars[int(a)].as_py())
            shas.append(sha)
        of = np.cumsum(new)
        yield pa.record_batch([ids, chars, pa.array(of + run), pa.array(shas, pa.binary()).take(pa.array(of)), pa.nulls(len(of), pa.int64())], schema=schema)
        if ends:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*ends, strict=True), schema, strict=True)], schema=schema)
        run += len(at)
        last = norm[-1].as_py()
    if run >= 0:
        yield pa.record_batch([pa.array([c], f.type) for c, f in zip((*head, run, sha, size), schema, strict=True)], schema=schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.char_length(text).cast("long").alias("chars"), F.regexp_replace(text, BLANKS, "").cast("binary").alias("norm"))
    key = [F.substring("norm", 1, HEAD), F.xxhash64("norm")]
    order = [F.col("chars").desc(), F.col("doc_id").asc_nulls_last()]
    placed = rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, "norm", *order)
    # the run number is local to a partition: the partition's number goes beside it
    marked = placed.mapInArrow(_runs, "doc_id long, chars long, run long, sha binary, size long").withColumn("part", F.spark_partition_id())
    marked = scratch.table(marked, "runs")
    runs = marked.filter("size is not null")
    # pieces of one group, at most one for each partition it spans
    whole = runs.groupBy("sha").agg(F.sum("size").alias("group_size"), F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), "doc_id", "part", "run")).alias("first"))
    docs_out = marked.filter("size is null").select("doc_id", "chars", "sha", "part", "run", F.monotonically_increasing_id().alias("row"))
    joined = docs_out.join(whole, "sha")
    # among rows repeated in full, the first of the run that won is kept
    again = joined.filter(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (-F.col("chars") == F.col("first.c"))).groupBy("sha").agg(F.min("row").alias("winner"))
    return joined.join(again, "sha").select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("winner")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
SQL = {
    "op4_exact_dedup": r"""
with n as (select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
r as (select *, count(*) over (partition by norm) as group_size, first_value(doc_id) over (partition by norm order by chars desc, doc_id) as keep_id from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from r"""
}
