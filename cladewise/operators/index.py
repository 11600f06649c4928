"""The minimizer index: build, capacity, look-up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import cell32, compacted, page_of, slot_index
from .minimizers import Scheme, minimizers
from .taxonomy import lca_by

SAMPLE_RANGE = 1023
SAMPLE_DIVISOR = 1024
RESERVE = 8192
#: An index of at most so many bytes is broadcast when no mode is asked for; an entry takes so many in a broadcast hash table.
BROADCAST_BYTES = 256 << 20
ENTRY_BYTES = 48
SIEVE_BITS = 28
#: Spark broadcasts tables of fewer rows than 512 million.
MOST_ENTRIES = 341_000_000


def genome_taxids(genomes: DataFrame, seqid_map: DataFrame) -> DataFrame:
    """Genomes with the taxid of their identifier; those without one are left out, as are taxids of 0."""
    return genomes.join(seqid_map.select("seq_id", "taxid"), "seq_id").filter(F.col("taxid") > 0)


def build(genomes: DataFrame, tree: DataFrame, scheme: Scheme) -> DataFrame:
    """hash, taxid: for every distinct minimizer the lowest common ancestor of the taxa that have it.

    (seq_id, taxid, seq) rows. Hashes repeat within a taxon, so pairs are made distinct first (combined before the shuffle); the
    ancestor is a second grouped aggregate on the same key.
    """
    pairs = minimizers(genomes.filter("taxid > 0"), scheme, ["taxid"]).select("hash", "taxid").distinct()
    return lca_by(pairs, tree, "hash").filter("taxid > 0")


def compact_index(index: DataFrame, value_bits: int, capacity: int, numbered: DataFrame) -> DataFrame:
    """Page-table form: idx, cell (compact key and internal id) of each entry; equal keys at one place are not merged here."""
    ids = numbered.select("taxid", "internal_id")
    return index.join(ids, "taxid").select("hash", slot_index(F.col("hash"), capacity).alias("idx"), cell32(F.col("hash"), value_bits, F.col("internal_id")).alias("cell"))


def compat_index(index: DataFrame, tree: DataFrame, value_bits: int, capacity: int) -> DataFrame:
    """The index keyed as a table of compact cells would be: place and compact key, ancestors of what falls together."""
    keyed = index.select(slot_index(F.col("hash"), capacity).alias("idx"), compacted(F.col("hash"), value_bits).alias("key"), "taxid")
    return lca_by(keyed, tree, "idx", "key")


def pages(index: DataFrame, capacity: int, page_cells: int) -> DataFrame:
    """Entries by page of a table of ``capacity`` cells."""
    page, _ = page_of(slot_index(F.col("hash"), capacity), page_cells)
    return index.withColumn("page", page).groupBy("page").agg(F.count("*").alias("entries"))


def minhash_sample(found: DataFrame, max_n: int) -> DataFrame:
    """Minimizers in the lowest ``max_n`` of 1024 parts of the hash space."""
    return found.filter(F.col("hash").bitwiseAND(F.lit(SAMPLE_RANGE).cast("long")) < max_n)


def capacity_of(estimate: Column, load_factor: float) -> Column:
    """Cells for so many distinct minimizers."""
    if not 0 < load_factor <= 1:
        raise ValueError("the load factor must be above 0 and at most 1")
    return F.ceil((estimate + RESERVE) / F.lit(load_factor).cast("double")).cast("long")


def _estimate(distinct: Column, max_n: int) -> Column:
    return F.round(distinct.cast("double") * SAMPLE_DIVISOR / max_n).cast("long")


def estimate_capacity(found: DataFrame, max_n: int = 4, load_factor: float = 0.7, exact: bool = True) -> DataFrame:
    """One row: estimate (distinct minimizers, from the sample) and capacity in cells."""
    sample = minhash_sample(found, max_n)
    distinct = F.count_distinct("hash") if exact else F.hll_sketch_estimate(F.hll_sketch_agg("hash", F.lit(16)))
    return sample.agg(_estimate(distinct, max_n).alias("estimate")).withColumn("capacity", capacity_of(F.col("estimate"), load_factor))


def file_sketches(found: DataFrame, max_n: int = 4) -> DataFrame:
    """file, sketch: a mergeable sketch of each file's sampled minimizers."""
    return minhash_sample(found, max_n).groupBy("file").agg(F.hll_sketch_agg("hash", F.lit(16)).alias("sketch"))


def capacity_of_sketches(sketches: DataFrame, max_n: int = 4, load_factor: float = 0.7) -> DataFrame:
    """``estimate_capacity`` of all files, from their sketches."""
    distinct = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0))
    return sketches.agg(_estimate(distinct, max_n).alias("estimate")).withColumn("capacity", capacity_of(F.col("estimate"), load_factor))


def index_bytes(capacity: Column) -> Column:
    return capacity * 4


def sieve(index: DataFrame, entries: int) -> bytes | None:
    """A bitmap of the low bits of the index's hashes, at most one bit in 64 set while its size allows it, for ``minimizers``: k-mers it lets through are those of the index and a few more.

    It is made in pages by tasks and has 2^``SIEVE_BITS`` bits at most; none is made for an index that would set half of those.
    """
    bits = min(max(16, (64 * entries).bit_length()), SIEVE_BITS)
    if 2 * entries > 1 << bits:
        return None
    at = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    def fill(rows: pa.Table) -> pa.Table:
        page = np.zeros(1 << 16, bool)
        page[rows.column("bit").to_numpy()] = True
        return pa.table({"page": rows.column("page")[:1], "bits": pa.array([np.packbits(page, bitorder="little").tobytes()], pa.binary())})

    rows = index.select(F.shiftright(at, 16).alias("page"), at.bitwiseAND(F.lit(0xFFFF).cast("long")).alias("bit")).distinct()
    out = bytearray(1 << bits - 3)
    for r in rows.groupBy("page").applyInArrow(fill, "page long, bits binary").toLocalIterator():
        out[r.page << 13 : r.page + 1 << 13] = r.bits
    return bytes(out)


def annotate(kmers: DataFrame, index: DataFrame, mode: str = "auto", entries: int | None = None) -> DataFrame:
    """Minimizers with the taxid of their index entry; those without one are left out.

    broadcast: the whole index at every executor, no shuffle; refused beyond ``MOST_ENTRIES``. shuffle: both sides dealt by hash (no shuffle of an
    index that was written in buckets of the hash). auto: broadcast if the index is known to be small by its ``entries`` (a saved
    database knows them), or by Spark's estimate of a plan that is no larger, else Spark's choice at run time.
    """
    if mode == "broadcast":
        if entries is not None and entries > MOST_ENTRIES:
            raise ValueError(f"an index of {entries} entries is too large to broadcast; use shuffle")
        return kmers.join(F.broadcast(index), "hash")
    size = entries * ENTRY_BYTES if entries is not None else estimated_bytes(index)
    if mode == "auto" and size <= BROADCAST_BYTES:
        return kmers.join(F.broadcast(index), "hash")
    return kmers.join(index.hint("shuffle_hash") if mode == "shuffle" else index, "hash")


def estimated_bytes(df: DataFrame) -> int:
    """Size of a table by the optimizer's statistics (files for scans)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def write_index(index: DataFrame, table: str, buckets: int) -> None:
    """Saves the index in buckets of the hash, so that look-ups dealt by hash do not shuffle it."""
    index.write.bucketBy(buckets, "hash").sortBy("hash").mode("overwrite").format("parquet").saveAsTable(table)


def occupied(index: DataFrame) -> DataFrame:
    return index.filter("taxid > 0").agg(F.count("*").alias("size"))
