"""Counters per taxon, their clades, and the two report forms.

The depth-first order of a report, in which siblings stand by their clade's reads, is an ordinary sort: each node's key is the array of its
ancestors' (reads, tie) pairs, and arrays sort a prefix before what it begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import mpa_lineage, percent, rank_code, rank_letter


def taxon_counters(calls: DataFrame, hits: DataFrame, keys: list[str] = (), approximate: bool = False) -> DataFrame:
    """keys, taxid, reads (called), kmers (hits), distinct (minimizers) of every taxon called or hit.

    Hits of unclassified reads count. ``approximate`` keeps a mergeable sketch (column sketch) instead of the exact count.
    """
    keys = list(keys)
    called = calls.filter("call > 0").groupBy(*keys, F.col("call").alias("taxid")).agg(F.count("*").alias("reads"))
    distinct = F.hll_sketch_agg("hash", F.lit(16)).alias("sketch") if approximate else F.count_distinct("hash").alias("distinct")
    hit = hits.filter("taxid > 0").groupBy(*keys, "taxid").agg(F.count("*").alias("kmers"), distinct)
    both = called.join(hit, [*keys, "taxid"], "full")
    last = F.hll_sketch_estimate("sketch").alias("distinct") if approximate else F.coalesce("distinct", F.lit(0)).alias("distinct")
    return both.select(*keys, "taxid", F.coalesce("reads", F.lit(0)).alias("reads"), F.coalesce("kmers", F.lit(0)).alias("kmers"), *(["sketch", F.coalesce(last, F.lit(0)).alias("distinct")] if approximate else [last]))


def call_counts(calls: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, call, reads: the one table, of a row a call, that all of a report's counts follow from."""
    return calls.groupBy(*keys, "call").agg(F.count("*").alias("reads"))


def _weight(calls: DataFrame) -> Column:
    """Reads that a row stands for: calls are read by read, or counted by ``call_counts``."""
    return F.col("reads") if "reads" in calls.columns else F.lit(1)


def clade_counts(calls: DataFrame, tree: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, taxid, clade_reads, taxon_reads of every node that has a called read in its clade."""
    keys = list(keys)
    direct = calls.filter("call > 0").groupBy(*keys, F.col("call").alias("of")).agg(F.sum(_weight(calls)).alias("reads"))
    up = direct.join(tree.select(F.col("taxid").alias("of"), "path"), "of").select(*keys, "of", "reads", F.explode("path").alias("taxid"))
    return up.groupBy(*keys, "taxid").agg(F.sum("reads").alias("clade_reads"), F.sum(F.when(F.col("of") == F.col("taxid"), F.col("reads")).otherwise(0)).alias("taxon_reads"))


def clade_counters(calls: DataFrame, hits: DataFrame, tree: DataFrame, keys: list[str] = (), approximate: bool = False) -> DataFrame:
    """clade_counts with kmers and distinct minimizers of the clade. Nodes with hits but no reads appear too."""
    keys = list(keys)
    reads = clade_counts(calls, tree, keys)
    paths = tree.select("taxid", "path")
    # (taxon, minimizer) pairs first: what climbs the tree is each pair once
    pairs = hits.filter("taxid > 0").groupBy(*keys, "taxid", "hash").agg(F.count("*").alias("times")).join(paths, "taxid")
    up = pairs.select(*keys, F.explode("path").alias("taxid"), "hash", "times")
    distinct = F.hll_sketch_estimate(F.hll_sketch_agg("hash", F.lit(16))) if approximate else F.count_distinct("hash")
    kmers = up.groupBy(*keys, "taxid").agg(F.sum("times").alias("kmers"), distinct.alias("distinct"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return reads.join(kmers, [*keys, "taxid"], "full").select(*keys, "taxid", *[zero(c) for c in ("clade_reads", "taxon_reads", "kmers", "distinct")])


def totals(calls: DataFrame, keys: list[str] = ()) -> DataFrame:
    reads, zero = _weight(calls), F.lit(0).cast("long")
    part = lambda chosen: F.coalesce(F.sum(F.when(chosen, reads)), zero)
    return calls.groupBy(*keys).agg(F.coalesce(F.sum(reads), zero).alias("total"), part(F.col("call") > 0).alias("classified"), part(F.col("call") <= 0).alias("unclassified"))


def sample_rollup(calls: DataFrame, sample: str) -> DataFrame:
    """Reads by sample and taxon, and of all samples together (null sample)."""
    called = calls.filter("call > 0")
    return called.groupingSets([[sample, "call"], ["call"]], sample, "call").agg(F.count("*").alias("reads")).withColumnRenamed("call", "taxid")


def _with_order(nodes: DataFrame, reads: Column, tie: Column, keys: list[str]) -> DataFrame:
    """Nodes (keys, taxid, path, ...) with ``order``: the sort key of a depth-first walk."""
    own = nodes.select(*keys, F.col("taxid").alias("_of"), F.struct((-reads).alias("r"), tie.alias("t")).alias("_key"))
    steps = nodes.select(*keys, "taxid", F.posexplode("path").alias("_at", "_of")).join(own, [*keys, "_of"])
    order = steps.groupBy(*keys, "taxid").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_key"))), lambda x: x["_key"]).alias("order"))
    return nodes.join(order, [*keys, "taxid"])


def kreport(tree: DataFrame, clades: DataFrame, total: DataFrame, keys: list[str] = (), zero_counts: bool = False, kmer_data: bool = False) -> DataFrame:
    """Report rows: keys, ord (from 0), pct, clade_reads, taxon_reads, [kmers, distinct,] rank_code, taxid, name, depth.

    Depth-first, siblings by clade reads, ties by taxid, both descending; the unclassified row leads if there are any.
    """
    keys, more = list(keys), ["kmers", "distinct"] if kmer_data else []
    counts = ["clade_reads", "taxon_reads", *more]
    samples = total.select(*keys)
    nodes = tree.select("taxid", "path", "rank_path", "name", "depth")
    if zero_counts:
        nodes = (samples.crossJoin(nodes) if keys else nodes).join(clades, [*keys, "taxid"], "left").fillna(0, counts)
    else:
        nodes = nodes.join(clades.filter("clade_reads > 0"), "taxid")
    nodes = _with_order(nodes, F.col("clade_reads"), -F.col("taxid"), keys)
    rows = nodes.select(*keys, F.col("order"), *counts, rank_code(F.col("rank_path")).alias("rank_code"), "taxid", "name", "depth")
    first = F.array(F.struct(F.lit(-(1 << 62)).cast("long").alias("r"), F.lit(0).cast("long").alias("t")))
    none = total.filter(F.lit(zero_counts) | (F.col("unclassified") > 0))
    none = none.select(*keys, first.alias("order"), F.col("unclassified").alias("clade_reads"), F.col("unclassified").alias("taxon_reads"), *[F.lit(0).cast("long").alias(c) for c in more], F.lit("U").alias("rank_code"), F.lit(0).cast("long").alias("taxid"), F.lit("unclassified").alias("name"), F.lit(0).alias("depth"))
    both = rows.unionByName(none)
    both = both.join(total.select(*keys, "total"), keys) if keys else both.crossJoin(total.select("total"))
    ord_ = (F.row_number().over(Window.partitionBy(*keys).orderBy("order")) - 1).alias("ord")
    return both.select(*keys, ord_, percent(F.col("clade_reads"), F.col("total")).alias("pct"), *counts, "rank_code", "taxid", "name", "depth")


def kreport_lines(report: DataFrame, keys: list[str] = (), kmer_data: bool = False) -> DataFrame:
    """The report's text: percentage in six places, tabs, names indented by two blanks a level."""
    counts = ["clade_reads", "taxon_reads", *(["kmers", "distinct"] if kmer_data else [])]
    name = F.concat(F.expr("repeat('  ', depth)"), "name")
    return report.select(*keys, "ord", F.concat_ws("\t", F.format_string("%6.2f", "pct"), *[F.col(c).cast("string") for c in counts], "rank_code", F.col("taxid").cast("string"), name).alias("value"))


def mpa_report(tree: DataFrame, clades: DataFrame, keys: list[str] = (), zero_counts: bool = False) -> DataFrame:
    """keys, ord, lineage, clade_count of the nodes whose rank has a letter; depth-first, ties between siblings by ascending taxid."""
    keys = list(keys)
    nodes = tree.select("taxid", "path", "rank", "rank_path", "name_path")
    nodes = nodes.join(clades, [*keys, "taxid"], "left").fillna(0, ["clade_reads"]) if zero_counts and not keys else nodes.join(clades.filter("clade_reads > 0"), "taxid")
    nodes = _with_order(nodes, F.col("clade_reads"), F.col("taxid"), keys).filter(rank_letter(F.col("rank")).isNotNull())
    ord_ = (F.row_number().over(Window.partitionBy(*keys).orderBy("order")) - 1).alias("ord")
    return nodes.select(*keys, ord_, mpa_lineage(F.col("rank_path"), F.col("name_path")).alias("lineage"), F.col("clade_reads").alias("clade_count"))
