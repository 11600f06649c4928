"""Calls: from the hits of a read to one taxon, hit strings, mates.

A read's hits are gathered once (one shuffle, by read) as counts per taxon with the taxon's path; scores, ties, the walk towards the root and the
minimum evidence are then array functions on that one row. A read has as many entries as it has distinct taxa.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import bound
from ..functions.scalars import common_prefix, required_score, trim_pair


def taxon_counts(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Hits per read and taxon."""
    return hits.filter("taxid > 0").groupBy(*keys, "taxid").agg(F.count("*").alias("hits"))


def root_to_leaf_scores(hits: DataFrame, tree: DataFrame, keys: list[str]) -> DataFrame:
    """For each taxon of a read, the hits on its path: score of the taxon."""
    count = taxon_counts(hits, keys).join(tree.select("taxid", "path"), "taxid")
    up = count.select(*keys, "taxid", F.explode("path").alias("anc"))
    own = count.select(*keys, F.col("taxid").alias("anc"), "hits")
    return up.join(own, [*keys, "anc"]).groupBy(*keys, "taxid").agg(F.sum("hits").alias("score"))


def clade_sums(hits: DataFrame, tree: DataFrame, keys: list[str]) -> DataFrame:
    """For each ancestor of a read's taxa, the hits in its clade."""
    count = taxon_counts(hits, keys).join(tree.select("taxid", "path"), "taxid")
    return count.select(*keys, F.explode("path").alias("taxid"), "hits").groupBy(*keys, "taxid").agg(F.sum("hits").alias("clade_hits"))


def _sum(parts: Column, chosen) -> Column:
    return F.aggregate(F.filter(parts, chosen), F.lit(0).cast("long"), lambda acc, p: acc + p["hits"])


def best_path(parts: Column) -> Column:
    """Path of the lowest common ancestor of the taxa with the greatest root-to-leaf score.

    All paths of that score lie between the least and the greatest of them, which are the extremes of (score, path).
    """
    scored = F.transform(parts, lambda p: F.struct(_sum(parts, lambda u: F.array_contains(p["path"], u["taxid"])).alias("score"), p["path"].alias("path")))
    first = lambda s: F.array_min(F.transform(s, lambda x: F.struct((-x["score"]).alias("score"), x["path"].alias("path"))))["path"]
    ends = bound(scored, lambda s: F.struct(first(s).alias("lo"), F.array_max(s)["path"].alias("hi")))
    return bound(ends, lambda e: common_prefix(e["lo"], e["hi"]))


def walk_up(path: Column, parts: Column, required: Column) -> Column:
    """The deepest taxon of a path whose clade has the required hits, else 0."""
    enough = F.filter(path, lambda a: _sum(parts, lambda u: F.array_contains(u["path"], a)) >= required)
    return F.coalesce(F.try_element_at(enough, F.lit(-1)), F.lit(0).cast("long"))


def resolve(reads: DataFrame, hits: DataFrame, tree: DataFrame, keys: list[str], confidence: float = 0.0, min_groups: int = 2, only_hit_reads: bool = False) -> DataFrame:
    """A call for every read (keys, n positions): the columns of reads, call (0: unclassified) and status C or U."""
    count = taxon_counts(hits, keys).join(tree.select("taxid", "path"), "taxid")
    gathered = count.groupBy(*keys).agg(F.collect_list(F.struct("taxid", "path", "hits")).alias("parts"))
    joined = reads.join(gathered, keys, "inner" if only_hit_reads else "left").withColumn("_best", best_path(F.col("parts")))
    call = walk_up(F.col("_best"), F.col("parts"), required_score(F.lit(confidence), F.col("n")))
    call = F.when(F.col("n") < min_groups, F.lit(0)).otherwise(F.coalesce(call, F.lit(0))).cast("long")
    return joined.withColumn("call", call).withColumn("status", F.when(F.col("call") > 0, "C").otherwise("U")).drop("parts", "_best")


def number_reads(reads: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds read_index, from 1, in the order given within the keys."""
    return reads.withColumn("read_index", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def mate_offsets(mates: DataFrame, keys: list[str], mate: str = "mate", n: str = "n") -> DataFrame:
    """Adds offset: k-mers of the mates before this one."""
    before = Window.partitionBy(*keys).orderBy(mate).rowsBetween(Window.unboundedPreceding, -1)
    return mates.withColumn("offset", F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long"))


def hit_strings(reads: DataFrame, hits: DataFrame, keys: list[str], ambiguous: DataFrame | None = None) -> DataFrame:
    """keys, hit_string: runs of equal taxa along the positions as taxid:count, 0 where nothing was hit, mates parted by |:|.

    reads (keys, n1, n2 or null), hits (keys, pos, taxid). Runs are islands of consecutive positions, so no row is made for a position
    without a hit; ``ambiguous`` (keys, pos) become A:count.
    """
    named = hits.select(*keys, "pos", F.col("taxid").cast("string").alias("token"))
    if ambiguous is not None:
        named = named.unionByName(ambiguous.select(*keys, "pos", F.lit("A").alias("token")))
    size = reads.select(*keys, F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"))
    placed = named.join(size, keys).withColumn("mate", F.when(F.col("pos") > F.col("n1"), 2).otherwise(1))
    island = Window.partitionBy(*keys, "mate", "token").orderBy("pos")
    run = placed.withColumn("island", F.col("pos") - F.row_number().over(island)).groupBy(*keys, "mate", "token", "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    along = Window.partitionBy(*keys, "mate").orderBy("first")
    start = F.when(F.col("mate") == 2, F.col("n1")).otherwise(0)
    run = run.join(size, keys).withColumn("gap", F.col("first") - 1 - F.coalesce(F.lag("last").over(along), start))
    text = F.concat(F.when(F.col("gap") > 0, F.concat(F.lit("0:"), F.col("gap").cast("string"), F.lit(" "))).otherwise(""), "token", F.lit(":"), (F.col("last") - F.col("first") + 1).cast("string"))
    each = run.withColumn("text", text).groupBy(*keys, "mate").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]), " ").alias("text"), F.max("last").alias("end"))
    part = {m: each.filter(F.col("mate") == m).select(*keys, F.col("text").alias(f"text{m}"), F.col("end").alias(f"end{m}")) for m in (1, 2)}
    out = size.join(part[1], keys, "left").join(part[2], keys, "left")

    def whole(m: int) -> Column:
        n = F.col("n1") if m == 1 else F.col("n1") + F.col("n2")
        rest = n - F.coalesce(f"end{m}", F.lit(0) if m == 1 else F.col("n1"))
        return F.concat_ws(" ", F.col(f"text{m}"), F.when(rest > 0, F.concat(F.lit("0:"), rest.cast("string"))))

    return out.select(*keys, F.when(F.col("n2").isNull(), whole(1)).otherwise(F.concat(whole(1), F.lit(" |:| "), whole(2))).alias("hit_string"))


def classification_lines(calls: DataFrame, strings: DataFrame, keys: list[str], carried: list[str] = ()) -> DataFrame:
    """keys, carried columns of calls, status, read_id, taxid, seq_len, hit_string: one line per read."""
    return calls.join(strings, keys).select(*keys, *carried, "status", trim_pair(F.col("read_id")).alias("read_id"), F.col("call").alias("taxid"), "seq_len", "hit_string")


def append_names(lines: DataFrame, report: DataFrame) -> DataFrame:
    """Lines with the name that the report has for their taxid, NA if none."""
    names = report.select("taxid", F.trim("name").alias("name"))
    return lines.join(names, "taxid", "left").withColumn("name", F.coalesce("name", F.lit("NA")))
