"""Library upkeep: headers, identifiers, content dedup, merging of maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rewrite_header(header: Column, taxid: Column) -> Column:
    """A header line (with or without >) under a taxid: >taxid|T|rest."""
    return F.concat(F.lit(">taxid|"), taxid.cast("string"), F.lit("|"), F.regexp_replace(header, "^>", ""))


def header_id(header: Column) -> Column:
    """First word of a header, without >; null if there is none."""
    return F.nullif(F.regexp_extract(header, r"^>?\s*(\S+)", 1), F.lit(""))


def header_taxid(header: Column) -> Column:
    """The taxid that a header's first word names: the digits after the first part that contains ``taxid`` and is followed by digits."""
    parts = F.split(header_id(header), "\\|")
    pairs = F.arrays_zip(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1)).alias("k"), F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)).alias("v"))
    fit = F.filter(pairs, lambda p: p["k"].contains("taxid") & p["v"].rlike("^[0-9]+$"))
    return F.try_element_at(fit, F.lit(1))["v"].try_cast("long")


def library_map(headers: DataFrame, strict: bool = True) -> DataFrame:
    """seq_id, taxid of header lines; an error at run time for a header without taxid, unless not strict."""
    found = headers.select(header_id(F.col("header")).alias("seq_id"), header_taxid(F.col("header")).alias("taxid"), "header")
    if strict:
        taxid = F.when(F.col("taxid").isNotNull(), F.col("taxid")).otherwise(F.raise_error(F.concat(F.lit("no taxid in header: "), F.coalesce("header", F.lit("")))).cast("long"))
        return found.select("seq_id", taxid.alias("taxid"))
    return found.filter("taxid is not null").select("seq_id", "taxid")


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row per key with the value of the last row in order."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def new_content(files: DataFrame, known: DataFrame, order: str = "path") -> DataFrame:
    """Files (path, content or md5) whose md5 is not known and not that of an earlier one in order."""
    hashed = files if "md5" in files.columns else files.withColumn("md5", F.md5("content"))
    fresh = hashed.join(known.select("md5").distinct(), "md5", "left_anti")
    first = fresh.groupBy("md5").agg(F.min(order).alias(order))
    return fresh.join(first, ["md5", order], "left_semi")


def map_conflicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Identifiers whose taxid differs: seq_id, old_taxid, new_taxid."""
    joined = new.select("seq_id", F.col("taxid").alias("new_taxid")).join(old.select("seq_id", F.col("taxid").alias("old_taxid")), "seq_id")
    return joined.filter("old_taxid <> new_taxid").select("seq_id", "old_taxid", "new_taxid").distinct()


def map_additions(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.select("seq_id", "taxid").distinct().join(old, "seq_id", "left_anti")


def merge_maps(old: DataFrame, new: DataFrame) -> DataFrame:
    """The map with the additions; an error if an identifier changes its taxid, before anything is written."""
    clash = map_conflicts(old, new).limit(5).collect()
    if clash:
        raise ValueError(f"identifiers with another taxid: {[(r.seq_id, r.old_taxid, r.new_taxid) for r in clash]}")
    return old.select("seq_id", "taxid").unionByName(map_additions(old, new))


def concatenate(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def size_groups(records: DataFrame, limit: int, order: str, size: str = "size", start: Column | None = None, parts: int = 200) -> DataFrame:
    """Adds suffix: the number of the output file of ``limit`` bytes that each record starts in, in a numeric order.

    ``start``: where a new file may begin; other records stay with the one before. Running sums are taken in ``parts`` ranges of the
    order and completed by prefix sums over the ranges, so that no task sees all records.
    """
    cuts = records.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    rows = records.withColumn("_part", part)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    offset = rows.groupBy("_part").agg(F.sum(size).alias("_total")).select("_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    own = Window.partitionBy("_part").orderBy(order)
    at = F.floor((F.col("_offset") + F.coalesce(F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / limit)
    rows = rows.join(offset, "_part").withColumn("_at", at)
    if start is None:
        return rows.withColumn("suffix", F.col("_at").cast("int")).drop("_part", "_offset", "_at")
    rows = rows.withColumn("_start", F.when(start, F.col("_at")))
    last = rows.groupBy("_part").agg(F.max("_start").alias("_last")).select("_part", F.max("_last").over(earlier).alias("_before"))
    here = F.max("_start").over(own.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.join(last, "_part").withColumn("suffix", F.coalesce(here, F.col("_before"), F.lit(0)).cast("int"))
    return out.drop("_part", "_offset", "_at", "_start", "_before")
