"""Text tables: nodes and names dumps, identifier maps, manifests, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELD_BREAK = r"\t\|\t|\t\|$"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """taxid, parent, rank; the root's parent is 0; blank, comment and short lines are left out, numbers that are none are errors."""
    fields = F.split(F.rtrim("value"), FIELD_BREAK)
    rows = _lines(spark, path).filter(~F.col("value").rlike(r"^\s*(#|$)")).select(fields.alias("f")).filter(F.size("f") >= 3)
    taxid = F.trim(F.col("f")[0]).cast("long")
    return rows.select(taxid.alias("taxid"), F.when(taxid == 1, F.lit(0)).otherwise(F.trim(F.col("f")[1]).cast("long")).alias("parent"), F.trim(F.col("f")[2]).alias("rank"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """taxid, name: scientific names only."""
    fields = F.split(F.rtrim("value"), FIELD_BREAK)
    rows = _lines(spark, path).filter(~F.col("value").rlike(r"^\s*(#|$)")).select(fields.alias("f")).filter(F.size("f") >= 4)
    return rows.filter(F.trim(F.col("f")[3]) == "scientific name").select(F.trim(F.col("f")[0]).cast("long").alias("taxid"), F.trim(F.col("f")[1]).alias("name"))


def read_nodes_with_names(spark: SparkSession, nodes: str, names: str) -> DataFrame:
    """taxid, parent, rank, name; null for nodes without a scientific name."""
    return read_nodes(spark, nodes).join(read_names(spark, names), "taxid", "left")


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, taxid from the first two words of each line; lines without a number are left out, the last of equal identifiers counts."""
    rows = _lines(spark, path).withColumn("at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    words = F.split(F.trim("value"), r"\s+")
    parsed = rows.select("at", F.get(words, F.lit(0)).alias("seq_id"), F.get(words, F.lit(1)).try_cast("long").alias("taxid")).filter("taxid is not null")
    return parsed.groupBy("seq_id").agg(F.max_by("taxid", "at").alias("taxid"))


def read_sample_map(spark: SparkSession, path: str) -> DataFrame:
    """read_index, read_id, seq_len, n1, n2 (null for single reads)."""
    f = F.split("value", "\t", 4)
    counts = F.split(F.get(f, F.lit(3)), r"\|")
    return _lines(spark, path).filter(F.size(f) == 4).select(F.get(f, F.lit(0)).cast("long").alias("read_index"), F.get(f, F.lit(1)).alias("read_id"), F.get(f, F.lit(2)).alias("seq_len"), F.get(counts, F.lit(0)).cast("int").alias("n1"), F.get(counts, F.lit(1)).cast("int").alias("n2"))


def read_file_map(spark: SparkSession, path: str) -> DataFrame:
    """file_index, paths of the files of each sample."""
    f = F.split("value", "\t", 2)
    return _lines(spark, path).filter(F.size(f) == 2).select(F.get(f, F.lit(0)).cast("int").alias("file_index"), F.split(F.get(f, F.lit(1)), ",").alias("paths"))


def read_manifest(spark: SparkSession, path: str | list[str], site: str, directory: str) -> DataFrame:
    """taxid, path of the genomes that an assembly summary names; rows without a download path are left out."""
    f = F.split("value", "\t")
    rows = _lines(spark, path).filter(~F.col("value").startswith("#")).select(F.get(f, F.lit(5)).alias("taxid"), F.trim(F.get(f, F.lit(19))).alias("ftp")).filter("taxid is not null and ftp is not null and ftp not in ('', 'na')")
    base = F.element_at(F.split("ftp", "/"), -1)
    return rows.select(F.trim("taxid").try_cast("long").alias("taxid"), F.concat(F.lit(f"{directory.rstrip('/')}/{site}/"), base, F.lit("_genomic.fna.gz")).alias("path")).filter("taxid is not null")


def read_processed_log(spark: SparkSession, path: str) -> DataFrame:
    """path, md5 of files already in the library."""
    f = F.split("value", "\t")
    return _lines(spark, path).filter(F.size(f) >= 2).select(F.get(f, F.lit(0)).alias("path"), F.trim(F.get(f, F.lit(1))).alias("md5"))


def last_file_index(spark: SparkSession, path: str) -> DataFrame:
    """last: the greatest first field of a sample map, 0 for an empty one; a field that is no number counts as 1."""
    first = F.get(F.split("value", "\t"), F.lit(0))
    return _lines(spark, path).filter(F.length(F.trim("value")) > 0).agg(F.coalesce(F.max(F.coalesce(first.try_cast("int"), F.lit(1))), F.lit(0)).alias("last"))
