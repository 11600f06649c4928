"""Writers: FASTA by size, partitions, calls, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.report import kreport_lines


def write_fasta(records: DataFrame, path: str, max_records: int = 0, partitions: int | None = None) -> None:
    """FASTA text of (header, seq); ``max_records`` bounds each file, so size is bounded where sequences are."""
    text = records.select(F.concat(F.when(F.col("header").startswith(">"), F.col("header")).otherwise(F.concat(F.lit(">"), "header")), F.lit("\n"), "seq").alias("value"))
    if partitions:
        text = text.repartition(partitions)
    text.write.mode("overwrite").option("maxRecordsPerFile", max_records).text(path)


def write_sized_fasta(records: DataFrame, path: str, limit: int, order: str) -> None:
    """Files of about ``limit`` bytes, each beginning at a record of a taxid header; one folder per suffix."""
    from ..operators.library import size_groups

    sized = records.withColumn("size", F.octet_length("header") + F.octet_length("seq") + 2)
    grouped = size_groups(sized, limit, order, start=F.col("header").contains("taxid|"))
    text = F.concat("header", F.lit("\n"), "seq").alias("value")
    grouped.select("suffix", order, text).repartition("suffix").sortWithinPartitions("suffix", order).select("suffix", "value").write.mode("overwrite").partitionBy("suffix").text(path)


def write_partitions(rows: DataFrame, path: str, partition: str) -> None:
    """One folder per value of a column, one file each per task that holds it."""
    rows.repartition(partition).write.mode("overwrite").partitionBy(partition).parquet(path)


def write_hits(hits: DataFrame, path: str, batches: int) -> None:
    """Hits by file and bucket of reads, so that a read's hits lie in one folder."""
    placed = hits.withColumn("bucket", F.pmod("read_index", F.lit(batches)).cast("int"))
    placed.repartition("file_index", "bucket").write.mode("overwrite").partitionBy("file_index", "bucket").parquet(path)


def write_calls(lines: DataFrame, path: str) -> None:
    """status, read_id, taxid, seq_len, hit_string as tab-separated text, a folder per file_index; its files are ranges of the reads, in order."""
    value = F.concat_ws("\t", "status", "read_id", F.col("taxid").cast("string"), "seq_len", "hit_string")
    placed = lines.select("file_index", "read_index", value.alias("value")).repartitionByRange("file_index", "read_index").sortWithinPartitions("file_index", "read_index")
    placed.drop("read_index").write.mode("overwrite").partitionBy("file_index").text(path)


def write_kreport(report: DataFrame, path: str, kmer_data: bool = False) -> None:
    """A report as one text file; it has a row per reported taxon."""
    kreport_lines(report, kmer_data=kmer_data).coalesce(1).sortWithinPartitions("ord").select("value").write.mode("overwrite").text(path)


def write_mpa(report: DataFrame, path: str) -> None:
    report.coalesce(1).sortWithinPartitions("ord").select(F.concat_ws("\t", "lineage", F.col("clade_count").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_sample_map(samples: DataFrame, path: str) -> None:
    """file_index and the paths of each sample, as written provenance."""
    samples.select(F.concat_ws("\t", F.col("file_index").cast("string"), F.array_join("paths", ",")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
