"""Classification of reads that keep arriving: a stream of reads meets the static index, micro-batch by micro-batch.

Hits need no state (each read is whole in its row), so a batch is classified by the same plan as a table and appended; the batch's number is a
column of what is written, and a batch that is run again after a failure replaces its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import report
from ..plans import api

READS = "file_index int, read_index long, read_id string, seq1 string, seq2 string"


def reads_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of reads as they come."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def classify_stream(reads: DataFrame, db: api.Database, out: str, checkpoint: str, mode: str = "auto", confidence: float = 0.0, min_groups: int = 2) -> StreamingQuery:
    """Starts the query; calls go to ``out``/batch=N, counts per taxon beside them for running reports."""

    def each(batch: DataFrame, number: int) -> None:
        found = api.classify(db, batch, mode, confidence, min_groups)
        calls = found.calls.persist()
        calls.select(*found.keys, "read_id", "call", "status", "n").write.mode("overwrite").parquet(f"{out}/calls/batch={number}")
        counts = calls.groupBy("file_index", "call").agg(F.count("*").alias("reads"))
        counts.write.mode("overwrite").parquet(f"{out}/counts/batch={number}")
        calls.unpersist()

    return reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_report(spark: SparkSession, out: str, tree: DataFrame) -> DataFrame:
    """The report of all batches so far."""
    calls = spark.read.parquet(f"{out}/calls").select("call")
    return report.kreport(tree, report.clade_counts(calls, tree), report.totals(calls))


def windowed_counts(events: DataFrame, by: str, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per window of event time and key, with a bound on lateness; for streams of dated calls."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
