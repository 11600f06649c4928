"""Byte ranges of files, read and written by tasks: no file has to fit into a row or into a task's memory.

Tasks open files by Arrow's file systems (local, HDFS, S3, GCS); other stores are not reached this way, and are an error that names the path.
"""

from __future__ import annotations

import re

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a range.
RANGE = 64 << 20


def location(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark's file system names it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub("^file:/+", "file:///", fs.makeQualified(p).toString())


def found(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """Files of a glob with their lengths, in order; names only, on the driver."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = fs.globStatus(p) or []
    if not len(status):
        raise FileNotFoundError(pattern)
    return [(re.sub("^file:/+", "file:///", s.getPath().toString()), s.getLen()) for s in status]


def opened(place: str):
    """A file to read from, in any order."""
    fs, path = _system(place)
    return fs.open_input_file(path)


def created(place: str):
    """A file to write to, from its start to its end."""
    fs, path = _system(place)
    return fs.open_output_stream(path)


def _system(place: str):
    try:
        return pafs.FileSystem.from_uri(place)
    except Exception as e:
        raise OSError(f"tasks can't open {place}: {e}") from e


def tasks(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A row a task; a few numbers for each range."""
    return spark.createDataFrame(rows, schema).repartition(max(1, len(rows)))
