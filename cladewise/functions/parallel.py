"""How a table is dealt before heavy work on each row."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def dealt(df: DataFrame) -> DataFrame:
    """At least one task a core for a scan of few splits (small tables); others stay as they are.

    A plan with an exchange is dealt by it; asking for its partitions would run it, so only its text is looked at.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def cut(df: DataFrame) -> DataFrame:
    """A small result that several parts of a plan use, computed once and written to the folder of ``spark.checkpoint.dir``.

    Where none is set and all runs on one machine (as in tests), to a temporary one.
    """
    _scratch(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame) -> DataFrame:
    """As ``cut``, for tables that may be large: written once to that folder (a checkpoint computes its plan twice) and read as files, whose size Spark knows."""
    path = f"{_scratch(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _scratch(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="scratch-"))
    return context.getCheckpointDir()
