"""Finding inputs, through Spark's file systems (any store that Spark reads)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str | list[str], pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, name, length of files; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    rows = reader.load(root)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def numbered_files(files: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """Files prefix_N suffix with their number, in order."""
    number = F.regexp_extract("name", rf"^{prefix}_(\d+){suffix.replace('.', '[.]')}$", 1)
    return files.withColumn("number", number.try_cast("int")).filter("number is not null").orderBy("number")


def continuous(numbered: DataFrame) -> bool:
    """Whether the numbers run from 1 without a gap."""
    r = numbered.agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.count_distinct("number").alias("n")).first()
    return r.n == 0 or (r.lo == 1 and r.hi == r.n)


def grouped_files(files: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """Files prefix_G_B suffix by group: group, paths in order of B."""
    pattern = rf"^{prefix}_(\d+)_(\d+){suffix.replace('.', '[.]')}$"
    g, b = (F.regexp_extract("name", pattern, i).try_cast("int") for i in (1, 2))
    return files.select(g.alias("group"), b.alias("part"), "path").filter("group is not null").groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "path"))), lambda x: x["path"]).alias("paths"))


def expand_inputs(spark: SparkSession, paths: list[str]) -> list[str]:
    """Input paths; a single .txt is a list of them. All must exist."""
    if len(paths) == 1 and paths[0].endswith(".txt"):
        paths = [r.value.strip() for r in spark.read.text(paths[0]).collect() if r.value.strip()]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    missing = [p for p in paths if not (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
    if missing:
        raise FileNotFoundError(f"inputs not found: {missing}")
    return paths


def total_bytes(spark: SparkSession, root: str, pattern: str = "hash_*.k2d") -> DataFrame:
    return list_files(spark, root, pattern).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
