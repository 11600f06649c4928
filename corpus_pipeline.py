"""A training corpus from ``documents``: five stages, each one operator over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cladewise.llm.common import Scratch, documents
from cladewise.llm.decontamination import drop_contaminated
from cladewise.llm.minhash_dedup import keep_distinct
from cladewise.llm.mixing import mix_sources
from cladewise.llm.quality import keep_quality
from cladewise.llm.sharding import shard_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps (operator 8).

    Nulls and empty texts are scored by the thresholds alone; very long texts are read whole; repeated rows and rows that share an identifier are
    scored each; without labels, or with one grade, all documents get that grade or stay; an empty table stays empty; all columns are carried.
    """
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (operator 7), that of the smallest identifier.

    Null texts and texts without words are linked with nothing and stay; null identifiers count as the largest; rows that share an identifier stay
    or go together, of those with one text too one stays; very long texts are compared whole; an empty table stays empty; all columns are carried.
    """
    return keep_distinct(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 9).

    Null and empty texts hold nothing and stay; null or empty items are found nowhere; very long texts are searched whole; repeated rows and null
    identifiers are judged by their text; no items or no documents change nothing; all columns are carried.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, shuffled globally (operator 6).

    Null sources are one source; null texts count one byte; rows that share an identifier draw one number of copies, null identifiers draw by their
    text; texts of any length are carried whole; an empty table stays empty; all columns are carried.
    """
    return mix_sources(docs).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document (operator 5).

    Null texts are linked with empty ones; copies made by the mixing are linked rows with slots of their own, as are null and shared identifiers;
    a group beyond a shard's size is cut; an empty table gives an empty result; other columns are not read.
    """
    return shard_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: The fitted classifier and the iterative stages have no SQL form; tests hold each stage against planted rows and a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage keeps is written and read again by the next one."""
    scratch, docs, before = Scratch(spark), documents(spark, sf_dir), None
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{i}-{name}")
        if before:
            scratch.drop(before)
        before = f"{i}-{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
