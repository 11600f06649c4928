"""Mixing sources to target weights by Poisson replication.

A source of b bytes whose target weight is w gets the mean repetition rate w T / b, T being the bytes of the whole: the mixture keeps
the size of the corpus and has each source in its weight. A document's number of copies is the inverse of the Poisson distribution with
that mean at a uniform number hashed from the seed and the document, so it depends on nothing else and is the same after any
retry. Copies are dealt out by a second hash, which also orders each partition: a global shuffle.

Only the per-source table is aggregated (one row for each source, combined before the shuffle); it meets the documents in an ordinary
join, which Spark broadcasts or splits by size and skew.

Defined cases: null sources are one source; null text counts as no bytes, each document as one byte more; a source that ``weights``
does not name has weight 0 and no copies; documents that share an identifier draw the same number (null identifiers draw by their
text); rows repeated in full are drawn each, with the same number; very long texts are carried whole; means over 256 are drawn in parts; an empty table gives an empty result; extra columns are carried, but for the names ``copy``,
``n_copies`` and ``place``, which are written anew.

The SQL checks less than the operator does: it has at most 200 copies of a document, draws in one part whatever the rate (the operator: in parts of at
most ``PART``), and leaves out documents of a null source and those without an identifier. It holds for rates well below 200 and tables without
such nulls; what is beyond is held by a test against draws written out in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, unit

SEED = "mix-1"
TEMPERATURE = 0.5
PART = 256.0


def target_weights(size: DataFrame, weights: dict[str | None, float] | None) -> Column:
    """Unscaled weight of a source: as given, or its bytes to the power ``TEMPERATURE``."""
    if weights is None:
        return F.pow(F.col("bytes"), F.lit(TEMPERATURE))
    out = F.lit(0.0)
    for source, w in weights.items():
        out = F.when(F.col("mix_source").eqNullSafe(F.lit(source)), F.lit(float(w))).otherwise(out)
    return out


def repetition_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """mix_source, bytes, rate: mean number of copies of a document of each source."""
    size = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(1).cast("long")).alias("bytes"))
    size = size.withColumn("weight", target_weights(size, weights))
    total = size.agg(F.sum("bytes").alias("total"), F.sum("weight").alias("weights"))
    return size.crossJoin(total).select("mix_source", "bytes", F.coalesce(F.try_divide(F.col("weight") / F.col("weights") * F.col("total"), F.col("bytes")), F.lit(0.0)).alias("rate"))


def poisson_table(rates: DataFrame) -> DataFrame:
    """Adds ``parts`` and ``cdf``: the distribution function at 0, 1, ... of a Poisson variable of mean rate / parts."""
    out = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    steps = F.sequence(F.lit(1), F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 30).cast("int"))
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return out.withColumn("cdf", F.aggregate(steps, start, step)["cdf"])


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The columns of docs, and copy (from 1), n_copies, place; rows shuffled globally."""
    own = [c for c in docs.columns if c not in ("copy", "n_copies", "place")]
    table = poisson_table(repetition_rates(docs, weights, source_col, text_col)).select("mix_source", "parts", "cdf")
    table = Scratch(docs.sparkSession).table(table, "rates")  # its size is then known, and with it the kind of join
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    # the row travels as one column, so names of its own cannot clash with those used here
    rows = docs.select(F.struct(*own).alias("row"), key.alias("key"), F.col(source_col).alias("of"))
    draw = lambda part: F.size(F.filter("cdf", lambda c: c <= unit(F.col("key"), part, seed=seed)))
    copies = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda n, part: n + draw(part))
    drawn = rows.join(table, F.col("of").eqNullSafe(F.col("mix_source"))).withColumn("n_copies", copies).filter("n_copies > 0")
    each = drawn.select("row", "key", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}-place"), "key", F.col("copy").cast("string"))), 1, 13), 16, 10).cast("long")
    placed = each.withColumn("place", place)
    return placed.repartition("place").sortWithinPartitions("place", "copy").select(*[F.col("row")[c].alias(c) for c in own], "copy", "n_copies", "place")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


QUERIES = {"op6_mixing": op6_mixing}
SQL = {
    "op6_mixing": f"""
with b as (select source, sum(coalesce(strlen(text), 0) + 1) as bytes from documents group by source),
t as (select *, pow(bytes, {TEMPERATURE}) as weight from b),
l as (select source, weight / (select sum(weight) from t) * (select sum(bytes) from b) / bytes as rate from t),
p as (select source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) as p from l, range(0, 200) r(k)),
c as (select source, k, sum(p) over (partition by source order by k) as cdf from p),
u as (select *, ('0x' || substr(md5('{SEED}:' || doc_id || ':1'), 1, 13))::bigint / pow(2, 52) as u from documents),
n as (select u.doc_id, count(*) as n from u join c on u.source = c.source and c.cdf <= u.u group by u.doc_id),
e as (select documents.*, n, unnest(range(1, n + 1)) as copy from documents join n using (doc_id))
select doc_id, text, lang, source, n_chars, cast(copy as int) as copy, cast(n as int) as n_copies,
  ('0x' || substr(md5('{SEED}-place:' || doc_id || ':' || copy), 1, 13))::bigint as place from e"""
}
