"""Sharding by balanced label propagation, in DataFrame operations only.

Linked rows are the members of a hub; the operator takes any (row, hub) table, and by default a hub is a text and its members are the rows
with that text. Rows start in shards dealt by hash. In each step the members of every hub learn in which shard most of them are
and ask to move there. How many may go from a shard to another is a quota: as many as come the other way, and a share of what the
target's capacity still allows (``SLACK`` above an even share; rows without links give way at the end, so they take none of it). Small hubs are admitted whole, large ones member by member, so one that exceeds a shard is cut only where the
capacity demands it. Steps end when no row asks to move, and after ``STEPS`` in any case: what still asks then stays where it is. At the end rows in excess of a shard's exact size go to the shards that lack some, rows without links first.

The law is ``rows``: counts differ by one at most. Ranks come from prefix sums over counts of small buckets and a row number
inside a bucket, so no shard is ever sorted in one task; a hub of more than ``HEAVY`` rows is dealt into parts of about that size, both there and where
its members meet its counts. The driver sees only shard-by-shard counts.

Defined cases: null text is linked with empty text (size 1, checksum 0); null identifiers and rows repeated in full are
rows of their own with slots of their own; very long texts are hashed and measured, nothing else; of equal pulls the tie goes by a hash; an empty table gives an empty result; fewer rows than shards leave shards empty; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, rank_buckets

SHARDS = 16
STEPS = 6
SLACK = 0.1
WHOLE, WHOLE_LEAST = 0.05, 8
HEAVY = 2000


def _splits(members: Column, capacity: float) -> Column:
    """Whether a hub is so large that its members move one by one."""
    return members > max(WHOLE_LEAST, WHOLE * capacity)


def _parts(members: Column) -> Column:
    """Into how many parts of about ``HEAVY`` rows a hub is dealt."""
    return F.ceil(members / float(HEAVY)).cast("int")


def _part(members: Column) -> Column:
    return F.pmod(F.xxhash64("rid", F.lit(11)), _parts(members)).cast("int")


def _quotas(asked: dict[tuple[int, int], int], size: list[int], capacity: int) -> list[float]:
    """Admitted share of the moves from each shard to each other one, flat: swaps, then what free capacity allows."""
    n = len(size)
    quota = {(i, j): min(m, asked.get((j, i), 0)) for (i, j), m in asked.items()}
    for j in range(n):
        rest = {i: asked[i, j] - quota[i, j] for i in range(n) if asked.get((i, j), 0) > quota.get((i, j), 0)}
        share = min(1.0, max(0, capacity - size[j]) / max(1, sum(rest.values())))
        for i, m in rest.items():
            quota[i, j] += m * share
    return [quota.get((i, j), 0) / asked[i, j] if asked.get((i, j)) else 0.0 for i in range(n) for j in range(n)]


def _counts(df: DataFrame, *cols: str) -> dict:
    """Rows by combination of a few values (shards): a bounded table."""
    return {tuple(r[c] for c in cols): r["count"] for r in df.groupBy(*cols).count().collect()}


def _at(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def _ranked(df: DataFrame, shard: str, bucket: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the exact rank (from 0) of each row in its shard, by bucket and then order."""
    count = df.groupBy(shard, *bucket).agg(F.count("*").cast("long").alias("_n"))
    before = Window.partitionBy(shard).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    first = count.select(shard, *bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy(shard, *bucket).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(own)).join(first, [shard, *bucket]).withColumn(name, F.col("_first") + F.col("_nth") - 1).drop("_first", "_nth")


def propagate(scratch: Scratch, rows: DataFrame, links: DataFrame, shards: int, n_rows: int, steps: int = STEPS) -> DataFrame:
    """(rid, label, hubs): the shard each linked row of ``links`` (rid, hub) has moved to; ``rows`` (rid, start) are all rows."""
    capacity = -int(-n_rows * (1 + SLACK) // shards)
    degree = links.groupBy("hub").agg(F.count("*").alias("members")).filter("members > 1")
    # a table of its own, so that the join can deal the rows of a hot hub to several tasks
    degree = scratch.table(degree, "degree")
    linked = scratch.table(links.join(degree, "hub").select("rid", "hub", "members"), "links")
    own = scratch.table(linked.groupBy("rid").agg(F.max("members").alias("members"), F.max_by("hub", "members").alias("lead")).join(rows, "rid").select("rid", "members", "lead", F.col("start").alias("label")), "label-0")
    size = _counts(own, "label")
    size = [size.get((j,), 0) for j in range(shards)]
    for step in range(steps):
        seen = linked.join(own.select("rid", "label"), "rid").groupBy("hub", "label").agg(F.count("*").alias("n"), F.max("members").alias("of"))
        # a hub's members pull with the share that they are of it; those of a large one meet its counts in several places
        seen = seen.select("hub", "label", "n", F.explode(F.sequence(F.lit(0), _parts(F.col("of")) - 1)).alias("part"))
        pull = linked.withColumn("part", _part(F.col("members"))).join(seen, ["hub", "part"]).groupBy("rid", "label").agg(F.sum(F.col("n") / F.col("members")).alias("pull"), F.max(F.xxhash64("hub", "label")).alias("tie"))
        best = pull.groupBy("rid").agg(F.max_by("label", F.struct("pull", "tie")).alias("to"))
        asks = own.join(best, "rid")
        draw = F.when(_splits(F.col("members"), capacity), F.xxhash64("rid", F.lit(step))).otherwise(F.xxhash64("lead", "label", F.lit(step)))
        asks = scratch.table(asks.withColumn("draw", F.pmod(draw, F.lit(1 << 30)) / float(1 << 30)), f"asks-{step}")
        large = _splits(F.col("members"), capacity).cast("int")
        asked = _counts(asks.filter("label <> to").withColumn("large", large), "large", "label", "to")
        if not asked:
            break
        # small hubs choose first; large ones get what capacity is left
        quotas, left = [], list(size)
        for kind in (0, 1):
            own_asks = {(i, j): m for (k, i, j), m in asked.items() if k == kind}
            quotas += _quotas(own_asks, left, capacity)
            for (i, j), m in own_asks.items():
                moved = int(m * quotas[kind * shards * shards + i * shards + j])
                left[i] -= moved
                left[j] += moved
        go = F.col("draw") < _at(quotas, large * shards * shards + F.col("label") * shards + F.col("to"))
        own = scratch.table(asks.select("rid", "members", "lead", F.when(go, F.col("to")).otherwise(F.col("label")).alias("label"), F.col("label").alias("was")), f"label-{step + 1}")
        for (i, j), m in _counts(own.filter("label <> was"), "was", "label").items():
            size[i] -= m
            size[j] += m
        own = own.drop("was")
    return own


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hub"))
    base = scratch.table(base.withColumn("start", F.pmod(F.xxhash64("rid", F.lit(5)), F.lit(shards)).cast("int")), "base")
    n_rows = base.count()
    own = propagate(scratch, base.select("rid", "start"), base.select("rid", "hub"), shards, n_rows)
    buckets = rank_buckets(n_rows)
    capacity = n_rows / shards
    whole = ~_splits(F.col("members"), capacity)
    label = F.coalesce("label", "start")
    # rows without links leave first, then small groups as wholes
    moved = base.join(own, "rid", "left").select(*base.columns, label.alias("label"), F.when(F.col("members").isNull(), 0).otherwise(1).alias("tied"), F.when(whole, F.col("hub")).otherwise(F.col("rid")).alias("unit"), F.when(whole & (F.col("members") > HEAVY), F.col("members")).alias("heavy"))
    # a hub beyond HEAVY rows has places of its own behind its bucket's other rows, in parts
    moved = moved.withColumns({"bucket": F.pmod(F.xxhash64("unit"), F.lit(buckets)), "own": F.when(F.col("heavy").isNull(), 0).otherwise(F.col("unit")), "part": F.when(F.col("heavy").isNull(), 0).otherwise(_part(F.col("heavy")))})
    moved = scratch.table(moved.drop("heavy"), "moved")
    have = _counts(moved, "label")
    have = [have.get((j,), 0) for j in range(shards)]
    want = [n_rows // shards] * shards
    for j in sorted(range(shards), key=lambda j: -have[j])[: n_rows % shards]:
        want[j] += 1
    excess, lack = [max(0, h - w) for h, w in zip(have, want, strict=True)], [max(0, w - h) for h, w in zip(have, want, strict=True)]
    before = [sum(excess[:j]) for j in range(shards)]
    filled = [sum(lack[: j + 1]) for j in range(shards)]
    ranked = _ranked(moved, "label", ["tied", "bucket", "own", "part"], ["unit", "rid"], "rank")
    pool = _at(before, F.col("label")) + F.col("rank")
    target = F.size(F.filter(F.array(*[F.lit(f) for f in filled]), lambda f: f <= pool))
    placed = ranked.withColumn("shard", F.when(F.col("rank") < _at(excess, F.col("label")), target).otherwise(F.col("label")).cast("int"))
    placed = scratch.table(placed.select("rid", "doc_id", "size", "text_crc32", "shard").withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(buckets))), "placed")
    scratch.clear("placed")
    out = _ranked(placed, "shard", ["bucket"], ["rid"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


QUERIES = {"op5_sharding": op5_sharding}
SQL: dict[str, str] = {}
