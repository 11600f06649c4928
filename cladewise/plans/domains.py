"""The driver tables seen as taxonomy, reads, hits and sequences; and the same in DuckDB SQL.

Domain T: region, nation and supplier are the tree; orders are reads, their line items hits (part numbers as minimizers; returned 'N' are misses; by
line number the taxon is the supplier, its nation or its region). Domain S: letters of texts as pseudo-DNA; benchmark items are
the library, documents the reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parallel import dealt
from ..operators import taxonomy as tax
from ..operators.minimizers import Scheme

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
PLAIN = Scheme(35, 31, spaces=0, toggle=0)
SHORT = Scheme(12, 8, spaces=0, toggle=0)
FULL = Scheme()
CONFIDENCE = 0.5
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- domain T -------------------------------------------------------------------------------------------------------


def nodes_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(name: str, taxid: str, parent: str, rank: str, label: str) -> DataFrame:
        return table(spark, sf_dir, name).selectExpr(f"CAST({taxid} AS BIGINT) AS taxid", f"CAST({parent} AS BIGINT) AS parent", f"'{rank}' AS rank", f"{label} AS name")

    root = spark.range(1).selectExpr("CAST(1 AS BIGINT) AS taxid", "CAST(0 AS BIGINT) AS parent", "'no rank' AS rank", "'root' AS name")
    regions = part("region", "10 + r_regionkey", "1", "superkingdom", "r_name")
    nations = part("nation", "100 + n_nationkey", "10 + n_regionkey", "family", "n_name")
    suppliers = part("supplier", "1000 + s_suppkey", "100 + s_nationkey", "species", "s_name")
    return root.unionByName(regions).unionByName(nations).unionByName(suppliers)


def tree_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tax.with_paths(nodes_t(spark, sf_dir))


def hits_t(spark: SparkSession, sf_dir: str, misses: bool = False) -> DataFrame:
    """file_index, read_index, pos, hash, taxid; ``misses``: with the positions that nothing hit (taxid 0)."""
    line = table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    place = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    turn = F.col("l_linenumber") % 3
    taxid = F.when(F.col("l_returnflag") == "N", 0).when(turn == 0, 1000 + F.col("l_suppkey")).when(turn == 1, 100 + F.col("s_nationkey")).otherwise(10 + F.col("n_regionkey"))
    out = line.withColumn("pos", pos).join(place, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("read_index"), "pos", F.col("l_partkey").alias("hash"), taxid.cast("long").alias("taxid"))
    return out if misses else out.filter("taxid > 0")


def reads_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_index, read_index, read_id, n (positions), seq_len; orders without lines have none."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("read_index")).agg(F.count("*").alias("n"))
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_index"), (F.col("o_custkey") % 4).alias("file_index"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("read_id"))
    return own.join(n, "read_index", "left").withColumn("n", F.coalesce("n", F.lit(0)))


NODES_SQL = """nodes as (select cast(1 as bigint) as taxid, cast(0 as bigint) as parent, 'no rank' as rank, 'root' as name
  union all select 10 + r_regionkey, 1, 'superkingdom', r_name from region
  union all select 100 + n_nationkey, 10 + n_regionkey, 'family', n_name from nation
  union all select 1000 + s_suppkey, 100 + s_nationkey, 'species', s_name from supplier)"""
TREE_SQL = f"""with recursive {NODES_SQL},
tree as (select taxid, parent, rank, name, 0 as depth, [taxid] as path, [rank] as rank_path, [name] as name_path from nodes where taxid = 1
  union all select n.taxid, n.parent, n.rank, n.name, t.depth + 1, list_append(t.path, n.taxid), list_append(t.rank_path, n.rank), list_append(t.name_path, n.name)
  from nodes n join tree t on n.parent = t.taxid),
closure as (select taxid, unnest(path) as anc, unnest(range(0, len(path))) as anc_depth from tree)"""
HITS_SQL = f"""{TREE_SQL},
lines as (select *, cast(row_number() over (partition by l_orderkey order by {", ".join(LINE_ORDER)}) as int) as pos from lineitem),
positions as (select l_orderkey as read_index, pos, l_partkey as hash, cast(case when l_returnflag = 'N' then 0 when l_linenumber % 3 = 0 then 1000 + l_suppkey
  when l_linenumber % 3 = 1 then 100 + s_nationkey else 10 + n_regionkey end as bigint) as taxid
  from lines join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey),
hits as (select * from positions where taxid > 0),
reads as (select o_orderkey as read_index, o_custkey % 4 as file_index, 'order_' || o_orderkey as read_id, coalesce(n, 0) as n
  from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey),
cnt as (select read_index, taxid, count(*) as hits from hits group by all),
up as (select c.read_index, c.taxid, anc, anc_depth, hits from cnt c join closure using (taxid)),
score as (select u.read_index, u.taxid, cast(sum(c.hits) as bigint) as score from up u join cnt c on c.read_index = u.read_index and c.taxid = u.anc group by all),
clade as (select read_index, anc, cast(sum(hits) as bigint) as clade_hits from up group by all)"""


def calls_sql(confidence: float = CONFIDENCE, min_groups: int = 2) -> str:
    return f"""{HITS_SQL},
top as (select s.read_index, s.taxid from score s join (select read_index, max(score) as m from score group by 1) x using (read_index) where score = m),
best as (select read_index, arg_max(anc, anc_depth) as best from
  (select read_index, anc, anc_depth, count(*) as n from top join closure using (taxid) group by all) a join (select read_index, count(*) as k from top group by 1) b using (read_index) where n = k group by read_index),
called as (select b.read_index, arg_max(c.anc, c.anc_depth) as call from best b join closure c on c.taxid = b.best join clade x on x.read_index = b.read_index and x.anc = c.anc
  join reads r on r.read_index = b.read_index where x.clade_hits >= ceil(cast({confidence} as double) * r.n) group by 1),
calls as (select r.*, cast(case when r.n < {min_groups} then 0 else coalesce(call, 0) end as bigint) as call from reads r left join called using (read_index))"""


# --- domain S -------------------------------------------------------------------------------------------------------


def pseudo_dna(text: Column) -> Column:
    """Letters as A, C, G, T in turn, digits as a letter that is none, the rest left out."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[^a-zA-Z0-9]", ""), "[0-9]", "_")
    return F.translate(plain, LETTERS, "ACGT" * 13)


_TO_DNA = bytes.maketrans((LETTERS + "0123456789").encode(), b"ACGT" * 13 + b"_" * 10)
_LEFT_OUT = bytes(b for b in range(256) if b not in (LETTERS + "0123456789").encode())


def _dna(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("seq").cast(pa.large_binary())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1].tolist()
        data = memoryview(text.buffers()[2] or b"")
        seqs = [bytes(data[at:to]).translate(_TO_DNA, _LEFT_OUT) for at, to in zip(ends, ends[1:])]  # noqa: B905
        yield pa.record_batch([*(batch.column(c) for c in batch.schema.names[:-1]), pa.array(seqs, pa.binary()).cast(pa.string())], names=batch.schema.names)


def with_pseudo_dna(rows: DataFrame, text: str) -> DataFrame:
    """The rows with ``pseudo_dna`` of a text column as last column seq, by a table of bytes; the expression is the specification, and slower."""
    rows = dealt(rows.select(*[c for c in rows.columns if c != text], F.coalesce(text, F.lit("")).alias("seq")))
    return rows.mapInArrow(_dna, rows.schema)


def genomes_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return items.select((100 + F.col("item_id")).alias("taxid"), F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("seq_id"), pseudo_dna(F.col("text")).alias("seq"))


def tree_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root > four buckets of items > items."""
    ids = table(spark, sf_dir, "benchmark").select("item_id").distinct()
    root = spark.range(1).selectExpr("CAST(1 AS BIGINT) AS taxid", "CAST(0 AS BIGINT) AS parent", "'no rank' AS rank", "'root' AS name")
    buckets = ids.selectExpr("item_id % 4 AS b").distinct().selectExpr("10 + b AS taxid", "CAST(1 AS BIGINT) AS parent", "'genus' AS rank", "concat('bucket_', b) AS name")
    items = ids.selectExpr("100 + item_id AS taxid", "10 + item_id % 4 AS parent", "'species' AS rank", "concat('item_', item_id) AS name")
    return tax.with_paths(root.unionByName(buckets).unionByName(items))


def reads_s(spark: SparkSession, sf_dir: str, scheme: Scheme = PLAIN) -> DataFrame:
    """read_index, read_id, file_index, seq, n, n1, n2, seq_len of documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_index"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("/1")).alias("read_id"), F.lit(0).alias("file_index"), "text")
    docs = with_pseudo_dna(docs, "text")
    n = F.greatest(F.lit(0), F.length("seq") - scheme.k + 1)
    return docs.withColumns({"n": n, "n1": n, "n2": F.lit(None).cast("int"), "seq_len": F.length("seq").cast("string")})


def dna_sql(text: str) -> str:
    return f"translate(regexp_replace(regexp_replace(coalesce({text}, ''), '[^a-zA-Z0-9]', '', 'g'), '[0-9]', '_', 'g'), '{LETTERS}', '{'ACGT' * 13}')"


def kmers_sql(name: str, source: str, scheme: Scheme) -> str:
    """CTEs ending in ``name`` (id, pos, m): the least canonical l-mer, as text, of each k-mer of valid letters of ``source`` (id, seq)."""
    k, l = scheme.k, scheme.l  # noqa: E741
    return f"""{name}_w as (select id, len(seq) as n, i as pos, substr(seq, i, {l}) as w from (select id, seq, unnest(range(1, len(seq) - {l} + 2)) as i from {source} where len(seq) >= {k})),
{name}_c as (select id, n, pos, case when not contains(w, '_') then least(w, reverse(translate(w, 'ACGT', 'TGCA'))) end as c from {name}_w),
{name}_m as (select id, n, pos, min(c) over win as m, count(c) over win as full_ from {name}_c window win as (partition by id order by pos rows between current row and {k - l} following)),
{name} as (select id, pos, m from {name}_m where full_ = {k - l + 1} and pos <= n - {k} + 1)"""


def _u64(x: int) -> str:
    return f"cast({x} as uhugeint)"


MASK64 = _u64((1 << 64) - 1)


def _mul(x: str, by: int) -> str:
    return f"((({x}) * {_u64(by)}) & {MASK64})"


def _rotl(x: str, by: int) -> str:
    return f"((({x}) * {_u64(1 << by)}) & {MASK64}) + (({x}) // {_u64(1 << 64 - by)})"


def fmix_steps(name: str, source: str, x: str) -> str:
    """CTEs ending in ``name``: source with column ``x`` (uhugeint) mixed."""
    from ..functions.hashing import FMIX_1, FMIX_2

    fold = f"xor({x}, {x} // {_u64(1 << 33)})"
    return f"""{name}_a as (select * replace ({_mul(fold, FMIX_1)} as {x}) from {source}),
{name}_b as (select * replace ({_mul(fold, FMIX_2)} as {x}) from {name}_a),
{name} as (select * replace ({fold} as {x}) from {name}_b)"""


def murmur_steps(name: str, source: str, x: str) -> str:
    from ..functions.hashing import MURMUR_1, MURMUR_2, MURMUR_ADD

    return f"""{name}_1 as (select * replace ({_mul(x, MURMUR_1)} as {x}) from {source}),
{name}_2 as (select * replace ({_rotl(x, 31)} as {x}) from {name}_1),
{name}_3 as (select * replace ({_mul(x, MURMUR_2)} as {x}) from {name}_2),
{name}_4 as (select * replace ({_rotl(x, 27)} as {x}) from {name}_3),
{name}_5 as (select * replace (xor((({x} * {_u64(5)}) + {_u64(MURMUR_ADD)}) & {MASK64}, {_u64(8)}) as {x}) from {name}_4),
{fmix_steps(name, f"{name}_5", x)}"""


def signed_sql(x: str) -> str:
    return f"cast(case when {x} >= {_u64(1 << 63)} then cast({x} as hugeint) - 18446744073709551616 else cast({x} as hugeint) end as bigint)"


def number_sql(text: str) -> str:
    """Base-4 number of a text of A, C, G, T."""
    return f"list_reduce(list_transform(string_split(translate({text}, 'ACGT', '0123'), ''), lambda x: cast(x as uhugeint)), lambda a, b: a * cast(4 as uhugeint) + b)"
