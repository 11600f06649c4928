"""Queries over domain T, and the scalar functions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import scalars as S
from ..functions.parallel import cut
from ..operators import index, library, report, resolve
from ..operators import taxonomy as tax
from .domains import CONFIDENCE, HITS_SQL, NODES_SQL, TREE_SQL, calls_sql, fmix_steps, hits_t, murmur_steps, nodes_t, reads_t, signed_sql, table, tree_t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _calls(spark: SparkSession, sf_dir: str, confidence: float = CONFIDENCE, tree: DataFrame | None = None) -> DataFrame:
    return resolve.resolve(reads_t(spark, sf_dir), hits_t(spark, sf_dir), tree or tree_t(spark, sf_dir), ["read_index"], confidence)


# --- taxonomy ---------------------------------------------------------------------------------------------------------


@query(f"with {NODES_SQL} select taxid, case when taxid = 1 then 0 else parent end as parent, rank from nodes")
def taxonomy_nodes(spark, sf_dir):
    return nodes_t(spark, sf_dir).select("taxid", "parent", "rank")


@query(f"with {NODES_SQL} select taxid, name from nodes where rank <> 'no rank' or taxid = 1")
def taxonomy_names(spark, sf_dir):
    return nodes_t(spark, sf_dir).select("taxid", "name")


@query(f"{TREE_SQL} select taxid, parent, depth, array_to_string(path, '.') as path from tree")
def taxonomy_paths(spark, sf_dir):
    return tree_t(spark, sf_dir).select("taxid", "parent", "depth", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


@query(f"{TREE_SQL}, used as (select distinct 1000 + l_suppkey as taxid from lineitem where l_quantity > 49 and l_discount > 0.09) select distinct anc as taxid from closure join used using (taxid) union select 1")
def marked_nodes(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").filter("l_quantity > 49 and l_discount > 0.09").select((1000 + F.col("l_suppkey")).alias("taxid"))
    return tax.marked_nodes(tree_t(spark, sf_dir), used)


BFS_SQL = """, level1 as (select taxid, depth, parent, cast(1 as bigint) as nth from tree where depth = 0),
level2 as (select t.taxid, t.depth, t.parent, row_number() over (order by t.taxid) + 1 as nth from tree t where depth = 1),
level3 as (select t.taxid, t.depth, t.parent, row_number() over (order by p.nth, t.taxid) + (select count(*) from tree where depth < 2) as nth from tree t join level2 p on t.parent = p.taxid),
level4 as (select t.taxid, t.depth, t.parent, row_number() over (order by p.nth, t.taxid) + (select count(*) from tree where depth < 3) as nth from tree t join level3 p on t.parent = p.taxid),
numbered as (select taxid, depth, nth from level1 union all select taxid, depth, nth from level2 union all select taxid, depth, nth from level3 union all select taxid, depth, nth from level4)"""


@query(f"{TREE_SQL}{BFS_SQL} select taxid, cast(nth as int) as internal_id from numbered")
def bfs_internal_ids(spark, sf_dir):
    return tax.number_nodes(tree_t(spark, sf_dir)).select("taxid", "internal_id")


@query(f"{TREE_SQL}{BFS_SQL} select n.nth::int as internal_id, t.taxid as external_id, coalesce(p.nth, 0)::int as parent_id, t.rank, t.name, (select count(*) from tree c where c.parent = t.taxid)::int as children, len(t.path)::int as path_length from tree t join numbered n using (taxid) left join numbered p on p.taxid = t.parent")
def node_table(spark, sf_dir):
    return tax.node_table(tree_t(spark, sf_dir)).select("internal_id", "external_id", "parent_id", "rank", "name", F.size("child_ids").alias("children"), F.size("path").alias("path_length"))


@query(f"{TREE_SQL}{BFS_SQL} select s_suppkey, s_nationkey % 3 as kind, coalesce(nth, 0)::int as internal_id from supplier left join numbered on taxid = case when s_nationkey % 3 = 0 then 5 else 1000 + s_suppkey end")
def taxid_internal_map(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).alias("kind")).withColumn("taxid", F.when(F.col("kind") == 0, 5).otherwise(1000 + F.col("s_suppkey")).cast("long"))
    return tax.to_internal(wanted, tax.number_nodes(tree_t(spark, sf_dir))).select("s_suppkey", "kind", "internal_id")


@query(f"{TREE_SQL} select taxid, case depth when 0 then 'R' when 1 then 'D' when 2 then 'F' else 'S' end as rank_code from tree")
def rank_codes(spark, sf_dir):
    return tax.described(tree_t(spark, sf_dir)).select("taxid", "rank_code")


LINEAGE = "array_to_string(list_transform(list_zip(rank_path, name_path), lambda x: x[1] || ':' || x[2]), ' > ')"


@query(f"{TREE_SQL} select taxid, {LINEAGE} as lineage, array_to_string(list_transform(list_filter(list_zip(rank_path, name_path), lambda x: x[1] <> 'no rank'), lambda x: case x[1] when 'superkingdom' then 'd' when 'family' then 'f' else 's' end || '__' || x[2]), '|') as mpa from tree")
def lineage(spark, sf_dir):
    return tax.described(tree_t(spark, sf_dir)).select("taxid", "lineage", "mpa")


@query(f"{TREE_SQL} select taxid, {LINEAGE} as lineage from tree order by taxid limit 5")
def lineage_topn(spark, sf_dir):
    return tax.described(tree_t(spark, sf_dir)).select("taxid", "lineage").orderBy("taxid").limit(5)


@query(f"with {NODES_SQL}, r as (select distinct rank from nodes) select rank, cast(coalesce((select sum(strlen(s.rank) + 1) from r s where s.rank < r.rank), 0) as bigint) as offset from r")
def rank_offsets(spark, sf_dir):
    return tax.rank_offsets(nodes_t(spark, sf_dir))


@query(f"{TREE_SQL} select a.taxid as a, b.taxid as b, exists (select 1 from closure c where c.taxid = b.taxid and c.anc = a.taxid) as is_ancestor, coalesce((select arg_max(x.anc, x.anc_depth) from closure x join closure y on x.anc = y.anc where x.taxid = a.taxid and y.taxid = b.taxid), 0) as lca from tree a, tree b where a.depth < 3 and b.depth < 3")
def lca_pairs(spark, sf_dir):
    """All pairs of the three upper levels only; ``lca_line_pairs`` has the whole tree."""
    t = tree_t(spark, sf_dir).filter("depth < 3").select("taxid", "path")  # the upper levels, as in the SQL
    a, b = t.select(F.col("taxid").alias("a"), F.col("path").alias("pa")), t.select(F.col("taxid").alias("b"), F.col("path").alias("pb"))
    return a.crossJoin(b).select("a", "b", tax.is_ancestor(F.col("a"), F.col("pb")).alias("is_ancestor"), tax.lca(F.col("pa"), F.col("pb")).alias("lca"))


@query(f"""{HITS_SQL}, pairs as (select a, b from (select taxid as a, lead(taxid) over (partition by read_index order by pos) as b from positions) where b is not null union select parent, taxid from tree),
met as (select a, b, arg_max(x.anc, x.anc_depth) as lca from pairs join closure x on x.taxid = a join closure y on y.taxid = b and y.anc = x.anc group by a, b)
select a, b, c.anc is not null as is_ancestor, coalesce(lca, greatest(a, b)) as lca from pairs left join met using (a, b) left join closure c on c.taxid = b and c.anc = a""")
def lca_line_pairs(spark, sf_dir):
    """Ancestor test and LCA over the whole tree: the taxa of each position and the next one of its read (0 where nothing hit), and each node with its parent."""
    after = F.lead("taxid").over(Window.partitionBy("read_index").orderBy("pos"))
    lines = hits_t(spark, sf_dir, misses=True).select(F.col("taxid").alias("a"), after.alias("b")).filter("b is not null")
    t = tree_t(spark, sf_dir)
    pairs = lines.unionByName(t.select(F.col("parent").alias("a"), F.col("taxid").alias("b"))).distinct()
    a, b = t.select(F.col("taxid").alias("a"), F.col("path").alias("pa")), t.select(F.col("taxid").alias("b"), F.col("path").alias("pb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").select("a", "b", tax.is_ancestor(F.col("a"), F.col("pb")).alias("is_ancestor"), tax.lca(F.col("pa"), F.col("pb")).alias("lca"))


@query(f"{TREE_SQL}, members as (select distinct l_partkey as hash, 1000 + l_suppkey as taxid from lineitem), k as (select hash, count(*) as k from members group by 1), c as (select hash, anc, anc_depth, count(*) as n from members join closure using (taxid) group by all) select hash, arg_max(anc, anc_depth) as taxid from c join k using (hash) where n = k group by hash")
def lca_by_part(spark, sf_dir):
    """The index's aggregate on domain T: for each part the lowest common ancestor of its suppliers."""
    members = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("hash"), (1000 + F.col("l_suppkey")).alias("taxid")).distinct()
    return tax.lca_by(members, tree_t(spark, sf_dir), "hash")


# --- calls ------------------------------------------------------------------------------------------------------------


@query(f"{HITS_SQL} select read_index, taxid, hits from cnt")
def read_taxon_counts(spark, sf_dir):
    return resolve.taxon_counts(hits_t(spark, sf_dir), ["read_index"])


@query(f"{HITS_SQL} select read_index, taxid, score from score")
def rtl_score(spark, sf_dir):
    return resolve.root_to_leaf_scores(hits_t(spark, sf_dir), tree_t(spark, sf_dir), ["read_index"])


@query(f"{HITS_SQL} select u.read_index, u.anc, cast(sum(c.hits) as bigint) as hits_at_ancestor from up u join cnt c on c.read_index = u.read_index and c.taxid = u.anc group by all")
def ancestor_score(spark, sf_dir):
    count = resolve.taxon_counts(hits_t(spark, sf_dir), ["read_index"]).join(tree_t(spark, sf_dir).select("taxid", "path"), "taxid")
    up = count.select("read_index", F.explode("path").alias("anc"))
    return up.join(count.select("read_index", F.col("taxid").alias("anc"), "hits"), ["read_index", "anc"]).groupBy("read_index", "anc").agg(F.sum("hits").alias("hits_at_ancestor"))


@query(f"{HITS_SQL} select read_index, anc as taxid, clade_hits from clade")
def read_clade_sum(spark, sf_dir):
    return resolve.clade_sums(hits_t(spark, sf_dir), tree_t(spark, sf_dir), ["read_index"])


@query(f"{calls_sql()} select read_index, call, case when call > 0 then 'C' else 'U' end as status from calls")
def resolve_tree(spark, sf_dir):
    return _calls(spark, sf_dir).select("read_index", "call", "status")


@query(f"{calls_sql(0.0)} select read_index, call from calls")
def resolve_no_confidence(spark, sf_dir):
    return _calls(spark, sf_dir, 0.0).select("read_index", "call")


@query(f"{calls_sql(0.8)} select read_index, call from calls")
def confidence_walkup(spark, sf_dir):
    return _calls(spark, sf_dir, 0.8).select("read_index", "call")


@query(f"{calls_sql(0.1, 4)} select read_index, n, call from calls")
def min_hit_groups(spark, sf_dir):
    return resolve.resolve(reads_t(spark, sf_dir), hits_t(spark, sf_dir), tree_t(spark, sf_dir), ["read_index"], 0.1, 4).select("read_index", "n", "call")


@query(f"{calls_sql()} select read_index, call from calls where read_index in (select read_index from hits)")
def resolve_hit_reads(spark, sf_dir):
    """Only reads with a hit, as the staged form prints them."""
    return resolve.resolve(reads_t(spark, sf_dir), hits_t(spark, sf_dir), tree_t(spark, sf_dir), ["read_index"], CONFIDENCE, only_hit_reads=True).select("read_index", "call")


HIT_STRING_SQL = f"""{HITS_SQL},
g as (select read_index, pos, taxid, pos - row_number() over (partition by read_index, taxid order by pos) as island from positions),
r as (select read_index, taxid, min(pos) as first, count(*) as n from g group by read_index, taxid, island),
s as (select read_index, string_agg(taxid || ':' || n, ' ' order by first) as hit_string from r group by 1)"""


def _hit_strings(spark, sf_dir):
    return resolve.hit_strings(reads_t(spark, sf_dir).select("read_index", F.col("n").alias("n1"), F.lit(None).cast("long").alias("n2")), hits_t(spark, sf_dir), ["read_index"])


@query(f"{HIT_STRING_SQL} select read_index, coalesce(hit_string, '') as hit_string from reads left join s using (read_index)")
def hit_string(spark, sf_dir):
    return _hit_strings(spark, sf_dir)


PAIR_SQL = f"""{HITS_SQL},
p as (select read_index, pos, taxid, case when pos > n // 2 then 2 else 1 end as mate from positions join reads using (read_index)),
g as (select *, pos - row_number() over (partition by read_index, mate, taxid order by pos) as island from p),
r as (select read_index, mate, taxid, min(pos) as first, count(*) as n from g group by read_index, mate, taxid, island),
s as (select read_index, mate, string_agg(taxid || ':' || n, ' ' order by first) as text from r group by 1, 2)"""


@query(f"{PAIR_SQL} select r.read_index, coalesce(a.text, '') || ' |:| ' || coalesce(b.text, '') as hit_string from reads r left join s a on a.read_index = r.read_index and a.mate = 1 left join s b on b.read_index = r.read_index and b.mate = 2")
def hit_string_pairs(spark, sf_dir):
    """Orders as pairs: the first half of the positions is mate 1."""
    reads = reads_t(spark, sf_dir).select("read_index", F.floor(F.col("n") / 2).alias("n1"), (F.col("n") - F.floor(F.col("n") / 2)).alias("n2"))
    return resolve.hit_strings(reads, hits_t(spark, sf_dir), ["read_index"])


@query("select conv_id, turn, cast(length(text) as bigint) as n, cast(coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as offset from conversations")
def mate_offsets(spark, sf_dir):
    mates = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return resolve.mate_offsets(mates, ["conv_id"], "turn")


@query("select o_custkey % 4 as file_index, o_orderkey, row_number() over (partition by o_custkey % 4 order by o_orderdate, o_orderkey) as read_index from orders")
def read_numbers(spark, sf_dir):
    reads = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).alias("file_index"), "o_orderkey", "o_orderdate")
    return resolve.number_reads(reads, ["file_index"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(f"{HITS_SQL} select h.read_index, file_index, pos, taxid, n from hits h join reads using (read_index)")
def hits_to_reads(spark, sf_dir):
    return hits_t(spark, sf_dir).join(reads_t(spark, sf_dir), "read_index").select("read_index", "file_index", "pos", "taxid", "n")


@query(f"{HITS_SQL} select read_index, file_index from reads where read_index not in (select read_index from hits)")
def unhit_reads_anti(spark, sf_dir):
    return reads_t(spark, sf_dir).join(hits_t(spark, sf_dir), "read_index", "left_anti").select("read_index", "file_index")


LINES_SQL = f"{calls_sql()}{HIT_STRING_SQL.removeprefix(HITS_SQL)}, lines_out as (select file_index, case when call > 0 then 'C' else 'U' end as status, read_id, call as taxid, cast(calls.n as varchar) as seq_len, coalesce(hit_string, '') as hit_string from calls left join s using (read_index))"


@query(f"{LINES_SQL} select * from lines_out")
def classify_output(spark, sf_dir):
    calls = _calls(spark, sf_dir).withColumn("seq_len", F.col("n").cast("string"))
    return resolve.classification_lines(calls, _hit_strings(spark, sf_dir), ["read_index"], ["file_index"]).drop("read_index")


@query(f"{calls_sql()}, names as (select taxid, name from tree where taxid in (select anc from closure join calls on taxid = call) union all select 0, 'unclassified') select read_index, call as taxid, coalesce(name, 'NA') as name from calls left join names on taxid = call")
def append_names(spark, sf_dir):
    calls, tree = _calls(spark, sf_dir), tree_t(spark, sf_dir)
    rows = report.kreport(tree, report.clade_counts(calls, tree), report.totals(calls))
    return resolve.append_names(calls.select("read_index", F.col("call").alias("taxid")), rows).select("read_index", "taxid", "name")


# --- reports ----------------------------------------------------------------------------------------------------------

COUNTS_SQL = f"""{calls_sql()},
direct as (select call as taxid, count(*) as reads from calls where call > 0 group by 1),
clades as (select anc as taxid, cast(sum(reads) as bigint) as clade_reads, cast(sum(case when anc = taxid then reads else 0 end) as bigint) as taxon_reads from direct join closure using (taxid) group by 1)"""


@query(f"{COUNTS_SQL}, k as (select taxid, count(*) as kmers, count(distinct hash) as uniq from hits group by 1) select coalesce(d.taxid, k.taxid) as taxid, coalesce(reads, 0) as reads, coalesce(kmers, 0) as kmers, coalesce(uniq, 0) as \"distinct\" from direct d full join k on d.taxid = k.taxid")
def taxon_counters(spark, sf_dir):
    return report.taxon_counters(_calls(spark, sf_dir), hits_t(spark, sf_dir))


@query(f"{COUNTS_SQL} select taxid, clade_reads, taxon_reads from clades")
def clade_counts(spark, sf_dir):
    return report.clade_counts(_calls(spark, sf_dir), tree_t(spark, sf_dir))


@query(f"{HITS_SQL} select anc as taxid, cast(sum(hits) as bigint) as hits from up group by 1")
def clade_rollup(spark, sf_dir):
    """All hits added to every ancestor."""
    count = hits_t(spark, sf_dir).groupBy("taxid").agg(F.count("*").alias("hits")).join(tree_t(spark, sf_dir).select("taxid", "path"), "taxid")
    return count.select(F.explode("path").alias("taxid"), "hits").groupBy("taxid").agg(F.sum("hits").alias("hits"))


CLADE_KMERS_SQL = f"{COUNTS_SQL}, ck as (select anc as taxid, count(*) as kmers, count(distinct hash) as uniq from hits join closure using (taxid) group by 1), cc as (select coalesce(c.taxid, k.taxid) as taxid, coalesce(clade_reads, 0) as clade_reads, coalesce(taxon_reads, 0) as taxon_reads, coalesce(kmers, 0) as kmers, coalesce(uniq, 0) as uniq from clades c full join ck k on c.taxid = k.taxid)"


@query(f'{CLADE_KMERS_SQL} select taxid, clade_reads, taxon_reads, kmers, uniq as "distinct" from cc')
def clade_counters(spark, sf_dir):
    return report.clade_counters(_calls(spark, sf_dir), hits_t(spark, sf_dir), tree_t(spark, sf_dir))


@query(f"{calls_sql()} select file_index, call as taxid, count(*) as reads from calls where call > 0 group by 1, 2 union all select null, call, count(*) from calls where call > 0 group by 2")
def sample_rollup(spark, sf_dir):
    return report.sample_rollup(_calls(spark, sf_dir), "file_index")


@query(f"{calls_sql()} select file_index, count(*) as total, count(*) filter (call > 0) as classified, count(*) filter (call = 0) as unclassified from calls group by 1")
def classify_totals(spark, sf_dir):
    return report.totals(_calls(spark, sf_dir), ["file_index"])


def _walk_sql(counts: str, tie: str, zero: bool = False, more: str = "") -> str:
    """Nodes in depth-first order, siblings by clade reads: level by level, each node's key is its ancestors' zero-padded numbers."""
    rows = f"select t.taxid, t.depth, t.path, t.rank, t.name, t.rank_path, t.name_path, coalesce(c.clade_reads, 0) as clade_reads, coalesce(c.taxon_reads, 0) as taxon_reads{more} from tree t {'left join' if zero else 'join'} {counts} c on c.taxid = t.taxid {'' if zero else 'where c.clade_reads > 0'}"
    pad = f"lpad(cast(1000000000 - n.clade_reads as varchar), 10, '0') || lpad(cast({tie} as varchar), 10, '0')"
    return f", shown as ({rows}), steps as (select s.taxid, string_agg({pad}, '/' order by n.depth) as key from shown s join closure c on c.taxid = s.taxid join shown n on n.taxid = c.anc group by 1), walked as (select shown.*, key from shown join steps using (taxid))"


def _kreport_sql(zero: bool = False) -> str:
    return f"""{COUNTS_SQL}{_walk_sql("clades", "1000000000 - n.taxid", zero)},
tot as (select count(*) as total, count(*) filter (call = 0) as un from calls),
lines_ as (select key, clade_reads, taxon_reads, case depth when 0 then 'R' when 1 then 'D' when 2 then 'F' else 'S' end as rank_code, taxid, name, depth from walked
  union all select '', un, un, 'U', 0, 'unclassified', 0 from tot {"" if zero else "where un > 0"})
select cast(row_number() over (order by key) - 1 as int) as ord, 100.0 * clade_reads / total as pct, clade_reads, taxon_reads, rank_code, taxid, name, depth from lines_, tot"""


def _kreport(spark, sf_dir, **kw):
    tree = cut(tree_t(spark, sf_dir))
    counts = cut(report.call_counts(_calls(spark, sf_dir, tree=tree)))
    clades = report.clade_counters(counts, hits_t(spark, sf_dir), tree) if kw.get("kmer_data") else report.clade_counts(counts, tree)
    return report.kreport(tree, cut(clades), report.totals(counts), **kw)


@query(_kreport_sql())
def kreport(spark, sf_dir):
    return _kreport(spark, sf_dir)


@query(_kreport_sql(True))
def kreport_zero_counts(spark, sf_dir):
    return _kreport(spark, sf_dir, zero_counts=True)


@query(f"""{CLADE_KMERS_SQL}{_walk_sql("cc", "1000000000 - n.taxid", more=", c.kmers, c.uniq")},
tot as (select count(*) as total, count(*) filter (call = 0) as un from calls),
lines_ as (select key, clade_reads, taxon_reads, kmers, uniq, taxid from walked union all select '', un, un, 0, 0, 0 from tot where un > 0)
select cast(row_number() over (order by key) - 1 as int) as ord, clade_reads, taxon_reads, kmers, uniq as "distinct", taxid from lines_""")
def kreport_kmer_data(spark, sf_dir):
    return _kreport(spark, sf_dir, kmer_data=True).select("ord", "clade_reads", "taxon_reads", "kmers", "distinct", "taxid")


@query(f"""{calls_sql()},
direct as (select file_index, call as taxid, count(*) as reads from calls where call > 0 group by 1, 2)
select file_index, anc as taxid, cast(sum(reads) as bigint) as clade_reads, 100.0 * sum(reads) / any_value(total) as pct
from direct join closure using (taxid) join (select file_index, count(*) as total from calls group by 1) using (file_index) group by file_index, anc""")
def kreport_by_sample(spark, sf_dir):
    """Reports of all samples in one pass."""
    tree = cut(tree_t(spark, sf_dir))
    counts = cut(report.call_counts(_calls(spark, sf_dir, tree=tree), ["file_index"]))
    rows = report.kreport(tree, cut(report.clade_counts(counts, tree, ["file_index"])), report.totals(counts, ["file_index"]), ["file_index"])
    return rows.filter("taxid > 0").select("file_index", "taxid", "clade_reads", "pct")


@query(f"""{COUNTS_SQL}{_walk_sql("clades", "n.taxid")},
m as (select key, clade_reads as clade_count, array_to_string(list_transform(list_filter(list_zip(rank_path, name_path), lambda x: x[1] <> 'no rank'), lambda x: case x[1] when 'superkingdom' then 'd' when 'family' then 'f' else 's' end || '__' || x[2]), '|') as lineage from walked where depth > 0)
select cast(row_number() over (order by key) - 1 as int) as ord, lineage, clade_count from m""")
def mpa_report(spark, sf_dir):
    tree = cut(tree_t(spark, sf_dir))
    return report.mpa_report(tree, cut(report.clade_counts(_calls(spark, sf_dir, tree=tree), tree)))


@query()
def taxon_counters_hll(spark, sf_dir):
    """Counters with mergeable sketches for the distinct minimizers."""
    return report.taxon_counters(_calls(spark, sf_dir), hits_t(spark, sf_dir), approximate=True).drop("sketch")


@query(f"{COUNTS_SQL}, k as (select taxid, count(distinct hash) as uniq from hits group by 1) select taxid, uniq as \"exact\", true as within from k")
def taxon_counters_hll_error(spark, sf_dir):
    """Exact distinct minimizers of each taxon that was hit, and whether its sketch's estimate is within 2 % (and one)."""
    hits = hits_t(spark, sf_dir)
    both = hits.groupBy("taxid").agg(F.count_distinct("hash").alias("exact"), F.hll_sketch_estimate(F.hll_sketch_agg("hash", F.lit(16))).alias("estimate"))
    return both.select("taxid", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.02 * F.col("exact") + 1).alias("within"))


# --- library ----------------------------------------------------------------------------------------------------------


@query("select seq_id, arg_max(taxid, at_) as taxid from (select 'part_' || l_partkey as seq_id, 1000 + l_suppkey as taxid, l_orderkey * 100000000 + l_suppkey * 100 + l_linenumber as at_ from lineitem) group by 1")
def seqid_map_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("seq_id"), (1000 + F.col("l_suppkey")).alias("taxid"), (F.col("l_orderkey") * 100000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("at"))
    return library.last_wins(rows, "seq_id", "taxid", "at")


@query("select '>taxid|' || (1000 + c_nationkey) || '|' || c_name || ' seg ' || c_custkey as header from customer")
def header_rewrite(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    header = F.concat(F.lit(">"), F.col("c_name"), F.lit(" seg "), F.col("c_custkey").cast("string"))
    return rows.select(library.rewrite_header(header, 1000 + F.col("c_nationkey")).alias("header"))


@query("""with h as (select c_custkey, case c_custkey % 4 when 0 then '>kraken:taxid|' || c_nationkey || '|' || c_custkey || ' x' when 1 then '>taxid|' || c_nationkey || '|y' when 2 then '>taxid|n' || c_nationkey || '|taxid|' || c_custkey else '>plain' || c_custkey end as header from customer)
select c_custkey, string_split(substr(header, 2), ' ')[1] as seq_id, cast(case c_custkey % 4 when 0 then string_split(header, '|')[2] when 1 then string_split(header, '|')[2] when 2 then string_split(header, '|')[4] end as bigint) as taxid from h""")
def header_taxid_parse(spark, sf_dir):
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    forms = [F.concat(F.lit(">kraken:taxid|"), nation, F.lit("|"), key, F.lit(" x")), F.concat(F.lit(">taxid|"), nation, F.lit("|y")), F.concat(F.lit(">taxid|n"), nation, F.lit("|taxid|"), key), F.concat(F.lit(">plain"), key)]
    header = F.element_at(F.array(*forms), (F.col("c_custkey") % 4).cast("int") + 1)
    return table(spark, sf_dir, "customer").select("c_custkey", library.header_id(header).alias("seq_id"), library.header_taxid(header).alias("taxid"))


@query("select min(doc_id) as doc_id, md5(text) as md5 from documents where source <> 'src0' and md5(text) not in (select md5(text) from documents where source = 'src0') group by md5(text)")
def content_dedup(spark, sf_dir):
    """New content: documents of other sources that src0 does not have, the first of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("md5"))
    return library.new_content(docs.filter("source <> 'src0'"), docs.filter("source = 'src0'"), "doc_id").select("doc_id", "md5")


MAPS_SQL = "with old as (select distinct 'part_' || p_partkey as seq_id, p_size % 7 as taxid from part where p_partkey % 3 <> 0), new as (select distinct 'part_' || p_partkey as seq_id, (p_size + case when p_partkey % 10 = 0 then 1 else 0 end) % 7 as taxid from part where p_partkey % 2 = 0)"


def _maps(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("seq_id"), "p_partkey", "p_size")
    old = part.filter("p_partkey % 3 <> 0").selectExpr("seq_id", "p_size % 7 AS taxid").distinct()
    new = part.filter("p_partkey % 2 = 0").selectExpr("seq_id", "(p_size + CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END) % 7 AS taxid").distinct()
    return old, new


@query(f"{MAPS_SQL} select new.seq_id, old.taxid as old_taxid, new.taxid as new_taxid from new join old using (seq_id) where old.taxid <> new.taxid")
def seqid_conflicts(spark, sf_dir):
    return library.map_conflicts(*_maps(spark, sf_dir))


@query(f"{MAPS_SQL} select seq_id, taxid from new where seq_id not in (select seq_id from old)")
def seqid_new_entries(spark, sf_dir):
    return library.map_additions(*_maps(spark, sf_dir))


@query(f"{MAPS_SQL} select * from old union all select * from new")
def map_union(spark, sf_dir):
    return library.concatenate(*_maps(spark, sf_dir))


@query("select p_partkey, s.s_suppkey as taxid, p_brand from part join supplier s on s.s_suppkey = p_partkey where s.s_suppkey % 5 > 0")
def genome_taxid_join(spark, sf_dir):
    """Genomes (parts) with a taxid in the map (suppliers of the same number); taxid 0 counts as none."""
    genomes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq_id"), "p_brand")
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq_id"), F.when(F.col("s_suppkey") % 5 == 0, 0).otherwise(F.col("s_suppkey")).alias("taxid"))
    return index.genome_taxids(genomes, known).select(F.col("seq_id").alias("p_partkey"), "taxid", "p_brand")


@query("select doc_id, cast(floor(coalesce(sum(strlen(text)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) / 100000) as int) as suffix from documents")
def sized_output(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size"))
    return library.size_groups(docs, 100000, "doc_id").select("doc_id", "suffix")


# --- scalar functions and cells -----------------------------------------------------------------------------------------

KEYS_SQL = "select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_orderkey * 1000003 + l_partkey * 7919 + l_linenumber as uhugeint) as x from lineitem"


def _keys(spark, sf_dir):
    x = F.col("l_orderkey") * 1000003 + F.col("l_partkey") * 7919 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", x.alias("x"))


@query(f"with keys as ({KEYS_SQL}), {fmix_steps('f', 'keys', 'x')} select l_orderkey, l_partkey, l_linenumber, {signed_sql('x')} as hash from f")
def fmix64(spark, sf_dir):
    return H.with_fmix64(_keys(spark, sf_dir), F.col("x")).select("l_orderkey", "l_partkey", "l_linenumber", "hash")


@query(f"with keys as ({KEYS_SQL}), {murmur_steps('f', 'keys', 'x')} select l_orderkey, l_partkey, l_linenumber, {signed_sql('x')} as hash from f")
def murmur_hash3(spark, sf_dir):
    return H.with_murmur_hash3(_keys(spark, sf_dir), F.col("x")).select("l_orderkey", "l_partkey", "l_linenumber", "hash")


CELLS = f"with keys as ({KEYS_SQL}), {murmur_steps('f', 'keys', 'x')}"
BITS = 7
CAPACITY, PAGE = 31818, 4096


@query(f"""{CELLS}, c as (select l_orderkey, l_linenumber, l_partkey, x, x // cast({1 << 32 + BITS} as uhugeint) as key, l_suppkey % {1 << BITS} as value from f),
d as (select *, cast((key * {1 << BITS}) % 4294967296 as bigint) + value as cell from c)
select l_orderkey, l_linenumber, l_partkey, cast(key as bigint) as key, cell, cell // {1 << BITS} as "left", cell % {1 << BITS} as "right" from d""")
def compact_cells(spark, sf_dir):
    cell = H.cell32(F.col("x"), BITS, F.col("l_suppkey") % (1 << BITS))
    rows = H.with_murmur_hash3(_keys(spark, sf_dir), F.col("x"), "x").withColumn("cell", cell)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", H.compacted(F.col("x"), BITS).alias("key"), "cell", H.left32(F.col("cell"), BITS).alias("left"), H.right32(F.col("cell"), (1 << BITS) - 1).alias("right"))


@query(f"""{CELLS}, i as (select l_orderkey, l_linenumber, l_partkey, cast(x % {CAPACITY} as bigint) as idx from f)
select l_orderkey, l_linenumber, l_partkey, idx, idx // {PAGE} as page, idx % {PAGE} as place from i""")
def hash_slot_index(spark, sf_dir):
    rows = H.with_murmur_hash3(_keys(spark, sf_dir), F.col("x")).withColumn("idx", H.slot_index(F.col("hash"), CAPACITY))
    page, place = H.page_of(F.col("idx"), PAGE)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "idx", page.alias("page"), place.alias("place"))


@query(f"{CELLS} select cast(x % {CAPACITY} as bigint) // {PAGE} as page, count(*) as entries from f group by 1")
def partition_histogram(spark, sf_dir):
    return index.pages(H.with_murmur_hash3(_keys(spark, sf_dir), F.col("x")).select("hash"), CAPACITY, PAGE)


@query(f"{CELLS}, i as (select cast(x % {CAPACITY} as bigint) as idx from f) select idx // {PAGE} as page, least({PAGE}, {CAPACITY} - (idx // {PAGE}) * {PAGE}) as cells, count(distinct idx) as occupied from i group by 1")
def hashshard_layout(spark, sf_dir):
    """Cells of a single-file table by page of the resharded one."""
    idx = H.with_murmur_hash3(_keys(spark, sf_dir), F.col("x")).select(H.slot_index(F.col("hash"), CAPACITY).alias("idx")).distinct()
    page, _ = H.page_of(F.col("idx"), PAGE)
    rows = idx.withColumn("page", page).groupBy("page").agg(F.count("*").alias("occupied"))
    return rows.select("page", F.least(F.lit(PAGE), CAPACITY - F.col("page") * PAGE).cast("long").alias("cells"), "occupied")


@query("select p_partkey, greatest(1, cast(ceil(log2(greatest(p_partkey, 1))) as int)) as bits from part")
def taxid_bits(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", H.bits_for(F.col("p_partkey")).alias("bits"))


@query("select p_partkey, case when p_size % 9 <= 31 // 4 then repeat('1', cast(31 - 2 * (p_size % 9) as int)) || repeat('01', cast(p_size % 9 as int)) end as template from part")
def seed_template(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.seed_template_col(F.lit(31), F.col("p_size") % 9).alias("template"))


@query("select p_partkey, cast(list_reduce(list_transform(range(0, 20), lambda i: case when (p_partkey >> cast(i as int)) & 1 = 1 then cast(3 as bigint) << cast(2 * i as int) else 0 end), lambda a, b: a + b) as bigint) as mask from part")
def expand_mask(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.expand_mask_col(F.col("p_partkey"), 2).alias("mask"))


@query("select p_partkey, p_partkey as value from part")
def parse_binary(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.parse_binary_col(F.bin("p_partkey")).alias("value"))


@query("select p_partkey, cast(floor(p_size * 0.5 * case p_partkey % 5 when 0 then 1024 when 1 then 1048576 when 2 then 1073741824 when 3 then 1073741824 end) as bigint) as bytes from part")
def parse_size(spark, sf_dir):
    unit = F.element_at(F.array(*[F.lit(u) for u in "KmGgB"]), (F.col("p_partkey") % 5).cast("int") + 1)
    text = F.concat((F.col("p_size") * F.lit(0.5).cast("double")).cast("string"), unit)
    return table(spark, sf_dir, "part").select("p_partkey", S.parse_size_col(text).alias("bytes"))


@query("select o_orderkey, case when b < 1024 then printf('%.2fB', b) when b < 1048576 then printf('%.2fKB', b / 1024) when b < 1073741824 then printf('%.2fMB', b / 1048576) else printf('%.2fGB', b / 1073741824) end as text from (select o_orderkey, cast(o_orderkey as double) * o_orderkey * 16 as b from orders)")
def format_bytes(spark, sf_dir):
    size = F.col("o_orderkey").cast("double") * F.col("o_orderkey") * 16
    return table(spark, sf_dir, "orders").select("o_orderkey", S.format_bytes_col(size).alias("text"))


@query("select o_orderkey, nullif(o_orderkey % 3, 0) as value, cast(ceil(cast(0.37 as double) * (o_orderkey % 50)) as bigint) as required from orders")
def option_and_required_score(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.zero_to_null(F.col("o_orderkey") % 3).alias("value"), S.required_score(F.lit(0.37), F.col("o_orderkey") % 50).alias("required"))


@query("select o_orderkey, regexp_replace('r' || o_orderkey || '/' || (o_orderkey % 4), '/[12]$', '') as read_id, case when o_orderkey % 2 = 0 then o_orderkey || '|' || o_custkey else cast(o_orderkey as varchar) end as lengths from orders")
def trim_pair(spark, sf_dir):
    name = F.concat(F.lit("r"), F.col("o_orderkey").cast("string"), F.lit("/"), (F.col("o_orderkey") % 4).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.trim_pair(name).alias("read_id"), S.pair_text(F.col("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey"))).alias("lengths"))


@query("select coalesce(max(o_custkey % 4), 0) as last from orders")
def last_file_index(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.coalesce(F.max(F.col("o_custkey") % 4), F.lit(0)).alias("last"))
