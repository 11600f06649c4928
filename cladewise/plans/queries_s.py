"""Queries over domain S: from texts as pseudo-DNA to minimizers, an index, hits, calls and reports; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parallel import staged
from ..operators import index, minimizers, report, resolve
from ..sources import fastx
from .domains import FULL, PLAIN, SHORT, dna_sql, genomes_s, kmers_sql, murmur_steps, number_sql, pseudo_dna, reads_s, signed_sql, table, tree_s

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LIBRARY_SQL = f"library as (select item_id as id, {dna_sql('text')} as seq from benchmark)"
READS_SQL = f"reads as (select doc_id as id, {dna_sql('text')} as seq from documents)"
FULL_MASK = FULL.mask


def _numbers_sql(scheme) -> str:
    """From CTE library: CTE hashed (id, pos, x): the hash as uhugeint, by the scheme with its masks."""
    k, l = scheme.k, scheme.l  # noqa: E741
    u = lambda v: f"cast({v} as uhugeint)"
    return f"""n_w as (select id, len(seq) as n, i as pos, substr(seq, i, {l}) as w from (select id, seq, unnest(range(1, len(seq) - {l} + 2)) as i from library where len(seq) >= {k})),
n_v as (select id, n, pos, case when not contains(w, '_') then least(w, reverse(translate(w, 'ACGT', 'TGCA'))) end as c from n_w),
n_x as (select id, n, pos, case when c is not null then xor({number_sql('c')} & {u(scheme.mask)}, {u(scheme.flip)}) end as c from n_v),
n_m as (select id, n, pos, min(c) over win as m, count(c) over win as full_ from n_x window win as (partition by id order by pos rows between current row and {k - l} following)),
n_k as (select id, pos, xor(m, {u(scheme.flip)}) as x from n_m where full_ = {k - l + 1} and pos <= n - {k} + 1),
{murmur_steps('hashed', 'n_k', 'x')}"""


def _library_kmers(spark: SparkSession, sf_dir: str, scheme=FULL) -> DataFrame:
    return minimizers.minimizers(genomes_s(spark, sf_dir), scheme, ["taxid"])


@query(f"with {READS_SQL} select id as read_index, len(seq) as length, greatest(0, len(seq) - 34) as n from reads")
def reads_scan(spark, sf_dir):
    return reads_s(spark, sf_dir).select("read_index", F.length("seq").cast("long").alias("length"), F.col("n").cast("long").alias("n"))


@query(f"""with s as (select c_custkey, {dna_sql('c_name')} as seq from customer)
select c_custkey, array_to_string(list_transform(range(1, len(seq) + 1), lambda i: case when (c_custkey * 7 + i * 13) % 41 < 20 then 'N' else seq[i] end), '') as seq from s""")
def quality_mask(spark, sf_dir):
    """Customers' names as reads, with qualities of 0 to 40 by place: letters below 20 become N."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", pseudo_dna(F.col("c_name")).alias("seq"))
    letter = lambda i: F.char(33 + (F.col("c_custkey") * 7 + i * 13) % 41)
    qual = F.array_join(F.transform(F.sequence(F.lit(1), F.length("seq")), letter), "")
    return rows.select("c_custkey", fastx.mask_quality(F.col("seq"), qual, 20).alias("seq"))


@query(f"with {LIBRARY_SQL}, {_numbers_sql(FULL)} select 100 + id as taxid, cast(pos as int) as pos, {signed_sql('x')} as hash from hashed")
def minimizers_kernel(spark, sf_dir):
    return _library_kmers(spark, sf_dir)


@query(SQL["minimizers_kernel"])
def minimizers_in_sql(spark, sf_dir):
    return minimizers.minimizers_sql(genomes_s(spark, sf_dir), FULL, ["taxid"]).select("taxid", F.col("pos").cast("int").alias("pos"), "hash")


@query(f"with {LIBRARY_SQL}, {_numbers_sql(FULL)}, h as (select *, case when lag(x) over w = x and lag(pos) over w = pos - 1 then 0 else 1 end as new from hashed window w as (partition by id order by pos)), r as (select *, sum(new) over (partition by id order by pos) as run from h) select 100 + id as taxid, cast(min(pos) as int) as pos, count(*) as length from r group by id, run")
def minimizer_runs(spark, sf_dir):
    return minimizers.runs(_library_kmers(spark, sf_dir), ["taxid"]).select("taxid", "pos", "length")


@query(f"with {LIBRARY_SQL}, {_numbers_sql(FULL)} select 100 + id as taxid, cast(pos as int) as pos, {signed_sql('x')} as hash from hashed where x >= cast(9223372036854775808 as uhugeint)")
def minimizers_clear_hash(spark, sf_dir):
    """Subsampled: only hashes from 2^63 on."""
    from dataclasses import replace

    return _library_kmers(spark, sf_dir, replace(FULL, clear_from=1 << 63))


@query(f"with {LIBRARY_SQL}, {_numbers_sql(FULL)} select 100 + id as taxid, cast(pos as int) as pos, {signed_sql('x')} as hash from hashed where x % 1024 < 64")
def minhash_sample(spark, sf_dir):
    return index.minhash_sample(_library_kmers(spark, sf_dir), 64)


@query(f"with {LIBRARY_SQL}, {_numbers_sql(FULL)}, e as (select cast(round(count(distinct x) * 1024.0 / 64) as bigint) as estimate from hashed where x % 1024 < 64) select estimate, cast(ceil((estimate + 8192) / cast(0.7 as double)) as bigint) as capacity from e")
def estimate_capacity(spark, sf_dir):
    return index.estimate_capacity(_library_kmers(spark, sf_dir), 64)


@query(f"with {READS_SQL}, {kmers_sql('k', 'reads', PLAIN)} select count(*) as kmers, count(distinct m) as \"distinct\" from k")
def distinct_kmers_exact(spark, sf_dir):
    return minimizers.distinct(reads_s(spark, sf_dir), PLAIN)


@query()
def distinct_kmers_hll(spark, sf_dir):
    """Sketches by read bucket, merged: an estimate."""
    found = minimizers.minimizers(reads_s(spark, sf_dir), PLAIN, ["read_index"], once=True)
    parts = found.groupBy(F.pmod("read_index", F.lit(16)).alias("part")).agg(F.hll_sketch_agg("hash", F.lit(16)).alias("sketch"))
    return parts.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


@query(f"with {READS_SQL}, {kmers_sql('k', 'reads', PLAIN)} select cast(count(distinct m) as bigint) as \"exact\", true as within from k")
def distinct_kmers_hll_error(spark, sf_dir):
    """The exact count, and whether the merged sketches' estimate is within 2 %."""
    exact, found = distinct_kmers_exact(spark, sf_dir).select(F.col("distinct").alias("exact")), distinct_kmers_hll(spark, sf_dir)
    return exact.crossJoin(found).select("exact", (F.abs(F.col("distinct") - F.col("exact")) <= 0.02 * F.col("exact")).alias("within"))  # a row each


INDEX_SQL = f"""{LIBRARY_SQL}, {_numbers_sql(SHORT)}, pairs as (select distinct x, id from hashed),
idx as (select x, case when count(*) = 1 then 100 + any_value(id) when count(distinct id % 4) = 1 then 10 + any_value(id % 4) else 1 end as taxid from pairs group by x)"""


@query(f"with {INDEX_SQL} select {signed_sql('x')} as hash, taxid from idx")
def lca_index_build(spark, sf_dir):
    return index.build(genomes_s(spark, sf_dir), tree_s(spark, sf_dir), SHORT)


@query(f"with {INDEX_SQL}, c as (select cast(x % 31818 as bigint) as idx, cast(x // cast({1 << 39} as uhugeint) as bigint) as key, taxid from idx), g as (select idx, key, list(distinct taxid) as t from c group by 1, 2) select idx, key, case when len(t) = 1 then t[1] else 1 end as taxid from g")
def index_compact_keys(spark, sf_dir):
    """Entries that a table of compact cells cannot tell apart, by their common ancestor (of this tree's taxa: themselves or the root)."""
    found = index.compat_index(index.build(genomes_s(spark, sf_dir), tree_s(spark, sf_dir), SHORT), tree_s(spark, sf_dir), 7, 31818)
    return found.select("idx", "key", "taxid")


@query(f"with {INDEX_SQL} select count(*) as size from idx where taxid > 0")
def index_size(spark, sf_dir):
    return index.occupied(index.build(genomes_s(spark, sf_dir), tree_s(spark, sf_dir), SHORT))


HITS_SQL = f"""{LIBRARY_SQL}, {READS_SQL}, {kmers_sql('lib', 'library', PLAIN)}, {kmers_sql('k', 'reads', PLAIN)},
entries as (select m, case when count(distinct id) = 1 then 100 + any_value(id) when count(distinct id % 4) = 1 then 10 + any_value(id % 4) else 1 end as taxid from lib group by m),
hits as (select k.id as read_index, pos, taxid, m from k join entries using (m))"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build(genomes_s(spark, sf_dir), tree_s(spark, sf_dir), PLAIN)


def _hits(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """Hits of documents: k-mers without a bit in the index's sieve do not leave the kernel, the others meet the index."""
    entries = staged(_index(spark, sf_dir))
    n = entries.count()
    found = minimizers.minimizers(reads_s(spark, sf_dir), PLAIN, ["read_index"], sieve=index.sieve(entries, n))
    return index.annotate(found, entries, mode, n)


@query(f"with {HITS_SQL} select read_index, cast(pos as int) as pos, taxid from hits")
def kmer_index_join(spark, sf_dir):
    return _hits(spark, sf_dir, "shuffle").select("read_index", "pos", "taxid")


@query(SQL["kmer_index_join"])
def kmer_index_join_broadcast(spark, sf_dir):
    return _hits(spark, sf_dir, "broadcast").select("read_index", "pos", "taxid")


TREE_SQL = """tree_ids as (select 1 as taxid, [1] as path, 'root' as name, 0 as depth union all select distinct 10 + item_id % 4, [1, 10 + item_id % 4], 'bucket_' || item_id % 4, 1 from benchmark
  union all select distinct 100 + item_id, [1, 10 + item_id % 4, 100 + item_id], 'item_' || item_id, 2 from benchmark),
closure as (select taxid, unnest(path) as anc, unnest(range(0, len(path))) as anc_depth from tree_ids)"""
CALLS_SQL = f"""{HITS_SQL}, {TREE_SQL},
cnt as (select read_index, taxid, count(*) as hits from hits group by all),
up as (select c.read_index, c.taxid, anc, anc_depth, hits from cnt c join closure using (taxid)),
score as (select u.read_index, u.taxid, sum(c.hits) as score from up u join cnt c on c.read_index = u.read_index and c.taxid = u.anc group by all),
top as (select s.* from score s join (select read_index, max(score) as m from score group by 1) using (read_index) where score = m),
best as (select read_index, arg_max(anc, anc_depth) as best from (select read_index, anc, anc_depth, count(*) as n from top join closure using (taxid) group by all) a
  join (select read_index, count(*) as k from top group by 1) b using (read_index) where n = k group by 1),
size as (select id as read_index, len(seq) as length, greatest(0, len(seq) - 34) as n from reads),
clade as (select read_index, anc, sum(hits) as hits from up group by all),
called as (select b.read_index, arg_max(c.anc, c.anc_depth) as call from best b join closure c on c.taxid = b.best join clade x on x.read_index = b.read_index and x.anc = c.anc join size s on s.read_index = b.read_index
  where x.hits >= ceil(cast(0.02 as double) * s.n) group by 1),
calls as (select s.*, case when n < 2 then 0 else coalesce(call, 0) end as call from size s left join called using (read_index))"""
POSITIONS_SQL = """every as (select read_index, unnest(range(1, n + 1)) as pos from size),
filled as (select e.read_index, e.pos, coalesce(taxid, 0) as taxid from every e left join hits h on h.read_index = e.read_index and h.pos = e.pos),
isl as (select *, pos - row_number() over (partition by read_index, taxid order by pos) as island from filled),
tok as (select read_index, taxid, min(pos) as first, count(*) as n from isl group by read_index, taxid, island),
strings as (select read_index, string_agg(taxid || ':' || n, ' ' order by first) as hit_string from tok group by 1)"""


def classified(spark: SparkSession, sf_dir: str, mode: str = "auto", confidence: float = 0.02) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Reads (without letters) and hits, both staged, tree and calls of documents against the benchmark library."""
    reads, hits, tree = staged(reads_s(spark, sf_dir).drop("seq")), staged(_hits(spark, sf_dir, mode)), tree_s(spark, sf_dir)
    return reads, hits, tree, resolve.resolve(reads, hits, tree, ["read_index"], confidence)


@query(f"with {CALLS_SQL}, {POSITIONS_SQL} select 0 as file_index, case when call > 0 then 'C' else 'U' end as status, 'doc_' || c.read_index as read_id, cast(call as bigint) as taxid, cast(length as varchar) as seq_len, coalesce(hit_string, '') as hit_string from calls c left join strings using (read_index)")
def classify_documents(spark, sf_dir):
    """The whole classification of documents: minimizers, index, look-up, calls, hit strings."""
    reads, hits, _, calls = classified(spark, sf_dir)
    strings = resolve.hit_strings(reads.select("read_index", "n1", "n2"), hits, ["read_index"])
    return resolve.classification_lines(calls, strings, ["read_index"], ["file_index"]).drop("read_index")


@query(f"""with {CALLS_SQL}, direct as (select call as taxid, count(*) as reads from calls where call > 0 group by 1),
clades as (select anc as taxid, sum(reads) as clade_reads, sum(case when anc = d.taxid then reads else 0 end) as taxon_reads from direct d join closure c on c.taxid = d.taxid group by 1),
shown as (select t.*, clade_reads, taxon_reads from tree_ids t join clades using (taxid)),
steps as (select s.taxid, string_agg(lpad(cast(1000000000 - n.clade_reads as varchar), 10, '0') || lpad(cast(1000000000 - n.taxid as varchar), 10, '0'), '/' order by n.depth) as key from shown s join closure c on c.taxid = s.taxid join shown n on n.taxid = c.anc group by 1),
tot as (select count(*) as total, count(*) filter (call = 0) as un from calls),
rows_ as (select key, clade_reads, taxon_reads, case depth when 0 then 'R' when 1 then 'G' else 'S' end as rank_code, taxid, name, depth from shown join steps using (taxid) union all select '', un, un, 'U', 0, 'unclassified', 0 from tot where un > 0)
select cast(row_number() over (order by key) - 1 as int) as ord, 100.0 * clade_reads / total as pct, cast(clade_reads as bigint) as clade_reads, cast(taxon_reads as bigint) as taxon_reads, rank_code, cast(taxid as bigint) as taxid, name, depth from rows_, tot""")
def report_documents(spark, sf_dir):
    """The report of that classification."""
    _, _, tree, calls = classified(spark, sf_dir)
    counts = staged(report.call_counts(calls))
    return report.kreport(tree, report.clade_counts(counts, tree), report.totals(counts))


QUERIES["minimizers"], SQL["minimizers"] = QUERIES.pop("minimizers_kernel"), SQL.pop("minimizers_kernel")
