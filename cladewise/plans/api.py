"""The commands: gather a library, add to it, estimate, build, classify, report, convert."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import taxid_bits
from ..functions.parallel import cut
from ..operators import index as ix
from ..operators import library, minimizers, report, resolve
from ..operators import taxonomy as tax
from ..operators.minimizers import Scheme
from ..sources import discovery, fastx, k2d, sinks, taxonomy_files


#: What identifies a read, and the tables of a classification in steps.
KEYS = ["file_index", "read_index"]
STEPS = ["reads", "kmers", "hits"]


@dataclass
class Database:
    """An index with the tree and the scheme that belong to it."""

    index: DataFrame
    tree: DataFrame
    scheme: Scheme
    stats: dict = field(default_factory=dict)

    def save(self, path: str, buckets: int = 0) -> None:
        """Parquet tables and a sidecar; with ``buckets`` the index is also dealt and sorted by hash into so many files."""
        spark = self.index.sparkSession
        placed = self.index.repartition(buckets, "hash").sortWithinPartitions("hash") if buckets else self.index
        placed.write.mode("overwrite").parquet(f"{path}/index")
        self.tree.write.mode("overwrite").parquet(f"{path}/tree")
        self.stats["entries"] = spark.read.parquet(f"{path}/index").count()  # from the files' footers
        k2d.write_bytes(spark, f"{path}/scheme.json", json.dumps(asdict(self.scheme) | {"stats": self.stats}).encode())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Database:
        side = json.loads(k2d.read_head(spark, f"{path}/scheme.json", 1 << 20))
        stats = side.pop("stats", {})
        return cls(spark.read.parquet(f"{path}/index"), spark.read.parquet(f"{path}/tree"), Scheme(**side), stats)


def merge_fna(spark: SparkSession, manifests: str | list[str], site: str, directory: str) -> DataFrame:
    """Records of the genomes that the manifests name and that exist: header rewritten, taxid, seq_id, seq."""
    wanted = taxonomy_files.read_manifest(spark, manifests, site, directory)
    there = discovery.list_files(spark, f"{directory}/{site}", "*_genomic.fna.gz").select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    wanted = wanted.withColumn("path", F.regexp_replace("path", "^file:/*", "/")).join(there, "path", "left_semi")
    paths = [r.path for r in wanted.select("path").distinct().collect()]  # a manifest's files
    if not paths:
        return spark.createDataFrame([], "header string, taxid long, seq_id string, seq string")
    records = fastx.read_fasta(spark, paths).withColumn("path", F.regexp_replace("file", "^file:/*", "/")).join(wanted, "path")
    header = library.rewrite_header(F.concat_ws(" ", "seq_id", F.nullif("description", F.lit(""))), F.col("taxid"))
    return records.select(header.alias("header"), "taxid", library.header_id(header).alias("seq_id"), "seq")


def add_library(spark: SparkSession, paths: list[str], directory: str) -> DataFrame:
    """Adds FASTA files to a library folder (records, map, log of md5); content seen before is left out. Returns what was added.

    Everything is checked, conflicts of the map included, before anything is written.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", fastx.FASTA_GLOB).load(paths).select("path", F.md5("content").alias("md5"))
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{directory}/{name}") if k2d.exists(spark, f"{directory}/{name}") else spark.createDataFrame([], schema)
    log, known = read("log", "path string, md5 string"), read("map", "seq_id string, taxid long")
    fresh = library.new_content(files, log)
    new = [r.path for r in fresh.select("path").collect()]  # the files of one call
    if not new:
        return fresh.select("path", "md5")
    records = fastx.library_sequences(fastx.read_fasta(spark, new))
    found = library.library_map(records.select(F.col("seq_id").alias("header")))
    clash = library.map_conflicts(known, found).limit(5).collect()
    if clash:
        raise ValueError(f"identifiers with another taxid: {[(r.seq_id, r.old_taxid, r.new_taxid) for r in clash]}")
    library.map_additions(known, found).write.mode("append").parquet(f"{directory}/map")
    records.select("seq_id", "description", "taxid", "seq").write.mode("append").parquet(f"{directory}/records")
    added = fresh.select("path", "md5")
    added.write.mode("append").parquet(f"{directory}/log")
    return spark.createDataFrame(added.collect(), "path string, md5 string")


def estimate(genomes: DataFrame, scheme: Scheme, max_n: int = 4, load_factor: float = 0.7, exact: bool = False) -> DataFrame:
    """estimate, capacity and index_bytes of genomes (seq)."""
    found = minimizers.minimizers(genomes.select(F.lit(0).alias("g"), "seq"), scheme, ["g"])
    return ix.estimate_capacity(found, max_n, load_factor, exact).withColumn("index_bytes", ix.index_bytes(F.col("capacity")))


SKETCHES = "file string, modified timestamp, length long, key string, sketch binary"


def estimate_files(spark: SparkSession, paths: list[str], scheme: Scheme, max_n: int = 4, load_factor: float = 0.7, cache: str | None = None) -> DataFrame:
    """``estimate`` of FASTA files by a sketch of each file.

    With ``cache`` (a folder) sketches are kept there, and those of files that have not changed, under the same scheme and sample, are used again.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", fastx.FASTA_GLOB).load(paths)
    files = files.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "length", F.lit(f"{max_n} {json.dumps(asdict(scheme))}").alias("key"))
    by = ["file", "modified", "length", "key"]
    stored = bool(cache) and k2d.exists(spark, cache)
    known = (spark.read.schema(SKETCHES).parquet(cache) if stored else spark.createDataFrame([], SKETCHES)).join(files, by, "left_semi").dropDuplicates(by)
    new = [r.file for r in files.join(known, by, "left_anti").collect()]  # the files of one call
    if new:
        plain = F.regexp_replace("file", "^file:/+", "/")
        records = fastx.read_fasta(spark, new).select(plain.alias("file"), "seq")
        sketches = ix.file_sketches(minimizers.minimizers(records, scheme, ["file"]), max_n)
        fresh = files.withColumn("own", plain).join(sketches.withColumnRenamed("file", "own"), "own").select(*by, "sketch")
        if cache:
            fresh.write.mode("append").parquet(cache)
            known = spark.read.schema(SKETCHES).parquet(cache).join(files, by, "left_semi").dropDuplicates(by)
        else:
            known = known.unionByName(fresh)
    return ix.capacity_of_sketches(known, max_n, load_factor).withColumn("index_bytes", ix.index_bytes(F.col("capacity")))


def build(genomes: DataFrame, nodes: DataFrame, scheme: Scheme, seqid_map: DataFrame | None = None) -> Database:
    """A database of genomes (seq_id, seq, taxid unless a map is given) under the nodes (taxid, parent, rank, name) they need."""
    labelled = ix.genome_taxids(genomes.drop("taxid"), seqid_map) if seqid_map is not None else genomes
    tree = tax.trim(tax.with_paths(nodes), labelled.select("taxid").filter("taxid > 0")).transform(cut)
    nameless = tree.filter("name is null").limit(3).collect()
    if nameless:
        raise ValueError(f"nodes without a scientific name: {[r.taxid for r in nameless]}")
    count = tree.count()
    stats = {"nodes": count, "value_bits": taxid_bits(count + 1)}
    return Database(ix.build(labelled.select("taxid", "seq"), tree, scheme), tree, scheme, stats)


def build_db(spark: SparkSession, library: list[str], nodes: DataFrame, scheme: Scheme, directory: str, capacity: int | None = None, page_cells: int = 1 << 30, load_factor: float = 0.7, seqid_map: DataFrame | None = None) -> k2d.HashConfig:
    """A database from a library that is there already, saved as tables and as binary pages; capacity as given, else estimated."""
    if capacity is not None and capacity <= 0:
        raise ValueError("the capacity can't be zero")
    capacity = capacity or estimate_files(spark, library, scheme, load_factor=load_factor).first().capacity
    genomes = fastx.library_sequences(fastx.read_fasta(spark, library, recursive=True))
    db = build(genomes, nodes, scheme, seqid_map)
    db.save(directory)
    return export_k2d(Database.load(spark, directory), directory, page_cells, capacity)


@dataclass
class Classification:
    reads: DataFrame
    hits: DataFrame
    calls: DataFrame
    tree: DataFrame
    keys: list[str]
    #: Calls from hits, as they were asked for; lets staged hits take the place of the plan that finds them.
    call: Callable[[DataFrame], DataFrame]

    def lines(self) -> DataFrame:
        strings = resolve.hit_strings(self.reads.select(*self.keys, "n1", "n2"), self.hits, self.keys)
        return resolve.classification_lines(self.calls, strings, self.keys)

    def kreport(self, by: list[str] = (), kmer_data: bool = False, zero_counts: bool = False) -> DataFrame:
        clades = report.clade_counters(self.calls, self.hits, self.tree, by) if kmer_data else report.clade_counts(self.calls, self.tree, by)
        return report.kreport(self.tree, clades, report.totals(self.calls, by), by, zero_counts, kmer_data)

    def mpa(self, zero_counts: bool = False) -> DataFrame:
        return report.mpa_report(self.tree, report.clade_counts(self.calls, self.tree), zero_counts=zero_counts)


def prepare_reads(reads: DataFrame, scheme: Scheme, min_quality: int = 0) -> DataFrame:
    """Reads (file_index, read_index, read_id, seq1, seq2 or null, qual1, qual2 if filtered) with position counts and length text.

    A quality threshold needs the columns of qualities; a read whose quality is null (FASTA) is an error.
    """
    if min_quality > 0 and "qual1" not in reads.columns:
        raise ValueError("a quality threshold needs reads with qualities")
    for m in (1, 2):
        if f"seq{m}" not in reads.columns:
            reads = reads.withColumn(f"seq{m}", F.lit(None).cast("string"))
        if min_quality > 0 and f"qual{m}" in reads.columns:
            lacks = F.col(f"seq{m}").isNotNull() & F.col(f"qual{m}").isNull()
            checked = F.when(lacks, F.raise_error(F.concat(F.lit("no quality of read "), "read_id"))).otherwise(F.col(f"qual{m}"))
            reads = reads.withColumn(f"seq{m}", fastx.mask_quality(F.col(f"seq{m}"), checked, min_quality))
    length = lambda c: F.length(F.col(c))
    n = {m: F.when(F.col(f"seq{m}").isNotNull(), minimizers.kmer_count(length(f"seq{m}"), scheme.k)) for m in (1, 2)}
    size = F.concat_ws("|", length("seq1").cast("string"), length("seq2").cast("string"))
    return reads.withColumns({"n1": F.coalesce(n[1], F.lit(0)), "n2": n[2], "n": F.coalesce(n[1], F.lit(0)) + F.coalesce(n[2], F.lit(0)), "seq_len": size})


def _mates(reads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, offset of each mate."""
    each = F.array(F.struct(F.col("seq1").alias("seq"), F.lit(0).alias("offset")), F.struct(F.col("seq2").alias("seq"), F.col("n1").alias("offset")))
    return reads.select(*keys, F.explode(each).alias("m")).select(*keys, "m.seq", "m.offset").filter("seq is not null")


def classify(db: Database, reads: DataFrame, mode: str = "auto", confidence: float = 0.0, min_groups: int = 2, min_quality: int = 0, only_hit_reads: bool = False) -> Classification:
    """Calls of reads. mode: shuffle (both sides dealt by hash), broadcast (the index everywhere) or auto (by its size)."""
    keys = KEYS
    reads = prepare_reads(reads, db.scheme, min_quality)
    found = minimizers.minimizers(_mates(reads, keys), db.scheme, keys, offset="offset")
    hits = ix.annotate(found, db.index, mode, db.stats.get("entries"))
    call = lambda found: resolve.resolve(reads.drop("seq1", "seq2", "qual1", "qual2"), found, db.tree, keys, confidence, min_groups, only_hit_reads)
    return Classification(reads, hits, call(hits), db.tree, keys, call)


def _staged(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_results(result: Classification, path: str, kmer_data: bool = False, zero_counts: bool = False) -> None:
    """Lines by file, a report per file and one of all files.

    Reads meet the index once: hits and calls are staged beside the output, all else follows from them, and the stage is deleted.
    """
    stage, key = f"{path}/_stage", ["file_index"]
    hits = _staged(result.hits, f"{stage}/hits")
    calls = _staged(result.call(hits), f"{stage}/calls")
    found = replace(result, hits=hits, calls=calls, tree=cut(result.tree))
    sinks.write_calls(found.lines(), f"{path}/output")
    counts = cut(report.call_counts(calls, key))

    def rows(by: list[str]) -> DataFrame:
        clades = report.clade_counters(counts, hits, found.tree, by) if kmer_data else report.clade_counts(counts, found.tree, by)
        return report.kreport(found.tree, cut(clades), report.totals(counts, by), by, zero_counts, kmer_data)

    lines = report.kreport_lines(rows(key), key, kmer_data)
    lines.repartition("file_index").sortWithinPartitions("file_index", "ord").select("file_index", "value").write.mode("overwrite").partitionBy("file_index").text(f"{path}/kreport")
    sinks.write_kreport(rows([]), f"{path}/kreport_all", kmer_data)
    k2d.delete(hits.sparkSession, stage)


def read_samples(spark: SparkSession, paths: list[str], paired: bool = False) -> DataFrame:
    """Reads of FASTA or FASTQ files (one sample each, or pairs of files) with qualities, interleaved pairs recognised by their names."""
    paths = discovery.expand_inputs(spark, paths)
    if not paired:
        return fastx.sample_reads(spark, paths)
    if len(paths) % 2:
        raise ValueError("paired input needs an even number of files")
    out = None
    for i, group in enumerate(zip(paths[::2], paths[1::2], strict=True)):
        rows = fastx.paired_reads(spark, *group).withColumn("file_index", F.lit(i + 1))
        out = rows if out is None else out.unionByName(rows)
    return out


def splitr(db: Database, inputs: list[str], chunks: str, paired: bool = False, min_quality: int = 0) -> None:
    """The first step of a classification in steps: reads and their minimizers as tables in a folder that has none yet."""
    spark = db.index.sparkSession
    if any(k2d.exists(spark, f"{chunks}/{t}") for t in STEPS):
        raise FileExistsError(f"{chunks} holds the tables of an earlier run")
    reads = prepare_reads(read_samples(spark, inputs, paired), db.scheme, min_quality)
    reads.drop("seq1", "seq2", "qual1", "qual2").write.parquet(f"{chunks}/reads")
    minimizers.minimizers(_mates(reads, KEYS), db.scheme, KEYS, offset="offset").write.parquet(f"{chunks}/kmers")


def annotate(db: Database, chunks: str, mode: str = "auto") -> None:
    """The second step: the minimizers' taxa."""
    spark = db.index.sparkSession
    ix.annotate(spark.read.parquet(f"{chunks}/kmers"), db.index, mode, db.stats.get("entries")).write.mode("overwrite").parquet(f"{chunks}/hits")


def resolve_steps(db: Database, chunks: str, out: str, confidence: float = 0.0, min_groups: int = 2, only_hit_reads: bool = False, kmer_data: bool = False, zero_counts: bool = False) -> None:
    """The last step: calls, lines and reports from the folder's tables."""
    spark = db.index.sparkSession
    reads, hits = spark.read.parquet(f"{chunks}/reads"), spark.read.parquet(f"{chunks}/hits")
    call = lambda found: resolve.resolve(reads, found, db.tree, KEYS, confidence, min_groups, only_hit_reads)
    write_results(Classification(reads, hits, call(hits), db.tree, KEYS, call), out, kmer_data, zero_counts)


def hashshard(spark: SparkSession, directory: str, page_cells: int) -> k2d.HashConfig:
    return k2d.reshard(spark, f"{directory}/hash.k2d", directory, page_cells)


def export_k2d(db: Database, directory: str, page_cells: int, capacity: int | None = None) -> k2d.HashConfig:
    """Pages, configuration, options and taxonomy of a database as binary files."""
    spark = db.index.sparkSession
    numbered = tax.number_nodes(db.tree)
    bits = taxid_bits(db.tree.count() + 1)
    if page_cells <= 0 or capacity is not None and capacity <= 0:
        raise ValueError("capacity and page size can't be zero")
    capacity = capacity or int(db.index.agg(F.ceil((F.count("*") + ix.RESERVE) / 0.7)).first()[0])
    if bits >= 32:
        raise ValueError(f"{bits} bits of a cell for the taxon leave none for the key")
    cells = ix.compact_index(db.index, bits, capacity, numbered)
    k2d.write_pages(cells, directory, capacity, page_cells)
    config = k2d.HashConfig(1, k2d.pages_needed(capacity, page_cells), page_cells, capacity, cells.count(), bits)
    k2d.write_config(spark, f"{directory}/hash_config.k2d", config)
    k2d.write_options(spark, f"{directory}/opts.k2d", k2d.IndexOptions(db.scheme.k, db.scheme.l, db.scheme.mask, db.scheme.toggle, True, db.scheme.clear_from or 0))
    k2d.write_taxonomy(tax.node_table(db.tree), f"{directory}/taxo.k2d")
    return config
