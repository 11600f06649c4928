"""Command line: python -m cladewise COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.scalars import format_bytes, parse_size
from .operators import resolve
from .operators.minimizers import Scheme
from .plans import api
from .sources import discovery, fastx, taxonomy_files


def _scheme(a) -> Scheme:
    return Scheme(a.k, a.l, a.spaces, a.toggle, a.clear_from)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="cladewise")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options, scheme: bool = False):
        c = sub.add_parser(name)
        for flags, kw in options:
            c.add_argument(*flags.split(), **kw)
        if scheme:
            c.add_argument("-k", type=int, default=35)
            c.add_argument("-l", type=int, default=31)
            c.add_argument("--spaces", type=int, default=7)
            c.add_argument("--toggle", type=int, default=Scheme.toggle)
            c.add_argument("--clear-from", type=int)

    db = ("--db", {"required": True})
    classify = [db, ("--mode", {"default": "auto", "choices": ["auto", "shuffle", "broadcast"]}), ("--out", {"required": True}), ("--paired", {"action": "store_true"}), ("--confidence", {"type": float, "default": 0.0}), ("--min-hit-groups", {"type": int, "default": 2}), ("--min-quality", {"type": int, "default": 0}), ("--kmer-data", {"action": "store_true"}), ("--zero-counts", {"action": "store_true"}), ("inputs", {"nargs": "+"})]
    command("merge-fna", ("--manifest", {"nargs": "+", "required": True}), ("--site", {"required": True}), ("--directory", {"required": True}), ("--out", {"required": True}))
    command("add-library", ("--directory", {"required": True}), ("inputs", {"nargs": "+"}))
    steps = [db, ("--chunk-dir", {"required": True})]
    command("splitr", *steps, ("--paired", {"action": "store_true"}), ("--min-quality", {"type": int, "default": 0}), ("inputs", {"nargs": "+"}))
    command("annotate", *steps, ("--mode", {"default": "auto", "choices": ["auto", "shuffle", "broadcast"]}))
    command("resolve", *steps, ("--out", {"required": True}), ("--confidence", {"type": float, "default": 0.0}), ("--min-hit-groups", {"type": int, "default": 2}), ("--only-hit-reads", {"action": "store_true"}), ("--kmer-data", {"action": "store_true"}), ("--zero-counts", {"action": "store_true"}))
    command("build-db", db, ("--nodes", {"required": True}), ("--names", {"required": True}), ("--map", {}), ("-c --required-capacity", {"type": int}), ("--hash-capacity", {"type": parse_size, "default": parse_size("1G")}), ("--load-factor", {"type": float, "default": 0.7}), ("inputs", {"nargs": "+"}), scheme=True)
    command("estimate", ("--cache", {}), ("--load-factor", {"type": float, "default": 0.7}), ("--max-n", {"type": int, "default": 4}), ("inputs", {"nargs": "+"}), scheme=True)
    command("build", db, ("--nodes", {"required": True}), ("--names", {"required": True}), ("--map", {}), ("--buckets", {"type": int, "default": 0}), ("inputs", {"nargs": "+"}), scheme=True)
    command("classify", *classify)
    command("direct", *classify)
    command("export", db, ("--out", {"required": True}), ("--hash-capacity", {"type": parse_size, "default": parse_size("1G")}))
    command("hashshard", db, ("--hash-capacity", {"type": parse_size, "default": parse_size("1G")}))
    command("append-names", ("--lines", {"required": True}), ("--report", {"required": True}), ("--out", {"required": True}))
    command("size", db)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName(f"cladewise {a.command}").getOrCreate()

    if a.command == "merge-fna":
        rows = api.merge_fna(spark, a.manifest, a.site, a.directory)
        rows.select("seq_id", "taxid", "seq").write.mode("overwrite").parquet(a.out)
    elif a.command == "add-library":
        api.add_library(spark, a.inputs, a.directory).show(truncate=False)
    elif a.command == "estimate":
        row = api.estimate_files(spark, a.inputs, _scheme(a), a.max_n, a.load_factor, a.cache).first()
        print(f"estimated distinct minimizers {row.estimate}, capacity {row.capacity}, index {format_bytes(row.index_bytes)}")
    elif a.command == "build":
        genomes = fastx.library_sequences(fastx.read_fasta(spark, a.inputs, recursive=True))
        known = taxonomy_files.read_id_map(spark, a.map) if a.map else None
        api.build(genomes, taxonomy_files.read_nodes_with_names(spark, a.nodes, a.names), _scheme(a), known).save(a.db, a.buckets)
    elif a.command in ("classify", "direct"):
        mode = "broadcast" if a.command == "direct" else a.mode
        found = api.classify(api.Database.load(spark, a.db), api.read_samples(spark, a.inputs, a.paired), mode, a.confidence, a.min_hit_groups, a.min_quality)
        api.write_results(found, a.out, a.kmer_data, a.zero_counts)
    elif a.command == "build-db":
        known = taxonomy_files.read_id_map(spark, a.map) if a.map else None
        print(api.build_db(spark, a.inputs, taxonomy_files.read_nodes_with_names(spark, a.nodes, a.names), _scheme(a), a.db, a.required_capacity, a.hash_capacity, a.load_factor, known))
    elif a.command == "splitr":
        api.splitr(api.Database.load(spark, a.db), a.inputs, a.chunk_dir, a.paired, a.min_quality)
    elif a.command == "annotate":
        api.annotate(api.Database.load(spark, a.db), a.chunk_dir, a.mode)
    elif a.command == "resolve":
        api.resolve_steps(api.Database.load(spark, a.db), a.chunk_dir, a.out, a.confidence, a.min_hit_groups, a.only_hit_reads, a.kmer_data, a.zero_counts)
    elif a.command == "export":
        print(api.export_k2d(api.Database.load(spark, a.db), a.out, a.hash_capacity))
    elif a.command == "hashshard":
        print(api.hashshard(spark, a.db, a.hash_capacity))
    elif a.command == "append-names":
        f = F.split("value", "\t")
        lines = spark.read.text(a.lines).select("value", F.get(f, F.lit(2)).cast("long").alias("taxid"))
        names = spark.read.text(a.report).select(F.element_at(f, -2).cast("long").alias("taxid"), F.element_at(f, -1).alias("name"))
        resolve.append_names(lines, names).select(F.concat_ws("\t", "value", "name").alias("value")).write.mode("overwrite").text(a.out)
    elif a.command == "size":
        print(format_bytes(discovery.total_bytes(spark, a.db).first().bytes))


if __name__ == "__main__":
    main()
