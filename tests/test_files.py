import gzip
import itertools
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.operators import index, library
from cladewise.operators import taxonomy as tax
from cladewise.operators.minimizers import Scheme
from cladewise.plans import api
from cladewise.sources import discovery, fastx, k2d, sinks, taxonomy_files
from cladewise.streaming import classify as stream

#: Nodes of the sample tree: taxid, parent, rank, name. 99 hangs from the root, no genome needs it.
NODES = [(1, 1, "no rank", "root"), (10, 1, "superkingdom", "Viruses"), (20, 10, "clade", "Realm"), (30, 20, "family", "Fam"), (41, 30, "genus", "Gen A"), (42, 30, "genus", "Gen B"), (51, 41, "species", "Sp A"), (52, 41, "species", "Sp B"), (53, 42, "species", "Sp C"), (61, 51, "no rank", "Strain A1"), (99, 1, "superkingdom", "Others")]
LENGTHS = {61: [30_000], 52: [2000, 1800, 1500, 900, 700, 2300, 1000, 1400], 53: [9000]}


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


@pytest.fixture(scope="module")
def sample(tmp_path_factory):
    """A folder with genomes (FASTA by taxid), interleaved FASTQ and taxonomy dumps; and the sequences."""
    rng, folder = random.Random(8), tmp_path_factory.mktemp("sample")
    (folder / "nodes.dmp").write_text("".join(f"{t}\t|\t{p}\t|\t{r}\t|\t\t|\n" for t, p, r, _ in NODES))
    (folder / "names.dmp").write_text("".join(f"{t}\t|\t{n}\t|\t\t|\tscientific name\t|\n{t}\t|\tother {n}\t|\t\t|\tsynonym\t|\n" for t, _, _, n in NODES))
    seqs = {t: [dna(rng, n) for n in sizes] for t, sizes in LENGTHS.items()}
    for t, own in seqs.items():
        (folder / f"{t}.fa").write_text("".join(f">taxid|{t}|s{i} part {i}\n" + "".join(f"{x[j : j + 70]}\n" for j in range(0, len(x), 70)) for i, x in enumerate(own)))
    with open(folder / "pairs.fastq", "w") as f:
        for i in range(3):
            for m in (1, 2):
                at = rng.randrange(20_000)
                f.write(f"@pair_{i}/{m}\n{seqs[61][0][at : at + 50]}\n+\n{'@' if m == 1 else 'I'}{'I' * 49}\n")
    return folder, seqs


@pytest.fixture(scope="module")
def database(spark, sample):
    folder, _ = sample
    nodes = taxonomy_files.read_nodes_with_names(spark, f"{folder}/nodes.dmp", f"{folder}/names.dmp")
    genomes = fastx.library_sequences(fastx.read_fasta(spark, [f"{folder}/{t}.fa" for t in LENGTHS]))
    return api.build(genomes, nodes, Scheme())


def test_taxonomy_files(spark, sample):
    folder, _ = sample
    nodes = taxonomy_files.read_nodes(spark, f"{folder}/nodes.dmp")
    assert nodes.count() == len(NODES) and nodes.filter("taxid = 1").first().parent == 0
    tree = tax.with_paths(taxonomy_files.read_nodes_with_names(spark, f"{folder}/nodes.dmp", f"{folder}/names.dmp"))
    assert {r.taxid: r.name for r in tree.collect()} == {t: n for t, _, _, n in NODES}
    small = tax.trim(tree, spark.createDataFrame([(t,) for t in LENGTHS], "taxid long"))
    ids = {r.internal_id: r.taxid for r in tax.number_nodes(small).collect()}
    assert [ids[i] for i in range(1, 11)] == [1, 10, 20, 30, 41, 42, 51, 52, 53, 61] and len(ids) == 10
    codes = [r.rank_code for r in tax.described(tree).join(tree.filter("taxid = 61").select(F.explode("path").alias("taxid")), "taxid").orderBy("depth").collect()]
    assert codes == ["R", "D", "D1", "F", "G", "S", "S1"]


def test_fasta_scan(spark, sample):
    folder, seqs = sample
    fastx.register(spark)
    for t, own in seqs.items():
        text = fastx.read_fasta(spark, f"{folder}/{t}.fa").collect()
        source = spark.read.format("fastx").load(f"{folder}/{t}.fa").collect()
        assert sorted(r.seq for r in text) == sorted(r.seq for r in source) == sorted(own)
    assert {r.taxid for r in fastx.library_sequences(fastx.read_fasta(spark, f"{folder}/52.fa")).collect()} == {52}


def test_interleaved_pairs(spark, sample):
    folder, seqs = sample
    reads = api.read_samples(spark, [f"{folder}/pairs.fastq", f"{folder}/52.fa"])
    pairs = reads.filter("file_index = 1").orderBy("read_index").collect()
    assert [(p.read_index, p.read_id, p.qual1[0], p.qual2[0]) for p in pairs] == [(i + 1, f"pair_{i}", "@", "I") for i in range(3)]
    assert all(len(p.seq1) == len(p.seq2) == 50 and p.seq1 in seqs[61][0] for p in pairs)
    assert [(r.read_index, r.seq1, r.seq2) for r in reads.filter("file_index = 2").orderBy("read_index").collect()] == [(i + 1, x, None) for i, x in enumerate(seqs[52])]
    assert [(r.record, r.description, len(r.seq), len(r.qual)) for r in fastx.read_fastq(spark, f"{folder}/pairs.fastq").orderBy("record").collect()] == [(i, "", 50, 50) for i in range(6)]


def _reads_by_hand(records):
    """Consecutive records of one name, two and two."""
    base = lambda n: n.split()[0].removesuffix("/1").removesuffix("/2")
    out = []
    for _, run in itertools.groupby(records, key=lambda r: base(r[0])):
        run = list(run)
        for i in range(0, len(run), 2):
            out.append((len(out) + 1, *run[i], *(run[i + 1][1:] if i + 1 < len(run) else (None, None))))
    return out


@pytest.mark.parametrize("longest_run", [3, 40])
def test_splits_do_not_change_the_reads(spark, tmp_path, longest_run):
    """One split and many: the same reads and numbers, whatever stands at a border (qualities that begin with @ or +, too)."""
    rng, records = random.Random(longest_run), []
    while len(records) < 150:
        for m in range(rng.choice([1, 2, 2, longest_run])):
            n = rng.randrange(1, 40)
            records.append((f"r{len(records) - m}/{m % 2 + 1} x", dna(rng, n), "".join(rng.choice("@+!I#5") for _ in range(n))))
    (tmp_path / "a.fastq").write_text("".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in records))
    (tmp_path / "a.fa").write_text("".join(f">{h}\n{s[:9]}\n{s[9:]}\n" for h, s, _ in records))
    settings = {"spark.sql.files.maxPartitionBytes": "128m", "spark.sql.files.openCostInBytes": "4m"}
    try:
        for size in ("128m", "701"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            rows = fastx.scan_reads(spark, str(tmp_path / "a.fastq"), pairs=True)
            assert sorted(tuple(r)[1:] for r in rows.collect()) == _reads_by_hand(records)
            assert sorted(tuple(r)[1:5] for r in fastx.scan_reads(spark, str(tmp_path / "a.fastq")).collect()) == [(i + 1, *r) for i, r in enumerate(records)]
            rows = fastx.scan_reads(spark, str(tmp_path / "a.fa"), pairs=True).select("read_index", "header", "seq1", "seq2").collect()
            assert sorted(map(tuple, rows)) == [(r[0], r[1], r[2], r[4]) for r in _reads_by_hand(records)]
    finally:
        for k, v in settings.items():
            spark.conf.set(k, v)


def test_paired_files(spark, tmp_path):
    for m in (1, 2):
        (tmp_path / f"{m}.fastq").write_text("".join(f"@r{i}/{m}\n{'ACGT'[m] * (i + 1)}\n+\n{'I' * (i + 1)}\n" for i in range(4)))
    rows = api.read_samples(spark, [str(tmp_path / "1.fastq"), str(tmp_path / "2.fastq")], paired=True).orderBy("read_index").collect()
    assert [(r.file_index, r.read_index, r.read_id, r.seq1, r.seq2, r.qual2) for r in rows] == [(1, i + 1, f"r{i}", "C" * (i + 1), "G" * (i + 1), "I" * (i + 1)) for i in range(4)]
    with pytest.raises(ValueError):
        api.read_samples(spark, [str(tmp_path / "1.fastq")], paired=True)


def test_quality_threshold_reaches_the_calls(spark, sample, database, tmp_path):
    folder, seqs = sample
    good, bad = seqs[61][0][:60], seqs[61][0][100:160]
    (tmp_path / "q.fastq").write_text(f"@a\n{good}\n+\n{'I' * 60}\n@b\n{bad}\n+\n{'I' * 30}!{'I' * 29}\n")
    reads = api.read_samples(spark, [str(tmp_path / "q.fastq")])
    calls = {r.read_id: r.call for r in api.classify(database, reads, min_quality=20).calls.collect()}
    assert calls == {"a": 61, "b": 0}
    assert {r.call for r in api.classify(database, reads).calls.collect()} == {61}
    masked = api.prepare_reads(reads, database.scheme, 20).filter("read_id = 'b'").first()
    assert masked.seq1 == bad[:30] + "N" + bad[31:]
    with pytest.raises(ValueError, match="qualit"):
        api.prepare_reads(reads.drop("qual1", "qual2"), database.scheme, 20)
    with pytest.raises(Exception, match="no quality"):
        api.classify(database, api.read_samples(spark, [f"{folder}/53.fa"]), min_quality=20).calls.collect()


def test_whole_genome_report(spark, sample, database):
    folder, seqs = sample
    assert database.stats["value_bits"] == 4
    found = api.classify(database, api.read_samples(spark, [f"{folder}/61.fa"]))
    line = found.lines().first()
    assert (line.status, line.taxid, line.seq_len) == ("C", 61, "30000")
    assert sum(int(t.split(":")[1]) for t in line.hit_string.split()) == 30_000 - 34
    rows = [(r.clade_reads, r.taxon_reads, r.rank_code, r.taxid) for r in found.kreport().orderBy("ord").collect()]
    assert rows == [(1, 0, c, t) for c, t in [("R", 1), ("D", 10), ("D1", 20), ("F", 30), ("G", 41), ("S", 51)]] + [(1, 1, "S1", 61)]


def test_modes_agree_and_results_are_written(spark, sample, database, tmp_path):
    folder, _ = sample
    reads = api.read_samples(spark, [f"{folder}/52.fa", f"{folder}/pairs.fastq"])
    a, b = (sorted(map(tuple, api.classify(database, reads, mode).lines().collect())) for mode in ("shuffle", "broadcast"))
    assert a == b and len(a) == 11
    found = api.classify(database, reads)
    api.write_results(found, str(tmp_path))
    assert spark.read.text(f"{tmp_path}/output").count() == 11
    alone = [r.value for r in sinks.kreport_lines(found.kreport()).orderBy("ord").collect()]
    assert [r.value for r in spark.read.text(f"{tmp_path}/kreport_all").collect()] == alone and len(alone) == 8
    by_file = spark.read.text(f"{tmp_path}/kreport").groupBy("file_index").count().collect()
    assert {r.file_index: r["count"] for r in by_file} == {1: 6, 2: 7}
    sinks.write_hits(found.hits, f"{tmp_path}/hits", 2)
    assert spark.read.parquet(f"{tmp_path}/hits").count() == found.hits.count()
    sinks.write_mpa(found.mpa(), f"{tmp_path}/mpa")
    assert spark.read.text(f"{tmp_path}/mpa").filter("value LIKE '%s__Sp B\t8'").count() == 1
    sinks.write_sample_map(spark.createDataFrame([(1, ["x", "y"]), (2, ["z"])], "file_index int, paths array<string>"), f"{tmp_path}/samples")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/samples").collect()) == ["1\tx,y", "2\tz"]


def test_steps_give_what_classify_gives(spark, sample, database, tmp_path):
    folder, _ = sample
    inputs = [f"{folder}/52.fa", f"{folder}/pairs.fastq"]
    api.splitr(database, inputs, str(tmp_path / "chunks"))
    with pytest.raises(FileExistsError):
        api.splitr(database, inputs, str(tmp_path / "chunks"))
    api.annotate(database, str(tmp_path / "chunks"))
    api.resolve_steps(database, str(tmp_path / "chunks"), str(tmp_path / "out"))
    api.write_results(api.classify(database, api.read_samples(spark, inputs)), str(tmp_path / "whole"))
    for part in ("output", "kreport", "kreport_all"):
        a, b = (sorted(map(tuple, spark.read.text(f"{tmp_path}/{d}/{part}").collect())) for d in ("out", "whole"))
        assert a == b and a
    assert not os.path.exists(tmp_path / "out" / "_stage")


def test_commands(spark, sample, tmp_path, capsys):
    """The commands, one after the other, on the sample folder."""
    from cladewise.__main__ import main

    folder, _ = sample
    db, names = str(tmp_path / "db"), ["--nodes", f"{folder}/nodes.dmp", "--names", f"{folder}/names.dmp"]
    fasta = [f"{folder}/{t}.fa" for t in LENGTHS]
    main(["estimate", "--cache", str(tmp_path / "sketches"), *fasta])
    main(["build-db", "--db", db, *names, "-c", "90000", "--hash-capacity", "32K", *fasta])
    assert k2d.read_config(spark, f"{db}/hash_config.k2d").capacity == 90_000
    assert sorted(f for f in os.listdir(db) if f.startswith("hash_")) == ["hash_1.k2d", "hash_2.k2d", "hash_3.k2d", "hash_config.k2d"]
    main(["size", "--db", db])
    steps = ["--db", db, "--chunk-dir", str(tmp_path / "c")]
    main(["splitr", *steps, "--min-quality", "20", f"{folder}/pairs.fastq"])
    main(["annotate", *steps])
    main(["resolve", *steps, "--out", str(tmp_path / "a"), "--kmer-data"])
    main(["classify", "--db", db, "--out", str(tmp_path / "b"), "--min-quality", "20", "--kmer-data", f"{folder}/pairs.fastq"])
    main(["direct", "--db", db, "--out", str(tmp_path / "d"), f"{folder}/pairs.fastq"])
    a, b, d = (sorted(r.value for r in spark.read.text(f"{tmp_path}/{x}/output").collect()) for x in "abd")
    assert a == b == d and all(line.split("\t")[:3] == ["C", f"pair_{i}", "61"] for i, line in enumerate(a))
    main(["append-names", "--lines", f"{tmp_path}/a/output", "--report", f"{tmp_path}/d/kreport_all", "--out", str(tmp_path / "n")])
    assert all(r.value.endswith("\tStrain A1") for r in spark.read.text(f"{tmp_path}/n").collect())
    assert "estimated distinct minimizers" in capsys.readouterr().out


def test_sketches_are_used_again(spark, tmp_path):
    rng = random.Random(2)
    for name in "ab":
        (tmp_path / f"{name}.fa").write_text(f">taxid|5|{name}\n{dna(rng, 3000)}\n")
    paths, cache = [str(tmp_path / "a.fa"), str(tmp_path / "b.fa")], str(tmp_path / "sketches")
    want = api.estimate(fastx.read_fasta(spark, paths), Scheme(), 1024).first()
    assert api.estimate_files(spark, paths[:1], Scheme(), 1024, cache=cache).first().estimate < want.estimate
    assert api.estimate_files(spark, paths, Scheme(), 1024, cache=cache).first() == want == api.estimate_files(spark, paths, Scheme(), 1024).first()
    rows = spark.read.parquet(cache).collect()
    assert len(rows) == 2
    assert api.estimate_files(spark, paths, Scheme(), 1024, cache=cache).first() == want and spark.read.parquet(cache).count() == 2
    (tmp_path / "b.fa").write_text(f">taxid|5|b\n{dna(rng, 6000)}\n")  # changed: its old sketch does not count
    assert api.estimate_files(spark, paths, Scheme(), 1024, cache=cache).first().estimate > 1.2 * want.estimate
    assert spark.read.parquet(cache).count() == 3


def test_options_are_checked(spark, sample, database, tmp_path):
    with pytest.raises(ValueError, match="zero"):
        api.build_db(spark, [], None, Scheme(), str(tmp_path), 0)
    with pytest.raises(ValueError, match="zero"):
        api.export_k2d(database, str(tmp_path), 0)
    with pytest.raises(ValueError, match="load factor"):
        api.estimate(spark.createDataFrame([("ACGT",)], "seq string"), Scheme(), load_factor=0.0)
    with pytest.raises(ValueError, match="too large"):
        index.annotate(spark.range(1), database.index, "broadcast", entries=10**9)


def test_long_sequences_are_scanned_in_pieces(spark, monkeypatch):
    from cladewise.operators import minimizers

    rng = random.Random(12)
    rows = [(i, "".join(rng.choice("ACGTacgtN\n" if rng.random() < 0.02 else "ACGT") for _ in range(n))) for i, n in enumerate([0, 5, 34, 35, 36, 400, 1500, 90, 35, 3])] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, seq string").coalesce(1)
    want = sorted(map(tuple, minimizers.minimizers_sql(df, Scheme(), ["id"]).collect()))
    for letters in (1 << 20, 100, 36):
        monkeypatch.setattr(minimizers, "SLICE_LETTERS", letters)
        got = [p for ends in ([0, 0, 5, 405, 1905],) for p in minimizers.letter_slices(np.array(ends), 35)]
        assert got[0][0] == 0 and got[-1][1] == 1905 and all(b <= a + letters + 35 or letters > 1905 for a, b in got)
        at, h = [], []
        text = "".join(s or "" for _, s in rows)
        ends = np.cumsum([0, *(len(s or "") for _, s in rows)])
        for a, b in minimizers.letter_slices(ends, 35):
            x, y = minimizers.scan(np.frombuffer(text[a:b].encode(), np.uint8), Scheme())
            at.append(x + a)
            h.append(y)
        at, h = np.concatenate(at), np.concatenate(h)
        assert len(np.unique(at)) == len(at)
        row = np.searchsorted(ends, at, side="right") - 1
        own = at + 35 <= ends[row + 1]
        assert sorted(zip([rows[r][0] for r in row[own]], (at - ends[row] + 1)[own].tolist(), h[own].view(np.int64).tolist(), strict=True)) == want
    assert sorted(map(tuple, minimizers.minimizers(df, Scheme(), ["id"]).collect())) == want


def test_database_round_trips(spark, database, tmp_path):
    database.save(str(tmp_path / "db"), 3)
    again = api.Database.load(spark, str(tmp_path / "db"))
    assert again.scheme == database.scheme and again.index.count() == database.index.count()
    out = f"file://{tmp_path}/k2d"
    os.makedirs(tmp_path / "k2d")
    config = api.export_k2d(again, out, 8192)
    assert k2d.read_config(spark, f"{out}/hash_config.k2d") == config and config.partition == len([f for f in os.listdir(tmp_path / "k2d") if f.startswith("hash_") and f[5].isdigit()])
    cells = k2d.read_pages(spark, f"{out}/hash_[0-9]*.k2d")
    want = index.compact_index(again.index, config.value_bits, config.capacity, tax.number_nodes(again.tree))
    assert sorted(r.cell for r in cells.collect()) == sorted(r.cell for r in want.collect())
    assert k2d.read_options(spark, f"{out}/opts.k2d").seed_mask == 4611686018212639539
    nodes = {(r.taxid, r.parent, r.rank, r.name) for r in k2d.read_taxonomy(spark, f"{out}/taxo.k2d").collect()}
    assert nodes == {(r.taxid, r.parent, r.rank, r.name) for r in again.tree.collect()}
    assert discovery.continuous(discovery.numbered_files(discovery.list_files(spark, out), "hash", ".k2d"))
    assert discovery.total_bytes(spark, out).first().bytes > 4 * config.capacity
    assert k2d.decoded(cells, config.value_bits).filter("internal_id = 0").count() == 0


@pytest.mark.parametrize("range_bytes", [64 << 20, 40])
def test_pages_across_ranges(spark, tmp_path, monkeypatch, range_bytes):
    """Pages written and read in ranges: every entry is where probing from its own place finds it."""
    from cladewise.sources import ranges

    monkeypatch.setattr(ranges, "RANGE", range_bytes)
    rng, capacity, page_cells = random.Random(range_bytes), 130, 50
    homes = [rng.randrange(50) for _ in range(40)] + [49] * 5 + [100 + rng.randrange(30) for _ in range(20)] + [129] * 4  # page 2 is empty
    entries = [(h, i + 1) for i, h in enumerate(homes)]
    k2d.write_pages(spark.createDataFrame(entries, "idx long, cell long"), f"file://{tmp_path}", capacity, page_cells)
    rows = k2d.read_pages(spark, f"file://{tmp_path}/hash_[0-9].k2d").collect()
    table = {(r.page - 1) * page_cells + r.idx: r.cell for r in rows}
    assert sorted(table.values()) == [c for _, c in entries]
    for home, cell in entries:
        page = home // page_cells
        size, at = min(page_cells, capacity - page * page_cells), home
        while table[at] != cell:
            at = page * page_cells + (at + 1 - page * page_cells) % size
            assert at != home
    assert [os.path.getsize(tmp_path / f"hash_{i}.k2d") for i in (1, 2, 3)] == [16 + 200, 16 + 200, 16 + 120]
    with pytest.raises(Exception, match="more entries than cells"):
        k2d.write_pages(spark.createDataFrame([(3, i + 1) for i in range(51)], "idx long, cell long"), f"file://{tmp_path}", 50, 50)


def test_staged_records(spark, tmp_path):
    from cladewise.sources import ranges

    (tmp_path / "sample_file_1_1.bin").write_bytes(struct.pack("<6I", 7, 1, 2, 8, 3, 4))
    (tmp_path / "chunk_1.k2").write_bytes(struct.pack("<2Q", 1, 50) + struct.pack("<QIxxxx", 5, 6))
    (tmp_path / "sample_1.k2").write_bytes(struct.pack("<2Q", 1, 50) + struct.pack("<4Q", 5, 1 << 63, 6, 2))
    assert k2d.sample_chunk_header((tmp_path / "chunk_1.k2").read_bytes()) == (1, 50)
    got = lambda name, *a: [tuple(r)[1:] for r in k2d.read_records(spark, f"file://{tmp_path}/{name}", *a).collect()]
    assert sorted(got("sample_file_*.bin", k2d.ROW_RECORD)) == [(7, 1, 2), (8, 3, 4)]
    assert got("chunk_1.k2", k2d.SLOT_RECORD, 16) == [(5, 6)]
    assert sorted(got("sample_1.k2", k2d.SAMPLE_SLOT_RECORD, 16)) == [(5, -(1 << 63)), (6, 2)]
    with pytest.raises(FileNotFoundError):
        ranges.found(spark, f"file://{tmp_path}/none*")


def test_reshard(spark, tmp_path):
    cells = [0, 5, 0, 7, 9, 0, 0, 11, 2, 0]
    (tmp_path / "hash.k2d").write_bytes(struct.pack("<4Q", 10, 5, 27, 5) + struct.pack("<10I", *cells))
    config = api.hashshard(spark, f"file://{tmp_path}", 4)
    assert (config.version, config.partition, config.capacity, config.size, config.value_bits) == (0, 3, 10, 5, 5)
    rows = k2d.read_pages(spark, f"file://{tmp_path}/hash_[0-9].k2d").collect()
    assert {(r.page - 1) * 4 + r.idx: r.cell for r in rows} == {i: c for i, c in enumerate(cells) if c}
    assert {(r.page, r.idx) for r in k2d.read_first_blocks(spark, f"file://{tmp_path}/hash_[0-9].k2d").collect()} == {(2, 0), (3, 0)}
    with pytest.raises(FileExistsError):
        api.hashshard(spark, f"file://{tmp_path}", 4)


def test_maps_and_logs(spark, tmp_path):
    (tmp_path / "map").write_text("a 5\nb x\na\t7 more\n\nc 9\n")
    assert {tuple(r) for r in taxonomy_files.read_id_map(spark, str(tmp_path / "map")).collect()} == {("a", 7), ("c", 9)}
    (tmp_path / "samples").write_text("1\tr1\t100|90\t66|56\n2\tr2\t100\t66\n")
    assert [tuple(r)[3:] for r in taxonomy_files.read_sample_map(spark, str(tmp_path / "samples")).orderBy("read_index").collect()] == [(66, 56), (66, None)]
    (tmp_path / "files").write_text("1\ta,b\n3\tc\n")
    assert taxonomy_files.last_file_index(spark, str(tmp_path / "files")).first().last == 3
    assert taxonomy_files.read_file_map(spark, str(tmp_path / "files")).orderBy("file_index").first().paths == ["a", "b"]
    (tmp_path / "none").write_text("")
    assert taxonomy_files.last_file_index(spark, str(tmp_path / "none")).first().last == 0
    (tmp_path / "log").write_text("/x\tabc\n/y\tdef\n")
    assert taxonomy_files.read_processed_log(spark, str(tmp_path / "log")).count() == 2


def test_manifest_and_merge(spark, tmp_path):
    row = ["x"] * 20
    row[5], row[19] = "77", "https://h/p/GCF_1"
    other = list(row)
    other[19] = "na"
    lost = list(row)
    lost[19] = "https://h/p/GCF_2"
    (tmp_path / "summary").write_text("#comment\n" + "\n".join("\t".join(r) for r in (row, other, lost)) + "\n")
    os.makedirs(tmp_path / "viral")
    with gzip.open(tmp_path / "viral" / "GCF_1_genomic.fna.gz", "wt") as f:
        f.write(">NC_1 some virus\nACGT\nAC\n>NC_2\nGG\n")
    rows = api.merge_fna(spark, str(tmp_path / "summary"), "viral", str(tmp_path)).orderBy("seq_id").collect()
    assert [(r.header, r.taxid, r.seq_id, r.seq) for r in rows] == [(">taxid|77|NC_1 some virus", 77, "taxid|77|NC_1", "ACGTAC"), (">taxid|77|NC_2", 77, "taxid|77|NC_2", "GG")]


def test_add_library(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">taxid|5|x one\nACGT\n")
    (tmp_path / "b.fna").write_text(">taxid|5|x one\nACGT\n")
    (tmp_path / "c.fa").write_text(">kraken:taxid|6|y\nGG\n")
    lib = f"file://{tmp_path}/lib"
    assert api.add_library(spark, [str(tmp_path / f) for f in ("a.fa", "b.fna")], lib).count() == 1
    assert api.add_library(spark, [str(tmp_path / f) for f in ("a.fa", "c.fa")], lib).count() == 1
    assert {tuple(r) for r in spark.read.parquet(f"{lib}/map").collect()} == {("taxid|5|x", 5), ("kraken:taxid|6|y", 6)}
    old, new = spark.createDataFrame([("a", 1)], "seq_id string, taxid long"), spark.createDataFrame([("a", 2), ("b", 3)], "seq_id string, taxid long")
    with pytest.raises(ValueError):
        library.merge_maps(old, new)
    with pytest.raises(Exception, match="no taxid"):
        library.library_map(spark.createDataFrame([(">plain",)], "header string")).collect()


def test_fastx_records():
    parse = lambda t: list(fastx.records(t.splitlines(True)))
    assert parse(">a b\nAC\nGT\n>c\n\n") == [("a b", "ACGT", None), ("c", "", None)]
    assert parse("@a\nAC\nGT\n+\n@I\nII\n@b\nA\n+b\nI") == [("a", "ACGT", "@III"), ("b", "A", "I")]
    with pytest.raises(ValueError):
        parse("@a\nAC\n+\nI\n")


def test_quality_mask(spark):
    df = spark.createDataFrame([("ACGT", "I!I#"), ("AC", None)], "s string, q string")
    assert [r.s for r in df.select(fastx.mask_quality(F.col("s"), F.col("q"), 10).alias("s")).collect()] == ["ANGN", "AC"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f">taxid|{i}|s", "ACGT" * 10) for i in range(6)], "i int, header string, seq string")
    sinks.write_fasta(df.select("header", "seq"), str(tmp_path / "f"), 2)
    assert fastx.read_fasta(spark, str(tmp_path / "f")).count() == 6
    sinks.write_sized_fasta(df, str(tmp_path / "s"), 110, "i")
    assert len([d for d in os.listdir(tmp_path / "s") if d.startswith("suffix=")]) == 3
    sinks.write_partitions(df.withColumn("p", F.col("i") % 2), str(tmp_path / "p"), "p")
    assert spark.read.parquet(str(tmp_path / "p")).groupBy("p").count().count() == 2
    files = discovery.list_files(spark, str(tmp_path / "f"), "*.txt")
    assert files.count() >= 3 and not discovery.continuous(spark.createDataFrame([(1,), (3,)], "number int"))
    listing = tmp_path / "in.txt"
    listing.write_text(f"{tmp_path}/f\n")
    assert discovery.expand_inputs(spark, [str(listing)]) == [f"{tmp_path}/f"]
    with pytest.raises(FileNotFoundError):
        discovery.expand_inputs(spark, [f"{tmp_path}/none"])
    grouped = spark.createDataFrame([("sample_file_1_2.bin", "b"), ("sample_file_1_1.bin", "a"), ("x", "c")], "name string, path string")
    assert [tuple(r) for r in discovery.grouped_files(grouped, "sample_file", ".bin").collect()] == [(1, ["a", "b"])]


def test_stream_gives_what_a_table_gives(spark, sample, database, tmp_path):
    reads = api.read_samples(spark, [f"{sample[0]}/52.fa"]).select("file_index", "read_index", "read_id", "seq1", "seq2")
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    stream.classify_stream(stream.reads_stream(spark, str(tmp_path / "in"), 1), database, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "calls")).select("read_index", "call").collect()
    assert sorted(map(tuple, got)) == sorted((r.read_index, r.call) for r in api.classify(database, reads).calls.collect())
    assert stream.running_report(spark, str(tmp_path / "out"), database.tree).filter("taxid = 1").first().clade_reads == 8


def test_index_with_shared_and_own_minimizers(spark):
    random.seed(3)
    text = lambda n: "".join(random.choice("ACGT") for _ in range(n))
    shared, a, b = text(80), text(80), text(80)
    tree = tax.with_paths(spark.createDataFrame([(1, 0, "no rank", "r"), (2, 1, "genus", "g"), (3, 2, "species", "a"), (4, 2, "species", "b")], "taxid long, parent long, rank string, name string"))
    db = index.build(spark.createDataFrame([(3, shared + "N" + a), (4, shared + "N" + b), (0, text(90))], "taxid long, seq string"), tree, Scheme())
    hit = index.annotate(api.minimizers.minimizers(spark.createDataFrame([(0, shared), (1, a), (2, b)], "id int, seq string"), Scheme(), ["id"]), db).groupBy("id").agg(F.collect_set("taxid").alias("t")).collect()
    assert {r.id: r.t for r in hit} == {0: [2], 1: [3], 2: [4]}
    sizes = api.estimate(spark.createDataFrame([(shared,)], "seq string"), Scheme(), 1024, exact=True).first()
    assert sizes.capacity == -(-(sizes.estimate + 8192) * 10 // 7)


def test_bucketed_index_is_not_shuffled(spark, database):
    index.write_index(database.index, "bucketed_index", 4)
    kmers = spark.createDataFrame([(1, 5, 7)], "read_index int, pos int, hash long")
    plan = index.annotate(kmers, spark.table("bucketed_index"), "shuffle")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    spark.sql("DROP TABLE bucketed_index")
