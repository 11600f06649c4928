"""FASTA and FASTQ scans.

Files that can be split are read by records (``lineSep``); gzip files are one split each, as their format demands. Reads carry their
file and their place in it, so order never depends on partition numbers.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FASTA_GLOB = "*.{fa,fna,fasta,fsa,fa.gz,fna.gz,fasta.gz,fsa.gz}"
FASTX_SCHEMA = "file string, record long, read_id string, description string, seq string, qual string"


def read_fasta(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """file, seq_id, description, seq of every record; lines are joined."""
    reader = spark.read.option("lineSep", "\n>")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", FASTA_GLOB)
    text = F.regexp_replace("value", "^>", "")
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("file"), text.alias("t")).filter(F.length(F.trim("t")) > 0)
    header = F.rtrim(F.substring_index("t", "\n", 1))
    body = F.when(F.instr("t", "\n") > 0, F.substr("t", F.instr("t", "\n") + 1)).otherwise("")
    return rows.select("file", F.regexp_extract(header, r"^(\S*)", 1).alias("seq_id"), F.regexp_replace(header, r"^\S*\s*", "").alias("description"), F.regexp_replace(body, r"\s", "").alias("seq"))


def library_sequences(records: DataFrame) -> DataFrame:
    """Adds taxid, parsed from the identifier."""
    from ..operators.library import header_taxid

    return records.withColumn("taxid", header_taxid(F.col("seq_id")))


class _Whole(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FastxReader(DataSourceReader):
    """One partition a file; each file is streamed record by record."""

    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", options.get("paths", "")).split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [_Whole(p) for p in self.paths]

    def read(self, partition: _Whole) -> Iterator[tuple]:
        import gzip

        path = partition.path.removeprefix("file://")
        with open(path, "rb") as probe:
            zipped = probe.read(2) == b"\x1f\x8b"
        with gzip.open(path, "rt") if zipped else open(path) as lines:
            for n, (header, seq, qual) in enumerate(records(lines)):
                name, _, rest = header.partition(" ")
                yield partition.path, n, name, rest, seq, qual


def records(lines) -> Iterator[tuple[str, str, str | None]]:
    """(header, sequence, quality or null) of FASTA or FASTQ lines; quality may span lines, as long as the sequence is."""
    header, seq, fastq = None, [], False
    it = iter(lines)
    for line in it:
        line = line.rstrip("\r\n")
        if header is None:
            if line[:1] in (">", "@"):
                header, fastq, seq = line[1:], line[0] == "@", []
            continue
        if fastq and line[:1] == "+":
            whole, qual = "".join(seq), ""
            while len(qual) < len(whole):
                more = next(it, None)
                if more is None:
                    raise ValueError(f"record {header!r}: quality ends early")
                qual += more.rstrip("\r\n")
            yield header, whole, qual
            header = None
        elif not fastq and line[:1] == ">":
            yield header, "".join(seq), None
            header, seq = line[1:], []
        else:
            seq.append(line.strip())
    if header is not None:
        if fastq:
            raise ValueError(f"record {header!r} has no quality")
        yield header, "".join(seq), None


class Fastx(DataSource):
    """``spark.read.format("fastx").load(path)``: for records longer than a text split and FASTQ with wrapped lines."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return FASTX_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastxReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Fastx)


READS = "file string, read_index long, header string, seq1 string, qual1 string, seq2 string, qual2 string"
_OUTLINE = "file string, block long, n int, lead int, trail int, heads long, lead_name string, trail_name string, orphan string, first string, before string, last string"
_START = "block long, run int, reads long"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _name(text: str) -> str:
    """A record's identifier without the mark of its mate."""
    found = text.split("\n", 1)[0].split(None, 1)
    name = found[0] if found else ""
    return name[:-2] if name[-2:] in ("/1", "/2") else name


def _whole(text: str) -> bool:
    """Whether a FASTQ record has its quality; a piece ends where a line begins with @, so in a quality that begins so."""
    lines = text.rstrip("\r\n").split("\n")
    return len(lines) > 3


def _fields(text: str, fastq: bool) -> tuple[str, str, str | None]:
    """Header, sequence and quality (null for FASTA) of a record's text."""
    lines = [x.rstrip("\r") for x in text.rstrip("\r\n").split("\n")]
    if not fastq:
        return lines[0], "".join("".join(x.split()) for x in lines[1:]), None
    if len(lines) != 4 or lines[2][:1] != "+" or len(lines[1]) != len(lines[3]):
        raise ValueError(f"record {lines[0]!r} is not of four lines with as many qualities as letters (wrapped lines: format fastx)")
    return lines[0], lines[1], lines[3]


def _assembled(pieces: Iterator[tuple[int, str]], fastq: bool) -> Iterator[tuple[bool, str]]:
    """(orphan, text) of a split's records in order; an orphan is the quality of a record that began in an earlier split.

    pieces: (block, text). The last record may lack its quality.
    """
    mark, own = "@" if fastq else ">", None
    for at, (block, piece) in enumerate(pieces):
        if not block and not at and piece[:1] == mark:
            piece = piece[1:]
        if fastq and own is not None and not _whole(own):  # the quality may be this one letter
            own += "\n@" + piece
        elif fastq and own is None and block and piece.rstrip("\r\n").count("\n") < 2:
            yield True, piece
        elif piece.strip():
            if own is not None:
                yield False, own
            own = piece
    if own is not None:
        yield False, own


def _by_split(batches: Iterator[pa.RecordBatch], more: tuple[str, ...] = ()) -> Iterator[tuple[tuple, Iterator[tuple[int, str]]]]:
    """The pieces of each split in turn, with its key: file, block and the columns ``more``."""

    def rows():
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("file", "block", *more)), strict=True)
            yield from zip(keys, batch.column("value").to_pylist(), strict=True)

    for key, group in itertools.groupby(rows(), key=lambda r: r[0]):
        yield key, ((key[1], text) for _, text in group)


def _outline(fastq: bool, pairs: bool):
    """One row for each split: how many records begin there, its first and last runs of equal names, and the texts at its borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), pieces in _by_split(batches):
            n = lead = trail = heads = 0
            orphan = first = before = last = lead_name = name = None
            for is_orphan, text in _assembled(pieces, fastq):
                if is_orphan:
                    orphan = text
                    continue
                own = _name(text)
                if n and pairs and own == name:
                    trail += 1
                else:
                    if n and lead != n:
                        heads += -(-trail // 2)
                    trail, name = 1, own
                n += 1
                if trail == n:
                    lead, lead_name = n, own
                first, before, last = first or text, last, text
            if n and lead != n:
                heads += -(-trail // 2)
            schema, row = _arrow(_OUTLINE), (file, block, n, lead, trail, heads, lead_name, name, orphan, first, before, last)
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

    return run


def _linked(fastq: bool, pairs: bool, border: bool):
    """Over the outlines of a file: where the runs and the numbers of each split start; or, ``border``, the last read of each split."""
    schema = _arrow(READS if border else f"file string, {_START}")

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        starts, reads, run_, total, name, pending, open_ = [], [], 0, 0, None, None, None

        def flush() -> None:
            if pending:
                number, one, two = pending
                (h, s1, q1), (_, s2, q2) = _fields(one, fastq), _fields(two, fastq) if two is not None else (None, None, None)
                reads.append(dict(file=rows[0]["file"], read_index=number, header=h, seq1=s1, qual1=q1, seq2=s2, qual2=q2))

        for i, r in enumerate(rows):
            if open_ is not None:  # a record that lacks its quality
                if r["orphan"] is None:
                    raise ValueError(f"record {open_!r} has no quality")
                open_ = None
            if not r["n"]:
                continue
            after = next((x for x in rows[i + 1 :] if x["n"] or x["orphan"] is not None), None)
            if fastq and not _whole(r["last"]):
                open_ = r["last"]
                if after is None:
                    raise ValueError(f"record {open_!r} has no quality")
                r["last"] += "\n@" + after["orphan"]
                r["first"] = r["last"] if r["n"] == 1 else r["first"]
            run_ = run_ if pairs and r["lead_name"] == name else 0
            starts.append(dict(file=r["file"], block=r["block"], run=run_, reads=total))
            if run_ % 2:
                pending = (*pending[:2], r["first"])
            whole = r["lead"] == r["n"]
            total += -(-(run_ + r["lead"]) // 2) - -(-run_ // 2) + r["heads"]
            length = r["trail"] + (run_ if whole else 0)
            if not (r["n"] == 1 and run_ % 2):
                flush()
                pending = (total, r["before"], r["last"]) if pairs and length % 2 == 0 else (total, r["last"], None)
            run_, name = length, r["trail_name"]
        flush()
        return pa.Table.from_pylist(reads if border else starts, schema=schema)

    return run


def _emitted(fastq: bool, pairs: bool):
    """The reads of each split but its last one."""
    schema = _arrow(READS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (file, _, run_, reads), pieces in _by_split(batches, ("run", "reads")):
            name, held = None, None
            for is_orphan, text in _assembled(pieces, fastq):
                if is_orphan:
                    continue
                own = _name(text)
                run_ = run_ if name is None or pairs and own == name else 0
                name = own
                if run_ % 2:
                    held = held and (*held[:2], text)
                else:
                    if held:
                        out.append((file, *_read(held, fastq)))
                    reads += 1
                    held = (reads, text, None)
                run_ += 1
                if len(out) >= 5000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out = []
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _read(held: tuple[int, str, str | None], fastq: bool) -> tuple:
    number, one, two = held
    return (number, *_fields(one, fastq), *(_fields(two, fastq)[1:] if two is not None else (None, None)))


def _scan(spark: SparkSession, paths: list[str], fastq: bool, pairs: bool) -> DataFrame:
    lines = spark.read.option("lineSep", "\n@" if fastq else "\n>").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    outline = lines.mapInArrow(_outline(fastq, pairs), _OUTLINE).groupBy("file")
    starts = outline.applyInArrow(_linked(fastq, pairs, False), f"file string, {_START}")
    border = outline.applyInArrow(_linked(fastq, pairs, True), READS)
    placed = lines.join(F.broadcast(starts), ["file", "block"], "left")
    # splits without a start begin no record; scans of one file that are split in two ways would have others
    own = placed.filter(F.col("run").isNotNull()).mapInArrow(_emitted(fastq, pairs), READS)
    return own.unionByName(border)


def is_fastq(spark: SparkSession, path: str) -> bool:
    """By the file's name, else by its first letter."""
    if found := re.search(r"\.(fastq|fq|fasta|fna|fsa|fa)(\.\w+)?$", path.lower()):
        return found[1] in ("fastq", "fq")
    first = spark.read.text(path).limit(1).first()
    return first is not None and first.value.startswith("@")


def scan_reads(spark: SparkSession, paths: str | list[str], pairs: bool = False) -> DataFrame:
    """file, read_index, header, seq1, qual1, seq2, qual2 of FASTA and four-line FASTQ, in as many tasks as Spark splits the files into.

    Two scans and no shuffle of reads: the first one outlines each split (records that begin there, texts at its borders, one row a split), which
    gives every split its number of reads before it, and the last read of each, which may go on in the next split; the second one
    emits all others. ``pairs``: consecutive records with one name (after /1, /2 are cut) are one read, two and two. Numbers
    start from 1 in each file. gzip files are one split each, as their format demands.
    """
    out, kinds = None, {}
    for p in [paths] if isinstance(paths, str) else paths:
        kinds.setdefault(is_fastq(spark, p), []).append(p)
    for fastq, own in kinds.items():
        rows = _scan(spark, own, fastq, pairs)
        out = rows if out is None else out.unionByName(rows)
    return out


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, record (from 0), read_id, description, seq, qual of four-line records."""
    header = F.col("header")
    rows = _scan(spark, [path] if isinstance(path, str) else path, True, False)
    return rows.select("file", (F.col("read_index") - 1).alias("record"), F.regexp_extract(header, r"^(\S*)", 1).alias("read_id"), F.regexp_replace(header, r"^\S*\s*", "").alias("description"), F.col("seq1").alias("seq"), F.col("qual1").alias("qual"))


def mask_quality(seq: Column, qual: Column, least: int) -> Column:
    """Letters whose quality (phred + 33) is below ``least`` become N."""
    if least <= 0:
        return seq
    # low qualities are marked first, so reads without any are left as they are
    low = "".join(f"\\x{33 + i:02x}" for i in range(min(least, 94)))
    letters = F.zip_with(F.split(seq, ""), F.split(F.regexp_replace(qual, f"[{low}]", " "), ""), lambda s, q: F.when(q == " ", F.lit("N")).otherwise(s))
    return F.when(qual.isNull() | ~qual.rlike(f"[{low}]"), seq).otherwise(F.array_join(letters, ""))


def sample_reads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_index (from 1, in the order of paths), read_index, read_id, seq1, qual1, seq2, qual2; consecutive mates are one read."""
    number = spark.createDataFrame([(qualified(spark, p), i + 1) for i, p in enumerate(paths)], "own string, file_index int")
    read_id = F.regexp_replace(F.regexp_extract("header", r"^(\S*)", 1), "/[12]$", "")
    rows = scan_reads(spark, list(dict.fromkeys(paths)), pairs=True)
    # a row a file of the command
    return rows.join(F.broadcast(number), F.regexp_replace("file", "^file:/+", "/") == F.col("own")).select("file_index", "read_index", read_id.alias("read_id"), "seq1", "qual1", "seq2", "qual2")


def paired_reads(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Two files' records, matched by their place: read_index, read_id, seq1, qual1, seq2, qual2."""
    a, b = scan_reads(spark, first), scan_reads(spark, second)
    read_id = F.regexp_replace(F.regexp_extract("header", r"^(\S*)", 1), "/[12]$", "")
    left = a.select("read_index", read_id.alias("read_id"), "seq1", "qual1")
    return left.join(b.select("read_index", F.col("seq1").alias("seq2"), F.col("qual1").alias("qual2")), "read_index", "left").select("read_index", "read_id", "seq1", "qual1", "seq2", "qual2")


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's file metadata has it, without the scheme of local files."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()
    return re.sub("^file:/+", "/", whole)
