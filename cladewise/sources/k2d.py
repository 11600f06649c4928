"""Readers and writers of the binary table files (little-endian): pages, configuration, options, taxonomy.

Pages, tables and staged records are read and written by tasks in ranges of bytes and decoded by numpy in Arrow batches, so a page of 4 GB needs no
more memory than a range; headers are a few bytes and are parsed on the driver.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges

# File magic, and the layout of headers, nodes and options.
TAXONOMY_MAGIC = b"K2TAXDAT"
CONFIG_LAYOUT = "<6Q"  # version, partition, page cells, capacity, size, value bits
PAGE_LAYOUT = "<2Q"  # page, cells
TABLE_LAYOUT = "<4Q"  # capacity, size, key bits, value bits
OPTIONS_LAYOUT = "<4Q?7xQ3i4x"  # k, l, seed mask, toggle mask, dna, least hash, complement version, table version, table type
NODE_FIELDS = ["parent_id", "first_child", "child_count", "name_offset", "rank_offset", "external_id", "godparent_id"]
CHUNK_LAYOUT = "<2Q"  # partition index, cells of a chunk
ROW_RECORD = [("value", "<u4"), ("seq_id", "<u4"), ("kmer_id", "<u4")]
SLOT_RECORD = [("idx", "<u8"), ("value", "<u4"), ("", "V4")]
SAMPLE_SLOT_RECORD = [("idx", "<u8"), ("value", "<u8")]
COMPLEMENT_VERSION = 1
#: Cells that are looked at at once for a page's first block.
FIRST_CELLS = 1 << 20


@dataclass(frozen=True)
class HashConfig:
    version: int
    partition: int
    page_cells: int
    capacity: int
    size: int
    value_bits: int

    @property
    def value_mask(self) -> int:
        return (1 << self.value_bits) - 1


@dataclass(frozen=True)
class IndexOptions:
    k: int
    l: int  # noqa: E741
    seed_mask: int
    toggle_mask: int
    dna: bool = True
    least_hash: int = 0
    complement_version: int = COMPLEMENT_VERSION
    table_version: int = 0
    table_type: int = 0


def _stream(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file in any store that Spark reads; nothing else of it is fetched."""
    fs, p = _stream(spark, path)
    size = min(size, fs.getFileStatus(p).getLen())
    source = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.readFully(source, size))
    finally:
        source.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _stream(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _stream(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _stream(spark, path)
    return fs.exists(p)


def read_config(spark: SparkSession, path: str) -> HashConfig:
    return HashConfig(*struct.unpack(CONFIG_LAYOUT, read_head(spark, path, struct.calcsize(CONFIG_LAYOUT))))


def write_config(spark: SparkSession, path: str, c: HashConfig) -> None:
    write_bytes(spark, path, struct.pack(CONFIG_LAYOUT, c.version, c.partition, c.page_cells, c.capacity, c.size, c.value_bits))


def read_table_header(spark: SparkSession, path: str) -> HashConfig:
    """Configuration from the header of a single-file table (version 0, one page)."""
    capacity, size, _, value_bits = struct.unpack(TABLE_LAYOUT, read_head(spark, path, struct.calcsize(TABLE_LAYOUT)))
    return HashConfig(0, 1, capacity, capacity, size, value_bits)


def read_options(spark: SparkSession, path: str) -> IndexOptions:
    found = IndexOptions(*struct.unpack(OPTIONS_LAYOUT, read_head(spark, path, struct.calcsize(OPTIONS_LAYOUT))))
    if found.complement_version != COMPLEMENT_VERSION:
        raise ValueError(f"unsupported complement version {found.complement_version}")
    return found


def write_options(spark: SparkSession, path: str, o: IndexOptions) -> None:
    write_bytes(spark, path, struct.pack(OPTIONS_LAYOUT, o.k, o.l, o.seed_mask, o.toggle_mask, o.dna, o.least_hash, o.complement_version, o.table_version, o.table_type))


def _cell_ranges(spark: SparkSession, path: str, head: int, size: int) -> DataFrame:
    """place, first, n: ranges of whole records behind the head of each file."""
    step = max(1, ranges.RANGE // size)
    rows = [(place, at, min(step, (length - head) // size - at)) for place, length in ranges.found(spark, path) for at in range(0, (length - head) // size, step)]
    return ranges.tasks(spark, rows, "place string, first long, n long") if rows else spark.createDataFrame([], "place string, first long, n long")


def read_pages(spark: SparkSession, path: str, header: str = PAGE_LAYOUT) -> DataFrame:
    """page, idx, cell of the occupied cells of page files. idx counts within the page."""
    head = struct.calcsize(header)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with ranges.opened(r["place"]) as f:
                    first, second, *_ = struct.unpack(header, f.read(head))
                    page, n = (first, second) if header == PAGE_LAYOUT else (1, first)
                    f.seek(head + 4 * r["first"])
                    cells = np.frombuffer(f.read(4 * max(0, min(r["n"], n - r["first"]))), "<u4")
                at = np.flatnonzero(cells)
                yield pa.record_batch([pa.array(np.full(len(at), page, np.int64)), pa.array(at + r["first"]), pa.array(cells[at].astype(np.int64))], names=["page", "idx", "cell"])

    return _cell_ranges(spark, path, head, 4).mapInArrow(run, "page long, idx long, cell long")


def read_records(spark: SparkSession, path: str, record: list[tuple[str, str]], head: int = 0) -> DataFrame:
    """The records of staged files (hits ``ROW_RECORD``, cells ``SLOT_RECORD``, samples ``SAMPLE_SLOT_RECORD``): place, and its fields as BIGINT."""
    kind = np.dtype(record)
    names = [n for n, _ in record if n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with ranges.opened(r["place"]) as f:
                    f.seek(head + kind.itemsize * r["first"])
                    own = np.frombuffer(f.read(kind.itemsize * r["n"]), kind)
                yield pa.record_batch([pa.array([r["place"]] * len(own), pa.string()), *(pa.array(own[n].astype(np.uint64).view(np.int64)) for n in names)], names=["place", *names])

    return _cell_ranges(spark, path, head, kind.itemsize).mapInArrow(run, "place string, " + ", ".join(f"{n} long" for n in names))


def read_first_blocks(spark: SparkSession, path: str) -> DataFrame:
    """page, idx, cell of each page's cells before its first empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with ranges.opened(r["place"]) as f:
                    page, n = struct.unpack(PAGE_LAYOUT, f.read(struct.calcsize(PAGE_LAYOUT)))
                    at, full = 0, True
                    while full and at < n:
                        cells = np.frombuffer(f.read(4 * min(FIRST_CELLS, n - at)), "<u4")
                        empty = np.flatnonzero(cells == 0)
                        end = int(empty[0]) if len(empty) else len(cells)
                        yield pa.record_batch([pa.array(np.full(end, page, np.int64)), pa.array(np.arange(at, at + end)), pa.array(cells[:end].astype(np.int64))], names=["page", "idx", "cell"])
                        full, at = end == len(cells) > 0, at + len(cells)

    return ranges.tasks(spark, [(place,) for place, _ in ranges.found(spark, path)], "place string").mapInArrow(run, "page long, idx long, cell long")


def decoded(cells: DataFrame, value_bits: int) -> DataFrame:
    """Adds key and internal_id of packed cells."""
    return cells.withColumn("key", F.shiftrightunsigned("cell", value_bits)).withColumn("internal_id", F.col("cell").bitwiseAND(F.lit((1 << value_bits) - 1).cast("long")))


def _placed(idx: np.ndarray, cell: np.ndarray, start: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a range (start, size) after linear probing, and those that run over its end."""
    order = np.lexsort((cell, idx))
    idx, cell = idx[order] - start, cell[order]
    step = np.arange(len(idx))
    place = np.maximum.accumulate(idx - step) + step if len(idx) else idx
    inside = place < size
    out = np.zeros(size, "<u4")
    out[place[inside]] = cell[inside]
    return out, cell[~inside]


def write_pages(cells: DataFrame, directory: str, capacity: int, page_cells: int) -> None:
    """hash_N.k2d files (N from 1) from (idx, cell), written by tasks, a page by one of them range by range.

    Entries that share a place are put in the next free one of the page, wrapping, as probing would; a page with more entries than
    cells is an error. Ranges are filled side by side; the few entries that run over a range's end take the first free places of those
    behind it, where probing from their own place, past full cells only, finds them.
    """
    spark = cells.sparkSession
    step = max(1, min(page_cells, ranges.RANGE // 4))
    page = F.floor(F.col("idx") / page_cells).cast("long")
    within = F.col("idx") % page_cells
    ranged = cells.select(page.alias("page"), F.floor(within / step).cast("long").alias("part"), within.cast("long").alias("at"), F.col("cell").cast("long").alias("cell"))

    def size_of(page: int, part: int) -> int:
        return min(step, min(page_cells, capacity - page * page_cells) - part * step)

    def over(key: tuple, table: pa.Table) -> pa.Table:
        page, part = (k.as_py() for k in key)
        _, rest = _placed(table["at"].to_numpy(), table["cell"].to_numpy(), part * step, size_of(page, part))
        return pa.table([pa.array([page]), pa.array([part]), pa.array([size_of(page, part) - table.num_rows + len(rest)]), pa.array([rest.tolist()], pa.list_(pa.int64()))], names=["page", "part", "free", "rest"])

    def dealt_over(key: tuple, table: pa.Table) -> pa.Table:
        """Which range takes which of the entries that ran over."""
        page = key[0].as_py()
        parts = -(-min(page_cells, capacity - page * page_cells) // step)
        free, rest = [size_of(page, i) for i in range(parts)], [[] for _ in range(parts)]
        for r in table.to_pylist():
            free[r["part"]], rest[r["part"]] = r["free"], r["rest"]
        taken = [[] for _ in range(parts)]
        for i in range(parts):
            to = i
            for cell in rest[i]:
                for _ in range(parts + 1):
                    if free[to % parts] and to > i:
                        break
                    to += 1
                else:
                    raise ValueError(f"page {page + 1}: more entries than cells")
                free[to % parts] -= 1
                taken[to % parts].append(cell)
        kept = [i for i in range(parts) if taken[i]]
        return pa.table([pa.array([page] * len(kept), pa.int64()), pa.array(kept, pa.int64()), pa.array([taken[i] for i in kept], pa.list_(pa.int64()))], names=["page", "part", "taken"])

    def packed(key: tuple, own: pa.Table, carried: pa.Table) -> pa.Table:
        page, part = (k.as_py() for k in key)
        out, _ = _placed(own["at"].to_numpy(), own["cell"].to_numpy(), part * step, size_of(page, part))
        for taken in carried["taken"].to_pylist():
            out[np.flatnonzero(out == 0)[: len(taken)]] = taken
        return pa.table([pa.array([page]), pa.array([part]), pa.array([out.tobytes()], pa.binary())], names=["page", "part", "content"])

    place = ranges.location(spark, directory)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, out, at = None, None, 0

        def until(part: int) -> None:
            nonlocal at
            while at < part:
                out.write(bytes(4 * size_of(page, at)))
                at += 1

        for batch in batches:
            for r in batch.to_pylist():
                if r["page"] != page:
                    if out:
                        until(-(-min(page_cells, capacity - page * page_cells) // step))
                        out.close()
                    page, at = r["page"], 0
                    out = ranges.created(f"{place}/hash_{page + 1}.k2d")
                    out.write(struct.pack(PAGE_LAYOUT, page + 1, min(page_cells, capacity - page * page_cells)))
                if r["content"] is not None:
                    until(r["part"])
                    out.write(r["content"])
                    at += 1
        if out:
            until(-(-min(page_cells, capacity - page * page_cells) // step))
            out.close()
        yield pa.record_batch([pa.array([1 if out else 0])], names=["done"])

    by = ["page", "part"]
    carried = ranged.groupBy(*by).applyInArrow(over, "page long, part long, free long, rest array<long>").groupBy("page").applyInArrow(dealt_over, "page long, part long, taken array<long>")
    content = ranged.groupBy(*by).cogroup(carried.groupBy(*by)).applyInArrow(packed, "page long, part long, content binary")
    every = spark.range(pages_needed(capacity, page_cells)).select(F.col("id").alias("page"), F.lit(-1).cast("long").alias("part"), F.lit(None).cast("binary").alias("content"))
    content.unionByName(every).repartition("page").sortWithinPartitions("page", "part").mapInArrow(write, "done long").agg(F.sum("done")).collect()


def write_taxonomy(table: DataFrame, path: str) -> None:
    """A taxonomy file from ``node_table``; the tree is bounded."""
    rows = sorted(table.collect(), key=lambda r: r.internal_id)
    ranks = sorted({r.rank for r in rows})
    rank_at, pool = {}, b""
    for r in ranks:
        rank_at[r] = len(pool)
        pool += r.encode() + b"\0"
    names, nodes = b"", [(0,) * len(NODE_FIELDS)]
    for r in rows:
        if r.name is None:
            raise ValueError(f"taxid {r.external_id} has no scientific name")
        kids = sorted(r.child_ids)
        nodes.append((r.parent_id, kids[0] if kids else 0, len(kids), len(names), rank_at[r.rank], r.external_id, 0))
        names += r.name.encode() + b"\0"
    head = TAXONOMY_MAGIC + struct.pack("<3Q", len(nodes), len(names), len(pool))
    write_bytes(table.sparkSession, path, head + b"".join(struct.pack(f"<{len(NODE_FIELDS)}Q", *n) for n in nodes) + names + pool)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """taxid, parent, rank, name, internal_id of a taxonomy file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_buffer().to_pybytes()
                if raw[:8] != TAXONOMY_MAGIC:
                    raise ValueError("not a taxonomy file")
                n, name_size, _ = struct.unpack_from("<3Q", raw, 8)
                nodes = np.frombuffer(raw, [(f, "<u8") for f in NODE_FIELDS], n, 32)
                names = raw[32 + nodes.nbytes : 32 + nodes.nbytes + name_size]
                ranks = raw[32 + nodes.nbytes + name_size :]
                text = lambda pool, at: pool[at : pool.index(b"\0", at)].decode()
                own = nodes[1:]
                yield pa.record_batch(
                    [
                        pa.array(own["external_id"].astype(np.int64)),
                        pa.array(np.where(own["parent_id"] > 0, nodes["external_id"][own["parent_id"].astype(np.int64)], 0).astype(np.int64)),
                        pa.array([text(ranks, int(a)) for a in own["rank_offset"]], pa.string()),
                        pa.array([text(names, int(a)) for a in own["name_offset"]], pa.string()),
                        pa.array(np.arange(1, n, dtype=np.int64)),
                    ],
                    names=["taxid", "parent", "rank", "name", "internal_id"],
                )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "taxid long, parent long, rank string, name string, internal_id long")


def reshard(spark: SparkSession, table: str, directory: str, page_cells: int) -> HashConfig:
    """A single-file table as pages of ``page_cells`` cells and a configuration; refuses to overwrite one.

    A page is copied by a task, range by range.
    """
    if exists(spark, f"{directory}/hash_config.k2d"):
        raise FileExistsError(f"{directory}/hash_config.k2d")
    own = read_table_header(spark, table)
    config = HashConfig(0, -(-own.capacity // page_cells), page_cells, own.capacity, own.size, own.value_bits)
    head, source, place = struct.calcsize(TABLE_LAYOUT), ranges.location(spark, table), ranges.location(spark, directory)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column("page").to_pylist():
                cells = min(page_cells, own.capacity - page * page_cells)
                with ranges.opened(source) as f, ranges.created(f"{place}/hash_{page + 1}.k2d") as out:
                    out.write(struct.pack(PAGE_LAYOUT, page + 1, cells))
                    f.seek(head + 4 * page * page_cells)
                    left = 4 * cells
                    while left:
                        raw = f.read(min(left, ranges.RANGE))
                        if not raw:
                            raise ValueError(f"{source} ends early")
                        out.write(raw)
                        left -= len(raw)
            yield pa.record_batch([batch.column("page")], names=["page"])

    ranges.tasks(spark, [(i,) for i in range(config.partition)], "page long").mapInArrow(copy, "page long").count()
    write_config(spark, f"{directory}/hash_config.k2d", config)
    return config


def sample_chunk_header(data: bytes) -> tuple[int, int]:
    """Partition index and cells of a chunk, from the head of a sample chunk file."""
    return struct.unpack_from(CHUNK_LAYOUT, data)


def pages_needed(capacity: int, page_cells: int) -> int:
    return math.ceil(capacity / page_cells)
