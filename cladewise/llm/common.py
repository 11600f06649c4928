"""Shared pieces of the corpus operators: the scratch folder, Arrow batching, word spans and rolling hashes.

Texts arrive as Arrow arrays and are handled as one byte buffer per slice, so hashing is done by a few numpy passes and the
memory of a Python worker follows ``SLICE_BYTES`` (or the longest single document, if that is longer), never the table.
"""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 18
SLICE_ROWS = 2048
CHUNK = 1 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD_BREAKS = (0x20, *range(0x09, 0x0E))
U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Scratch:
    """Written tables in the folder that ``spark.checkpoint.dir`` names (shared by driver and executors).

    Writing and rereading a table cuts the lineage: a lost executor costs a reread, not the whole job.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:  # unset, as in tests
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="scratch-"))
            base = spark.sparkContext.getCheckpointDir()
        self.base = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
        self.names: set[str] = set()
        self._fs(self.base)[0].deleteOnExit(self._fs(self.base)[1])

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes and rereads; the shuffle files of the plan that was written go as soon as it is done."""
        path, conf = f"{self.base}/{name}", self.spark.conf
        self.names.add(name)
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing left to run reads."""
        for name in names:
            fs, path = self._fs(f"{self.base}/{name}")
            fs.delete(path, True)
            self.names.discard(name)

    def settle(self) -> None:
        """Has the driver collect its garbage: what it holds of plans that are done (broadcast tables, records of shuffles) goes only then."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def clear(self, *kept: str) -> None:
        """Deletes all tables but those that the result reads."""
        self.drop(*self.names - set(kept))


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Rows of one Arrow batch in slices of about ``SLICE_BYTES`` of text and at most ``SLICE_ROWS``; a longer document is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        before = size[at - 1] if at else 0
        to = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(size, before + SLICE_BYTES, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def text_buffer(arr: pa.Array, lower_ascii: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, a blank after each, and the offsets (rows + 1); null counts as empty."""
    end, blank = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    joined = pc.binary_join_element_wise(pc.fill_null(arr.cast(pa.large_string()), end), end, blank)
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if lower_ascii:
        data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    return data, offsets - offsets[0]


_BREAK = np.zeros(256, bool)
_BREAK[list(WORD_BREAKS)] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words ``[^\\x20\\x09-\\x0D]+``, and for each text the index of its first word (rows + 1)."""
    gap = _BREAK[data]
    edge = np.diff(gap.view(np.int8), prepend=1, append=1) if len(gap) else np.zeros(0, np.int8)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multiplications, wrapping."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xA3B195354A39B70D)
    return x ^ (x >> U64(32))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a seed's odd base and of its inverse; one pair of tables a seed, grown when a longer buffer comes."""
    if seed not in _POWERS or len(_POWERS[seed][0]) < size:
        base = (int(np.random.default_rng(seed).integers(1 << 62)) << 3 | 3) & (1 << 64) - 1
        size = 1 << max(16, int(size).bit_length())
        _POWERS[seed] = tuple(np.multiply.accumulate(np.concatenate([[U64(1)], np.full(size, b, U64)])) for b in (base, pow(base, -1, 1 << 64)))
    return _POWERS[seed]


@functools.lru_cache(4)
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed + 7).integers(1 << 64, size=256, dtype=U64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 11) -> np.ndarray:
    """64-bit hashes of byte spans, from one running polynomial sum for every ``CHUNK`` of bytes (spans ascend and do not overlap)."""
    out, i = np.empty(len(starts), U64), 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        s, e = starts[i:j] - base, ends[i:j] - base
        part = data[base : base + e[-1]]
        power, inverse = _powers(seed, len(part) + 1)
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(_byte_values(seed)[part] * power[: len(part)], out=total[1:])
        out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U64))
        i = j
    return out


def window_hashes(word: np.ndarray, at: np.ndarray, width: np.ndarray | int, seed: int) -> np.ndarray:
    """64-bit hashes of ``width`` consecutive word hashes from each index of ``at`` (ascending), chunk by chunk."""
    out, i, ends = np.empty(len(at), U64), 0, at + width
    while i < len(at):
        base = at[i]
        j = max(i + 1, int(np.searchsorted(at, base + CHUNK, side="right")))
        s, e = at[i:j] - base, ends[i:j] - base
        part = word[base : base + e.max()]
        power, inverse = _powers(seed, len(part) + 1)
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(part * power[: len(part)], out=total[1:])
        out[i:j] = mix((total[e] - total[s]) * inverse[s])
        i = j
    return out


def ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``first[i] .. first[i] + count[i] - 1`` for all i in one array, and the i of each."""
    count = count.astype(np.int64)
    of = np.repeat(np.arange(len(count)), count)
    return np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count), of


def shingles(arr: pa.Array, width: int, lower_ascii: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within it: (hashes, index of the text of each, offsets).

    A text of fewer words than ``width`` has its whole sequence as one shingle; one without words has none.
    """
    data, offsets = text_buffer(arr, lower_ascii)
    starts, ends, first = words(data, offsets)
    n = np.diff(first)
    wide = np.minimum(n, width)
    at, of = ranges(first[:-1], np.where(n > 0, n - wide + 1, 0))
    word = span_hashes(data, starts, ends)
    h = window_hashes(word, at, wide[of], 23) if len(at) else np.zeros(0, U64)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[keep], of[keep]
    return h, of, np.searchsorted(of, np.arange(len(n) + 1))


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values, kind))


def rank_buckets(n_rows: int, per_bucket: int = 50_000) -> int:
    return max(16, -(-n_rows // per_bucket))


def unit(*cols, seed: str) -> F.Column:
    """A uniform number in [0, 1) from the md5 of a seed and columns: the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)
