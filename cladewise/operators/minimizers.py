"""Minimizers of DNA sequences: a readable SQL form and an Arrow kernel that give the same rows.

A k-mer's minimizer is the least, under an order scrambled by a toggle mask, of its canonical l-mers (the smaller of an l-mer and its reverse
complement in 2-bit letters), masked by a spaced seed; its hash is one Murmur block. k-mers with other letters than ACGT have none. Positions
count k-mers from 1; a second mate continues after the first one's k-mers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import MURMUR_1, MURMUR_2, MURMUR_ADD, FMIX_1, FMIX_2, TOGGLE_MASK, murmur_hash3, unsigned_at_least
from ..functions.parallel import dealt
from ..functions.scalars import seed_mask

SLICE_LETTERS = 1 << 17
#: Hashes that leave the kernel together, and input bytes (files as they are) for each range of hashes, when distinct ones are counted.
PACKED = 1 << 22
RANGE_BYTES = 4 << 20


@dataclass(frozen=True)
class Scheme:
    """How minimizers are made. ``clear_from``: only hashes (unsigned) from it on are kept."""

    k: int = 35
    l: int = 31  # noqa: E741
    spaces: int = 7
    toggle: int = TOGGLE_MASK
    clear_from: int | None = None

    def __post_init__(self):
        if not 1 <= self.l <= 31 or self.k < self.l:
            raise ValueError("k must be at least l, and l at most 31")
        seed_mask(self.l, self.spaces)

    @property
    def letters_mask(self) -> int:
        return (1 << 2 * self.l) - 1

    @property
    def mask(self) -> int:
        return seed_mask(self.l, self.spaces) if self.spaces else self.letters_mask

    @property
    def flip(self) -> int:
        return self.toggle & self.letters_mask & self.mask


def minimizers_sql(reads: DataFrame, scheme: Scheme, keys: list[str], seq: str = "seq") -> DataFrame:
    """keys, pos, hash: the specification, in built-in expressions (a row per l-mer, a window minimum per k-mer)."""
    k, l = scheme.k, scheme.l  # noqa: E741
    rows = reads.select(*keys, F.upper(seq).alias("s")).filter(F.length("s") >= k)
    lmers = rows.select(*keys, "s", F.explode(F.sequence(F.lit(1), F.length("s") - l + 1)).alias("pos")).withColumn("w", F.substr("s", F.col("pos"), F.lit(l)))
    number = lambda text: F.conv(F.translate(text, "ACGT", "0123"), 4, 10).cast("long")
    forward, backward = number(F.col("w")), number(F.reverse(F.translate("w", "ACGT", "TGCA")))
    valid = F.col("w").rlike(r"^[ACGT]+\z")
    order = F.when(valid, F.least(forward, backward).bitwiseAND(F.lit(scheme.mask)).bitwiseXOR(F.lit(scheme.flip)))
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(0, k - l)
    # a k-mer of whose l-mers one is not valid has no minimizer
    mins = lmers.select(*keys, "pos", F.length("s").alias("n"), order.alias("c")).select(*keys, "pos", "n", F.min("c").over(w).alias("m"), F.count("c").over(w).alias("full"))
    found = mins.filter((F.col("full") == k - l + 1) & (F.col("pos") <= F.col("n") - k + 1)).select(*keys, "pos", murmur_hash3(F.col("m").bitwiseXOR(F.lit(scheme.flip))).alias("hash"))
    return found if scheme.clear_from is None else found.filter(unsigned_at_least(F.col("hash"), scheme.clear_from))


_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i


def _murmur(x: np.ndarray) -> np.ndarray:
    u = np.uint64
    rotate = lambda v, r: v << u(r) | v >> u(64 - r)
    h = rotate(rotate(x * u(MURMUR_1), 31) * u(MURMUR_2), 27) * u(5) + u(MURMUR_ADD)
    h ^= u(8)
    for m in (FMIX_1, FMIX_2):
        h = (h ^ h >> u(33)) * u(m)
    return h ^ h >> u(33)


def _words(code: np.ndarray, l: int) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """The numbers of all words of l letters and of their reverse complements, put together from words of 1, 2, 4, ... letters."""
    u, m = np.uint64, len(code) - l + 1
    ahead, back, width = code, u(3) - code, 1
    forward, backward, done = np.zeros(m, u), np.zeros(m, u), 0
    while True:
        if l & width:
            forward = forward << u(2 * width) | ahead[done : done + m]
            backward |= back[done : done + m] << u(2 * done)
            done += width
        if done == l:
            return forward, backward
        ahead, back = ahead[:-width] << u(2 * width) | ahead[width:], back[:-width] | back[width:] << u(2 * width)
        width *= 2


def scan(letters: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Starts (from 0) and minimizer hashes of all k-mers of valid letters in one run of bytes."""
    k, l, u = scheme.k, scheme.l, np.uint64  # noqa: E741
    n = len(letters) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    code = _CODE[letters]
    bad = np.cumsum(np.concatenate([[0], code > 3]))
    forward, backward = _words((code & 3).astype(np.uint64), l)
    order = np.minimum(forward, backward) & u(scheme.mask) ^ u(scheme.flip)
    least = order[:n].copy()
    for i in range(1, k - l + 1):
        np.minimum(least, order[i : i + n], out=least)
    at = np.flatnonzero(bad[k:] == bad[:n])
    h = _murmur(least[at] ^ u(scheme.flip))
    if scheme.clear_from is not None:
        keep = h >= u(scheme.clear_from)
        at, h = at[keep], h[keep]
    return at, h


def _scanned(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """By slices of batches with a column _seq: the batch, and of each k-mer its row there, its position in that row's sequence and its hash."""
    for batch in batches:
        seq = batch.column("_seq").cast(pa.large_string())
        ends = np.frombuffer(seq.buffers()[1], np.int64)[seq.offset : seq.offset + len(seq) + 1]
        data = np.frombuffer(seq.buffers()[2] or b"", np.uint8)
        for at, to in letter_slices(ends, scheme.k):
            start, h = scan(data[at:to], scheme)
            start = start + at
            first, last = int(np.searchsorted(ends, at, side="right")) - 1, int(np.searchsorted(ends, to))
            row = np.repeat(np.arange(first, last), np.diff(np.searchsorted(start, ends[first : last + 1])))
            own = start + scheme.k <= ends[row + 1]
            start, h, row = start[own], h[own], row[own]
            yield batch, row, start - ends[row] + 1, h


def _seq(reads: DataFrame, seq: str, *more) -> DataFrame:
    return dealt(reads.select(*more, F.coalesce(F.col(seq), F.lit("")).alias("_seq")))


def minimizers(reads: DataFrame, scheme: Scheme, keys: list[str], seq: str = "seq", offset: str | None = None, sieve: bytes | None = None, once: bool = False) -> DataFrame:
    """keys, pos, hash by the Arrow kernel: reads are scanned as one buffer, k-mers over the border of two are left out.

    A slice has about ``SLICE_LETTERS``; a longer sequence is scanned in pieces that overlap by k - 1 letters, so memory beside the sequence itself is
    that of a piece. ``offset``: column added to positions (for second mates). ``sieve``: a bitmap of hashes (``index.sieve``); k-mers whose bit is not set are
    left out. ``once``: of equal hashes that follow one another in a read only the first (for sets of hashes).
    """
    fields = [f for f in reads.schema if f.name in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", pos int, hash long"
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if sieve is None else np.frombuffer(sieve, np.uint8)
        for batch, row, place, h in _scanned(batches, scheme):
            if bits is not None:
                keep = in_sieve(bits, h)
                row, place, h = row[keep], place[keep], h[keep]
            if once and len(h):
                keep = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
                row, place, h = row[keep], place[keep], h[keep]
            if offset:
                place = place + batch.column("_offset").to_numpy(zero_copy_only=False).astype(np.int64)[row]
            yield pa.record_batch([*(batch.column(c).take(pa.array(row)) for c in names), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64))], names=[*names, "pos", "hash"])

    return _seq(reads, seq, *names, *([F.coalesce(offset, F.lit(0)).alias("_offset")] if offset else [])).mapInArrow(run, schema)


def in_sieve(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash, by its low bits, is set in a bitmap of 2^n bits."""
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def sorted_once(hashes: list[np.ndarray]) -> np.ndarray:
    """Distinct hashes in order; numpy's own ``unique`` takes some fifty times as long for them."""
    h = np.sort(np.concatenate(hashes))
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def distinct(reads: DataFrame, scheme: Scheme, seq: str = "seq") -> DataFrame:
    """One row: kmers and the exact number of distinct minimizers.

    Hashes leave the kernel without repetitions among ``PACKED`` of them, packed by ranges of the hash, and are counted range by range. The number of ranges goes with
    the size of the input, so a range stays at some megabytes; no hash weighs more than one entry of each pack.
    """
    size = int(reads._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    bits = 10 if size >= 1 << 60 else min(max(3, (size // RANGE_BYTES).bit_length()), 16)  # 2^60 and more: Spark does not know
    bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def packed(kmers: int, held: list[np.ndarray]) -> pa.RecordBatch:
        h = sorted_once(held)
        ends = np.concatenate([[0], np.searchsorted(h, bounds), [len(h)]])
        some = np.flatnonzero(np.diff(ends))
        offsets = np.append(8 * ends[some], 8 * len(h)).astype(np.int32)
        hashes = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(h)])
        return pa.record_batch([pa.array(some.astype(np.int32)), pa.array(np.where(np.arange(len(some)) == 0, kmers, 0)), hashes], names=["part", "kmers", "hashes"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kmers, held, n = 0, [], 0
        for *_, h in _scanned(batches, scheme):
            if not len(h):
                continue
            kmers += len(h)
            held.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
            n += len(held[-1])
            if n >= PACKED:
                yield packed(kmers, held)
                kmers, held, n = 0, [], 0
        if held:
            yield packed(kmers, held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kmers, held = 0, {}
        for batch in batches:
            kmers += sum(batch.column("kmers").to_pylist())
            for part, data in zip(batch.column("part").to_pylist(), batch.column("hashes"), strict=True):
                held.setdefault(part, []).append(np.frombuffer(data.as_py(), np.uint64))
        yield pa.record_batch([pa.array([kmers]), pa.array([sum(len(sorted_once(held.pop(part))) for part in list(held))], pa.int64())], names=["kmers", "distinct"])

    parts = _seq(reads, seq).mapInArrow(pack, "part int, kmers long, hashes binary").repartition(1 << bits, "part").mapInArrow(count, "kmers long, distinct long")
    return parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kmers", "distinct")))


def letter_slices(ends: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """Ranges of letters of about ``SLICE_LETTERS``: whole sequences, or pieces of a longer one that overlap by k - 1."""
    at, n = 0, len(ends) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_LETTERS, side="right")) - 1))
        first, last = int(ends[at]), int(ends[to])
        while last - first > SLICE_LETTERS + k:
            yield first, first + SLICE_LETTERS
            first += SLICE_LETTERS - (k - 1)
        yield first, last
        at = to


def runs(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each run of equal minimizers at consecutive positions: keys, pos of the first, hash, length."""
    w = Window.partitionBy(*keys).orderBy("pos")
    new = F.when((F.lag("hash").over(w) == F.col("hash")) & (F.lag("pos").over(w) == F.col("pos") - 1), 0).otherwise(1)
    marked = found.withColumn("_new", new)
    return marked.withColumn("_run", F.sum("_new").over(w)).groupBy(*keys, "_run").agg(F.min("pos").alias("pos"), F.first("hash").alias("hash"), F.count("*").alias("length")).drop("_run")


def kmer_count(length, k: int):
    """Positions of a sequence: length - k + 1, 0 if it is shorter."""
    return F.greatest(F.lit(0), length - k + 1)

