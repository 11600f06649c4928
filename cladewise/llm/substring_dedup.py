"""Substring dedup behind a count-min prefilter.

Documents are dealt into parts of about ``PART_BYTES``. Pass 1: each part counts its 20-word windows into its own sketch of ``DEPTH`` rows;
the sketches of all parts are merged slice by slice into counts that never underestimate, and the owner of a slice answers
each part which of the cells that it sent once count two or more. Pass 2, over the same exchange of documents: only windows estimated to occur
twice or more are grouped, exactly, by 96-bit keys from two independent hashes of their words; a window seen once for sure is
not shuffled, and none that repeats is missed. Of the occurrences of a window in one part only the first travels: a later one is removed
whatever the others hold, so a passage that every document shares costs one record for each part and not one for each document.

The sketch has one to two cells a byte of text in each row, about 0.1 windows a cell at any size, and is nowhere held as a whole: nothing is
broadcast. A part sends its cells as gaps of one to a few bytes. A task holds one part or one slice (about ``OWNED`` cells);
a single longer document is a part of its own.

Defined cases: null text has no words; a document of fewer than ``width`` words loses nothing; rows that share an identifier are
documents of their own whose windows at the same start are equally early (rows repeated in full lose the same words); null identifiers count
as the largest; of equal windows in one document the earliest start stays; very long texts are read whole; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, mix, ranges, slices, span_hashes, text_buffer, window_hashes, words

WIDTH = 20
DEPTH = 2
PART_BYTES = 1 << 23
OWNED = 1 << 24
LEAST_SLICES = 256
TAG_BITS = 24
LAST = (1 << 63) - 1


def _windows(batch: pa.RecordBatch, width: int, second: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key of every window of the batch, second key (if asked for), row, and start (in words of that row)."""
    data, offsets = text_buffer(batch.column("text"))
    starts, ends, first = words(data, offsets)
    at, row = ranges(first[:-1], np.maximum(np.diff(first) - width + 1, 0))
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), row, at
    key = window_hashes(span_hashes(data, starts, ends), at, width, 31)
    other = window_hashes(span_hashes(data, starts, ends, 13), at, width, 47) if second else key
    return key, other, row, at - first[row]


def _cells(key: np.ndarray, row: int, log_width: int) -> np.ndarray:
    """The cell of each key in a row of the sketch."""
    return mix(key ^ np.uint64(row)) & np.uint64((1 << log_width) - 1) | np.uint64(row << log_width)


def pack_gaps(gap: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Numbers as base-128 digits, least first, the last digit of each below 128; one binary value for each range of ``bounds``."""
    digits = np.ones(len(gap), np.int64)
    for i in range(1, 10):
        more = gap >> np.uint64(7 * i) > 0
        if not more.any():
            break
        digits[more] = i + 1
    end = np.cumsum(digits)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for i in range(int(digits.max()) if len(digits) else 0):
        own = np.flatnonzero(digits > i)
        out[end[own] - digits[own] + i] = (gap[own] >> np.uint64(7 * i) & np.uint64(127)).astype(np.uint8) | ((digits[own] > i + 1).astype(np.uint8) << 7)
    offsets = np.concatenate([[0], end])[bounds]
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])


def unpack_gaps(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all values, and how many each value has."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])[: len(last)]
    digits = last - first + 1
    gap = np.zeros(len(last), np.uint64)
    for i in range(int(digits.max()) if len(digits) else 0):
        own = np.flatnonzero(digits > i)
        gap[own] |= (data[first[own] + i] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * i)
    return gap, np.diff(np.searchsorted(last, offsets - offsets[0]))


def _sums(gap: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Running sums of the gaps inside each run of ``count``."""
    total = np.cumsum(gap)
    start = np.cumsum(count) - count
    before = np.where(start > 0, total[np.maximum(start, 1) - 1], np.uint64(0)) if len(total) else np.zeros(len(count), np.uint64)
    return total - np.repeat(before, count)


def _heads(cells: np.ndarray) -> np.ndarray:
    """Where runs of equal cells begin in sorted ones."""
    return np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)


def _sketch(width: int, log_width: int, log_slice: int):
    """A part's sketch: for each slice, the cells counted once and those counted more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys = None, []
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            keys += [_windows(b, width, False)[0] for b in slices(batch)]
        key = np.concatenate([np.zeros(0, np.uint64), *keys])
        keys.clear()
        for row in range(DEPTH if len(key) else 0):
            cells = np.sort(_cells(key, row, log_width))
            at = _heads(cells)
            more = np.diff(np.append(at, len(cells))) > 1
            cells = cells[at]
            own = np.unique(cells >> np.uint64(log_slice))
            columns = []
            for some in (cells[~more], cells[more]):
                of = some >> np.uint64(log_slice)
                bounds = np.append(np.searchsorted(of, own), len(of))
                gap = np.diff(some & np.uint64((1 << log_slice) - 1), prepend=np.uint64(0))
                head = bounds[:-1][np.diff(bounds) > 0]
                gap[head] = some[head] & np.uint64((1 << log_slice) - 1)
                columns.append(pack_gaps(gap, bounds).cast(pa.binary()))
            yield pa.record_batch([pa.array(np.full(len(own), part, np.int64)), pa.array(own.astype(np.int64)), *columns], names=["part", "slice", "once", "more"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up a slice of all parts; answers each part which of the cells that it has once count two or more."""
    held = [b for b in batches if b.num_rows]
    table = pa.Table.from_batches(held).combine_chunks()
    once, n = unpack_gaps(table.column("once").chunk(0))
    once = _sums(once, n)
    more, m = unpack_gaps(table.column("more").chunk(0))
    more = _sums(more, m)
    cells = np.concatenate([once, more, more])
    order = np.argsort(cells)
    cells = cells[order]
    run = np.diff(np.append(_heads(cells), len(cells)))
    repeated = np.empty(len(cells), bool)
    repeated[order] = np.repeat(run > 1, run)
    repeated = repeated[: len(once)]
    # the bits of each part begin a byte of their own
    size = -(-n // 8)
    bits = np.zeros(int(size.sum()) * 8, bool)
    bits[np.repeat(8 * (np.cumsum(size) - size), n) + np.arange(len(once)) - np.repeat(np.cumsum(n) - n, n)] = repeated
    packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(np.packbits(bits))])
    yield pa.record_batch([table.column("part").chunk(0), table.column("slice").chunk(0), packed], names=["part", "slice", "bits"])


def _found(width: int, log_width: int, log_slice: int):
    """Windows estimated repeated: the first of each key in the part as one row each, later ones as known marks of their documents."""

    def firsts(k1, k2, doc, tag, pos) -> pa.Table:
        order = np.lexsort((tag, pos, doc, k2, k1))
        k1, k2, doc, tag, pos = (x[order] for x in (k1, k2, doc, tag, pos))
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
        later = (doc != doc[head]) | (pos != pos[head])
        # of rows repeated in full one is enough
        first = ~later
        first[1:] &= new[1:] | (tag[1:] != tag[:-1])
        order = np.flatnonzero(later)
        order = order[np.lexsort((pos[order], tag[order], doc[order]))]
        d, t = doc[order], tag[order]
        at = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])]) if len(d) else np.zeros(0, np.int64)
        known = pa.ListArray.from_arrays(pa.array(np.r_[at, len(d)].astype(np.int32)), pa.array(pos[order].astype(np.int32)))
        columns = [
            np.r_[k1[first], mix(d[at].astype(np.uint64) ^ t[at].astype(np.uint64))].view(np.int64),
            np.r_[k2[first], np.zeros(len(at), np.uint32)].view(np.int32),
            np.r_[doc[first], d[at]],
            np.r_[pos[first] << TAG_BITS | tag[first], t[at]],
        ]
        return pa.table([*map(pa.array, columns), pa.concat_arrays([pa.nulls(int(first.sum()), known.type), known])], names=["k1", "k2", "doc", "place", "known"])

    def estimated(key: np.ndarray, row: int, told: np.ndarray, bits: pa.ChunkedArray) -> np.ndarray:
        """Whether the merged sketch's row counts two or more for each key."""
        cells = _cells(key, row, log_width)
        order = np.argsort(cells)
        cells = cells[order]
        at = _heads(cells)
        run = np.diff(np.append(at, len(cells)))
        twice = run > 1
        once = np.flatnonzero(~twice)
        found, n = np.unique(cells[at[once]] >> np.uint64(log_slice), return_counts=True)
        full = np.isin(told, found.astype(np.int64))  # a slice in which the part has nothing once needs no answer
        if int(full.sum()) != len(found):
            raise RuntimeError("a part lacks answers of the sketch")
        size = -(-n // 8)
        answer = np.unpackbits(np.frombuffer(b"".join(bits.filter(pa.array(full)).to_pylist()), np.uint8))
        twice[once] = answer[np.repeat(8 * (np.cumsum(size) - size) - (np.cumsum(n) - n), n) + np.arange(len(once))] > 0
        out = np.empty(len(cells), bool)
        out[order] = np.repeat(twice, run)
        return out

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        held = [(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32))]
        n = 0
        for batch in docs.to_batches():
            for part in slices(batch):
                k1, k2, row, pos = _windows(part, width, True)
                held.append((k1, k2.astype(np.uint32), (row + n).astype(np.int32), pos.astype(np.int32)))
                n += part.num_rows
        k1 = np.concatenate([x[0] for x in held])
        keep = np.ones(len(k1), bool)
        if len(k1):
            answers = answers.sort_by("slice")
            for row in range(DEPTH):
                keep &= estimated(k1, row, answers.column("slice").to_numpy(), answers.column("bits"))
        k1 = k1[keep]
        k2, row, pos = (np.concatenate([x[i] for x in held])[keep] for i in (1, 2, 3))
        held.clear()
        doc, tag = (docs.column(c).to_numpy().astype(np.int64)[row] for c in ("doc", "tag"))
        return firsts(k1, k2, doc, tag, pos.astype(np.int64))

    return run


def _cut(width: int):
    """Removes the covered words of each document beside its marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n_words, n_removed, kept = [], [], []
                for text, marks in zip(part.column("text"), part.column("marks"), strict=True):
                    own = (text.as_py() or "").encode().split()  # bytes split at the six blanks
                    n = len(own)
                    if marks.is_valid:
                        at = marks.values.to_numpy().astype(np.int64)
                        cover = np.zeros(n + 1, np.int64)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + width, -1)
                        own = list(compress(own, (np.cumsum(cover[:n]) == 0).tolist()))
                    n_words.append(n)
                    n_removed.append(n - len(own))
                    kept.append(b" ".join(own).decode())
                yield pa.record_batch([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def candidates(rows: DataFrame, width: int = WIDTH, part_bytes: int = PART_BYTES, owned: int = OWNED) -> DataFrame:
    """Windows of ``rows`` (doc, tag, text) that the merged sketch estimates repeated: k1, k2, doc, place (start and tag), known (marks)."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log_width = max(16, int(size).bit_length())
    n_slices = max(LEAST_SLICES, (size // 5 * DEPTH) // owned)  # words have some letters and a blank
    log_slice = log_width + DEPTH.bit_length() - 1 - int(n_slices - 1).bit_length()
    parts = max(8 * spark.sparkContext.defaultParallelism, -(-size // part_bytes))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id(), "doc", "tag"), F.lit(parts))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts // 8)
    # both passes read this one exchange
    own = rows.withColumn("part", place).repartition(tasks, "part")
    sketch = own.groupBy("part").applyInArrow(_sketch(width, log_width, log_slice), "part long, slice long, once binary, more binary")
    answers = sketch.groupBy("slice").applyInArrow(_merge, "part long, slice long, bits binary")
    return own.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_found(width, log_width, log_slice), "k1 long, k2 int, doc long, place long, known array<int>")


def _marks(found: DataFrame) -> DataFrame:
    """(doc, tag, marks): starts of the windows of each document that start earlier elsewhere."""
    start = F.shiftright("place", TAG_BITS)
    rank = F.rank().over(Window.partitionBy("k1", "k2").orderBy("doc", start))
    later = found.withColumn("rank", rank).filter("known is not null or rank > 1")
    tag = F.col("place").bitwiseAND(F.lit((1 << TAG_BITS) - 1))
    return later.select("doc", tag.alias("tag"), F.coalesce("known", F.array(start.cast("int"))).alias("marks")).groupBy("doc", "tag").agg(F.flatten(F.collect_list("marks")).alias("marks"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, part_bytes: int = PART_BYTES, owned: int = OWNED) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text."""
    scratch = Scratch(docs.sparkSession)
    own_id = F.col(id_col).cast("long")
    # the tag tells rows apart that share an identifier
    rows = docs.select(own_id.alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(own_id, F.lit(LAST)).alias("doc"), F.shiftrightunsigned(F.xxhash64(text_col), 64 - TAG_BITS).alias("tag"))
    found = scratch.table(candidates(rows.select("doc", "tag", "text"), width, part_bytes, owned), "candidates")
    marks = scratch.table(_marks(found), "marks")
    scratch.drop("candidates")
    return rows.join(marks, ["doc", "tag"], "left").select("doc_id", "text", "marks").mapInArrow(_cut(width), "doc_id long, n_words long, n_removed long, kept_text string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
SQL = {
    "op3_substring_dedup": r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
p as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1))) as i from w),
k as (select doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) as k from p),
m as (select doc_id, i from (select *, row_number() over (partition by k order by doc_id, i) as n from k) where n > 1),
c as (select distinct doc_id, unnest(range(i, i + 20)) as i from m),
g as (select doc_id, count(*) as n from c group by doc_id),
x as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from w),
t as (select doc_id, string_agg(word, ' ' order by i) as kept from x anti join c using (doc_id, i) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(g.n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join g using (doc_id) left join t using (doc_id)"""
}
