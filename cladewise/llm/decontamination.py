"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle sets (five words, ASCII letters lower-cased; upper bounds are powers of two). Each partition is
an index of its own: an item of a partition with upper bound u is signed by its floor((1 - t) u) + 1 least hash values (all, if it has
fewer). A document that holds the share t of an item's q shingles lacks at most floor((1 - t) q) of them, so it holds one of the signature: the
search loses nothing. Each partition is probed with the document's shingles; what its signatures find is confirmed by counting the item's
distinct shingles in the whole document. An item of one to four words is one shingle of its own width; it is looked up among the documents' windows
of that width, so it is found wherever its words stand in a row. The SQL has windows of five words only and finds such an item only as a whole text.

A benchmark of up to ``BLOCK`` shingles (32 MB of hashes, counted first) is broadcast whole, and documents are read once and not shuffled. A
larger one stays a table: a broadcast bitmap of 2^``BITMAP`` bits leaves of each document that has a signature's bit only the shingles that items may have, and
those meet the table in a join on the hash, summed by document and item. Both ways give the same rows; memory is bounded in both.

Defined cases: null or empty texts hold nothing and are found nowhere; a text of fewer than five words is one shingle, and holds items no longer than itself; repeated rows
and items are each reported; null identifiers are reported as null; very long texts are searched whole, a slice of its own each; ties do not arise (every
match is reported); no items or no documents give an empty result; other columns are not read, and are carried by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parallel import dealt
from .common import Scratch, documents, list_array, shingles, slices, text_buffer, words

WIDTH = 5
SHARE = 0.75
BLOCK = 4_000_000
BITMAP = 27
FOUND = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def signature_size(q: int, share: float) -> int:
    """How many of its least hash values sign a set of q shingles: by the upper bound of its size partition."""
    return min(q, int((1 - share) * _bound(q)) + 1)


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            h, _, offsets = shingles(part.column("text"), WIDTH)
            width = np.minimum(np.diff(words(*text_buffer(part.column("text")))[2]), WIDTH).astype(np.int32)
            yield pa.record_batch([part.column("item_id"), pa.array(width), list_array(h.view(np.int64), offsets, pa.int64())], names=["item_id", "width", "set"])


class _Table:
    """Hash values with what they stand for; a bitmap of the leading bits answers most look-ups."""

    BITS = 22

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.key, self.value = key[order], value[order]
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[self.key >> np.uint64(64 - self.BITS)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into h, and the value of each match (an h that stands for several gives several)."""
        at = np.flatnonzero(self.seen[h >> np.uint64(64 - self.BITS)])
        lo, hi = (np.searchsorted(self.key, h[at], side=s) for s in ("left", "right"))
        n = hi - lo
        of = np.repeat(at, n)
        return of, self.value[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]


def _bound(q: int) -> int:
    """The upper bound of a set's size partition."""
    return 1 << max(0, int(q - 1).bit_length())


class _Index:
    """Items of one size partition (of one width): their signatures, and their whole sets."""

    def __init__(self, number: np.ndarray, sets: list[np.ndarray], share: float):
        signs = [h[: signature_size(len(h), share)] for h in sets]  # ascending: the least values come first
        self.sign, self.whole = (_Table(np.concatenate(x), np.repeat(number, [len(h) for h in x])) for x in (signs, sets))

    def matches(self, h: np.ndarray, of: np.ndarray, n_items: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row and item in one number) that the signatures find, and the shingles they share."""
        hit, item = self.sign.find(h)
        found = np.unique(of[hit] * np.int64(n_items) + item)
        if not len(found):
            return found, found
        near = np.flatnonzero(np.isin(of, np.unique(found // n_items)))
        at, item = self.whole.find(h[near])
        pair, shared = np.unique(of[near[at]] * np.int64(n_items) + item, return_counts=True)
        own = np.isin(pair, found)
        return pair[own], shared[own]


def _matches(text: pa.Array, model, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, item and number of shared shingles of each confirmed match."""
    _, sizes, indexes = model
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for width, parts in indexes.items():
        h, of, _ = shingles(text, width)
        found += [index.matches(h, of, len(sizes)) for index in parts]
    pair, shared = (np.concatenate(x) for x in zip(*found, strict=True))
    row, item = pair // len(sizes), pair % len(sizes)
    keep = shared >= share * sizes[item] - 1e-9
    order = np.lexsort((item[keep], row[keep]))
    return row[keep][order], item[keep][order], shared[keep][order]


def _search(model, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, _ = model.value
        for batch in batches:
            for part in slices(batch):
                row, item, shared = _matches(part.column("text"), model.value, share)
                columns = [part.column("doc_id").take(pa.array(row)), pa.array([ids[i] for i in item], pa.int64()), pa.array(shared), pa.array(sizes[item]), pa.array(shared / sizes[item])]
                yield pa.record_batch(columns, names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def _clean(model, share: float, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                keep = np.ones(part.num_rows, bool)
                keep[_matches(part.column(text), model.value, share)[0]] = False
                yield part.filter(pa.array(keep))

    return run


def _model(own: list, share: float):
    """Item identifiers, set sizes, and for each width the indexes of its size partitions."""
    each = [np.array(r["set"], np.int64).view(np.uint64) for r in own]
    place = np.array([(r["width"], _bound(len(h))) for r, h in zip(own, each, strict=True)])
    indexes: dict[int, list[_Index]] = {}
    for width, bound in np.unique(place, axis=0).tolist():
        number = np.flatnonzero((place == (width, bound)).all(axis=1))
        # a set of fewer than five words is one shingle, that of its width; the others have shingles of five
        indexes.setdefault(width, []).append(_Index(number, [each[i] for i in number], share))
    return [r["item_id"] for r in own], np.array([len(h) for h in each]), indexes


def _shared(bits, widths: list[int]):
    """Of each document that has a signature's bit, the shingles (row, doc_id, h) whose bits items have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, whole = (np.frombuffer(b, np.uint8) for b in bits.value)
        has = lambda own, h: own[h >> np.uint64(67 - BITMAP)] >> (h >> np.uint64(64 - BITMAP) & np.uint64(7)).astype(np.uint8) & np.uint8(1) > 0
        for batch in batches:
            for part in slices(batch):
                both = [shingles(part.column("text"), w)[:2] for w in widths]
                h, of = (np.concatenate(x) for x in zip(*both, strict=True))
                keep = np.isin(of, np.unique(of[has(sign, h)]))
                keep[keep] = has(whole, h[keep])
                # a short text is the same shingle at each width
                h, of = h[keep], of[keep]
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                rows = pa.array(of[new])
                yield pa.record_batch([part.column("row").take(rows), part.column("doc_id").take(rows), pa.array(h[new].view(np.int64))], names=["row", "doc_id", "h"])

    return run


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes (place, bits, kind) of the bitmaps of hashes (h, sign)."""
    for batch in batches:
        h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
        sign = batch.column("sign").to_numpy(zero_copy_only=False)
        for kind, own in ((0, h[sign]), (1, h)):
            place, bit = (own >> np.uint64(67 - BITMAP)).astype(np.int64), np.uint8(1) << (own >> np.uint64(64 - BITMAP) & np.uint64(7)).astype(np.uint8)
            order = np.argsort(place, kind="stable")
            place, bit = place[order], bit[order]
            at = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
            value = np.bitwise_or.reduceat(bit, at) if len(at) else bit
            yield pa.record_batch([pa.array(np.full(len(at), kind, np.int32)), pa.array(place[at]), pa.array(value.astype(np.int32))], names=["kind", "place", "bits"])


def _joined(rows: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Matches of a benchmark that is not broadcast: FOUND, and the row of each."""
    spark = rows.sparkSession
    bound = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("set").cast("double"))))
    signed = F.least(F.size("set"), F.floor((1 - share) * bound).cast("int") + 1)
    each = sets.select("item", "item_id", F.size("set").alias("n_item"), signed.alias("signed"), F.posexplode("set").alias("nth", "h"))
    hashes = each.select("h", (F.col("nth") < F.col("signed")).alias("sign"), "item", "item_id", "n_item")
    # 2 * 2^(BITMAP - 3) bytes at most
    found = hashes.select("h", "sign").mapInArrow(_bitmap, "kind int, place long, bits int").groupBy("kind", "place").agg(F.bit_or("bits").alias("bits"))
    maps = [np.zeros(1 << BITMAP - 3, np.uint8) for _ in range(2)]
    for part in found.toArrow().to_batches():
        kind, place, bits = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for k in range(2):
            maps[k][place[kind == k]] = bits[kind == k]
    widths = sorted(r.width for r in sets.select("width").distinct().collect())  # five at most
    shared = dealt(rows).mapInArrow(_shared(spark.sparkContext.broadcast([m.tobytes() for m in maps]), widths), "row long, doc_id long, h long")
    met = shared.join(hashes, "h").groupBy("row", "doc_id", "item", "item_id", "n_item").agg(F.count("*").alias("n_shared"), F.max("sign").alias("sign"))
    met = met.filter(F.col("sign") & (F.col("n_shared") >= share * F.col("n_item") - 1e-9))
    return met.select("row", "doc_id", "item_id", "n_shared", F.col("n_item").cast("long").alias("n_item"), (F.col("n_shared") / F.col("n_item")).alias("containment"))


def _sets(items: DataFrame, item_col: str, item_text: str) -> tuple[DataFrame, int]:
    """Items (item, item_id, width, set) that have a shingle, and how many shingles they have."""
    sets = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).mapInArrow(_item_sets, "item_id long, width int, set array<long>")
    sets = Scratch(items.sparkSession).table(sets.filter(F.size("set") > 0).withColumn("item", F.monotonically_increasing_id()), "items")
    return sets, sets.agg(F.sum(F.size("set"))).first()[0] or 0


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """One row per document and item that it holds to ``share`` or more: doc_id, item_id, n_shared, n_item, containment."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets, size = _sets(items, item_col, item_text)
    if not size:
        return spark.createDataFrame([], FOUND)
    if size > block:
        return _joined(rows.withColumn("row", F.monotonically_increasing_id()), sets, share).drop("row")
    model = spark.sparkContext.broadcast(_model(sets.collect(), share))  # block shingles at most
    return dealt(rows).mapInArrow(_search(model, share), FOUND)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns, that hold no item to ``share`` or more."""
    sets, size = _sets(items, item_col, item_text)
    if not size:
        return docs
    if size > block:
        # what a row holds depends on its text alone, so texts are told apart, by 128 bits and their length
        key = [F.xxhash64(text_col), F.xxhash64(F.lit(1), F.col(text_col)), F.length(text_col)]
        row = docs.select(F.struct(*docs.columns).alias("row"), *[k.alias(f"k{i}") for i, k in enumerate(key)])
        own = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"), *[k.alias(f"k{i}") for i, k in enumerate(key)])
        texts = Scratch(docs.sparkSession).table(own.dropDuplicates(["k0", "k1", "k2"]), "texts")
        held = _joined(texts.select("row", "doc_id", "text"), sets, share).select("row").distinct()
        gone = texts.join(held, "row", "left_semi").select("k0", "k1", "k2")
        return row.join(gone, ["k0", "k1", "k2"], "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
    model = docs.sparkSession.sparkContext.broadcast(_model(sets.collect(), share))  # block shingles at most
    return dealt(docs).mapInArrow(_clean(model, share, text_col), docs.schema)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op9_decontamination": op9_decontamination}
_SETS = r"""
w as (select 'd' as kind, doc_id as id, text from documents union all select 'i', item_id, text from benchmark),
v as (select kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from w),
s as (select distinct kind, id, array_to_string(ws[i:i + 4], ' ') as s from (select kind, id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from v where len(ws) > 0))"""
SQL = {
    "op9_decontamination": f"""with {_SETS},
q as (select id, count(*) as n from s where kind = 'i' group by id)
select d.id as doc_id, i.id as item_id, count(*) as n_shared, any_value(q.n) as n_item, count(*) / any_value(q.n) as containment
from s d join s i on d.s = i.s and d.kind = 'd' and i.kind = 'i' join q on q.id = i.id
group by d.id, i.id having count(*) >= 0.75 * any_value(q.n)"""
}
