"""MinHash near-dedup with odd sketches.

A document's set is its distinct shingles of five words (ASCII letters lower-cased). ``BANDS`` bands of ``ROWS`` MinHash values give
candidates: a pair of similarity 0.75 shares no band with probability (1 - 0.75^4)^40 = 2.5e-7. A set's MinHash sample is folded into a
parity bitmap of ``ODD_BITS`` bits; the population count of the XOR of two bitmaps tells how many samples differ. A set of up to
``SAMPLES`` shingles is its own sample, so the count never exceeds the number of shingles that differ, and a pair whose count does exceed
what similarity 0.75 allows, (n + m) / 7, is refuted for sure. Larger sets have one-permutation samples. Where bits collide often
(and for all samples), candidates go that differ in more than ``MARGIN`` deviations of bits above what the threshold makes differ (a test
draws pairs at the threshold for sets of any size). The others, and pairs of one set of either kind, are confirmed on the full sets.

Groups are never expanded into all their pairs. Documents with equal sets are one class. Within a band, classes are first
linked to one class (the star), then to members of the band's largest component; only classes that still stand outside the largest
component of a band meet all members of that band in other components: directly in bands of up to ``DIRECT`` classes, in wider ones by an exact
prefix filter over the rarest shingles, so that a wide band of texts that are all a little too different costs no pair. A link between two members of one component can change nothing, so the components
are those of all links.

Defined cases: null text, empty text and text without words have an empty set and are linked with nothing; fewer than five words are
one shingle; null identifiers count as the largest and stay null; rows that share an identifier are documents of their own that
have the identifier in common; very long texts are compared whole, a slice of their own each; of equally likely candidates the smaller number is
tried first, which changes no component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parallel import dealt
from .common import Scratch, documents, list_array, mix, ranges, shingles, slices
from .graph import components

WIDTH = 5
THRESHOLD = 75
BANDS, ROWS = 40, 4
SAMPLES, ODD_BITS = 4096, 2048
MARGIN = 6
ROUNDS, DELEGATES = 2, 4
DIRECT, BUCKET = 100, 1.1
CELL_BITS, SLICE_BITS = 20, 14
LAST = (1 << 63) - 1


def _per_set(ufunc, values: np.ndarray, offsets: np.ndarray, empty: int) -> np.ndarray:
    """``ufunc`` over each set's values; ``empty`` for empty sets."""
    out = np.full(len(offsets) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = ufunc.reduceat(values, offsets[:-1][full])
    return out


def _bands(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys, each from ROWS MinHash values."""
    rng = np.random.default_rng(97)
    flip, odd = rng.integers(1 << 32, size=BANDS * ROWS, dtype=np.uint32), rng.integers(1 << 31, size=BANDS * ROWS, dtype=np.uint32) << np.uint32(1) | np.uint32(1)
    short = (h >> np.uint64(32)).astype(np.uint32)
    keys = np.zeros((len(offsets) - 1, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(keys), b + 1, np.uint64)
        for i in range(b * ROWS, (b + 1) * ROWS):
            x = (short ^ flip[i]) * odd[i]
            x ^= x >> np.uint32(15)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + _per_set(np.minimum, x * odd[i - 1], offsets, 0).astype(np.uint64))
        keys[:, b] = key
    return keys


def _odd(h: np.ndarray, of: np.ndarray, sets: int) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps of the samples, and the number of samples of each set: all of a set up to ``SAMPLES``, else one-permutation MinHash."""
    size = np.bincount(of, minlength=sets)
    g = mix(h ^ np.uint64(0x51ED270B7F2A9D43))
    large = np.flatnonzero(size[of] > SAMPLES)
    cell = of[large].astype(np.int64) * SAMPLES + (g[large] >> np.uint64(64 - SAMPLES.bit_length() + 1)).astype(np.int64)
    order = np.lexsort((g[large], cell))
    cell = cell[order]
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    taken = np.concatenate([np.flatnonzero(size[of] <= SAMPLES), large[order][first]])
    bit = (mix(g[taken]) & np.uint64(ODD_BITS - 1)).astype(np.int64)
    parity = np.bincount(of[taken] * np.int64(ODD_BITS) + bit, minlength=sets * ODD_BITS) & 1
    return np.packbits(parity.astype(np.uint8).reshape(sets, ODD_BITS), axis=1).view(np.int64), np.bincount(of[taken], minlength=sets)


SIGNED = f"doc_id long, n long, s1 long, s2 long, samples int, bands array<long>, {', '.join(f'o{i} long' for i in range(ODD_BITS // 64))}"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            h, of, offsets = shingles(part.column("text"), WIDTH)
            rows = part.num_rows
            odd, samples = _odd(h, of, rows)
            s1, s2 = (_per_set(np.add, mix(h ^ np.uint64(c)), offsets, 0).view(np.int64) for c in (0x1234567, 0x89ABCDEF))
            bands = list_array(_bands(h, offsets).view(np.int64).ravel(), np.arange(rows + 1) * BANDS, pa.int64())
            columns = [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(s1), pa.array(s2), pa.array(samples.astype(np.int32)), bands, *(pa.array(np.ascontiguousarray(odd[:, i])) for i in range(odd.shape[1]))]
            yield pa.record_batch(columns, names=[c.split()[0] for c in SIGNED.split(", ")])


def _likely(a: str, b: str) -> tuple[Column, Column]:
    """The number of samples that differ, as two odd sketches suggest it, in shares of both sizes; and whether the threshold allows the differing bits."""
    differ = sum((F.bit_count(F.col(f"{a}.o{i}").bitwiseXOR(F.col(f"{b}.o{i}"))) for i in range(ODD_BITS // 64)), F.lit(0))
    at, both, taken = THRESHOLD / 100, F.col(f"{a}.n") + F.col(f"{b}.n"), F.col(f"{a}.samples") + F.col(f"{b}.samples")
    union = both / (1 + at)
    whole, large = (F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n")) <= SAMPLES), (F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) > SAMPLES)
    cells = SAMPLES * (1 - F.exp(-union / SAMPLES))
    # what differs at the threshold, and the variance of that number
    apart = F.when(whole, (1 - at) * union).otherwise(F.greatest(F.lit(0.0), taken - 2 * at * cells))
    drawn = F.when(whole, 0.0).otherwise(4 * at * (1 - at) * cells * (1 - cells / union))
    even = F.exp(-2 * apart / ODD_BITS)
    spread = F.sqrt(F.greatest(F.lit(0.0), ODD_BITS / 4 * (1 - even * even) + (drawn - apart) * even * even))
    most = ODD_BITS / 2 * (1 - even) + MARGIN * spread + 1
    sizes = THRESHOLD * F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n")) <= 100 * F.least(F.col(f"{a}.n"), F.col(f"{b}.n"))
    near = F.when(whole, differ <= F.least(most, apart + 1e-6)).when(large, differ <= most).otherwise(True)
    return -differ / taken, sizes & near


def _apart() -> Column:
    """Rows x and y of one key that stand in different components; each pair of outsiders once."""
    return (F.col("x.g") != F.col("y.g")) & ((F.col("y.g") == F.col("y.major")) | (F.col("x.c") < F.col("y.c")))


def _bucket(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(BUCKET) + 1e-9).astype(np.int64)


def _packed(at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Counts of cells, a row for each slice of the order's table."""
    own = np.flatnonzero(np.r_[True, np.diff(at >> SLICE_BITS) > 0]) if len(at) else at
    bounds = pa.array(np.append(own, len(at)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (at, n)]
    return pa.record_batch([pa.array(at[own] >> SLICE_BITS), *lists], names=["slice", "cells", "counts"])


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often shingles (set) fall in each cell of the order's table, in this task."""
    count = np.zeros(1 << CELL_BITS, np.int64)
    for batch in batches:
        h = batch.column("set").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        at, n = np.unique((h >> np.uint64(64 - CELL_BITS)).astype(np.int64), return_counts=True)
        count[at] += n
    at = np.flatnonzero(count)
    yield _packed(at, count[at])


def _cell_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a slice over all tasks."""
    count, base = np.zeros(1 << SLICE_BITS, np.int64), 0
    for batch in batches:
        at = batch.column("cells").flatten().to_numpy(zero_copy_only=False)
        base = int(at[0]) >> SLICE_BITS << SLICE_BITS if len(at) else base
        np.add.at(count, at - base, batch.column("counts").flatten().to_numpy(zero_copy_only=False))
    at = np.flatnonzero(count)
    yield _packed(at + base, count[at])


def _prefixes(often):
    """Of each class (c, g, set) the shingles at which a linked set may first meet it, by pairs of size buckets (own, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = often.value
        for batch in batches:
            lists = batch.column("set")
            h, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            seen = count[(h.view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
            order = np.lexsort((h, seen, of))
            h, of, seen = h[order], of[order], seen[order]
            size = np.diff(offsets)[of]
            at = np.arange(len(h)) - (offsets[:-1] - offsets[0])[of]
            # partners' sizes: the least by the threshold, the most by what is left of this set from here on
            least, most = -(-size * THRESHOLD // 100), np.minimum(size * 100 // THRESHOLD, (size - at) * (100 + THRESHOLD) // THRESHOLD - size)
            keep = np.flatnonzero((seen > 1) & (most >= least))  # what is counted once is in no other set
            h, of, size, at = h[keep], of[keep], size[keep], at[keep]
            first, last = _bucket(least[keep]), _bucket(most[keep])
            other, i = ranges(first, last - first + 1)
            own, rows = _bucket(size)[i], pa.array(of[i])
            columns = [batch.column("c").take(rows), batch.column("g").take(rows), *(pa.array(x.astype(np.int64)) for x in (size[i], at[i], h[i], own, other, np.minimum(own, other), np.maximum(own, other)))]
            yield pa.record_batch(columns, names=["c", "g", "n", "at", "token", "own", "other", "lo", "hi"])

    return run


def _sharing_rare_shingles(scratch: Scratch, sets: DataFrame, chosen: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) of the chosen classes (c, g: component) in different components that may be linked: an exact prefix filter, then the sketches (c, samples, bitmap words).

    Shingles are put in one order for all sets, the rarest first, by counts in a table of 2^CELL_BITS cells (any order is exact). If two sets of n and m
    shingles are linked they share at least (n + m) * 3 / 7, so the first one that they share is so early in both that this many are left. A shingle is
    therefore kept only at such places, for each bucket of partners' sizes separately: copies that differ in as many rare shingles as makes them
    unlinked meet nowhere.
    """
    spark = sets.sparkSession
    own = sets.join(chosen, F.col("id") == F.col("c")).select("c", "g", "set").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = scratch.table(own, "chosen")
    packed = "slice long, cells array<long>, counts array<long>"
    found = own.select("set").mapInArrow(_cell_counts, packed).groupBy("slice").applyInArrow(_cell_sums, packed).toArrow()  # 2^CELL_BITS counts at most
    often = np.zeros(1 << CELL_BITS, np.int64)
    if found.num_rows:
        found = found.combine_chunks()
        often[found["cells"].chunk(0).flatten().to_numpy()] = found["counts"].chunk(0).flatten().to_numpy()
    rows = own.mapInArrow(_prefixes(spark.sparkContext.broadcast(often)), "c long, g long, n long, at long, token long, own long, other long, lo long, hi long")
    rows = scratch.table(rows, "prefixes")
    key = ["token", "lo", "hi"]
    count = rows.groupBy(*key, "g").agg(F.count("*").alias("size"))
    major = count.groupBy(*key).agg(F.max_by("g", F.struct("size", "g")).alias("major"), F.count("*").alias("groups")).filter("groups > 1").drop("groups")
    met = scratch.table(rows.join(scratch.table(major, "prefix-major"), key), "met")
    signed = met.join(sketches, "c")
    outer, inner = signed.filter("g <> major").alias("x"), signed.alias("y")
    both = F.col("x.n") + F.col("y.n")
    left = [(F.col(f"{t}.n") - F.col(f"{t}.at")) * (100 + THRESHOLD) >= both * THRESHOLD for t in "xy"]
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own"))
    return outer.join(inner, same & _apart() & left[0] & left[1] & _likely("x", "y")[1]).select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.table(dealt(rows).mapInArrow(_sign, SIGNED), "signed")
    odd = [f"o{i}" for i in range(ODD_BITS // 64)]
    classes = signed.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("id"))
    classes = scratch.table(classes, "classes")
    # rows that share identifier and set are one class; of its signatures, which are equal, one is taken
    sketch = signed.join(classes.select("id", "s1", "s2", "n"), ["s1", "s2", "n"]).filter("doc_id = id").dropDuplicates(["id", "s1", "s2"])
    # a class goes by a number of its own, unique as it is written once: two classes may have one smallest identifier
    sketch = scratch.table(sketch.select(F.monotonically_increasing_id().alias("c"), "id", "n", "s1", "s2", "samples", *odd, "bands"), "sketch")

    # what rows of a band or a component meet is a table of its own, so that a join can deal the rows of a hot one to several tasks
    every = sketch.select("c", F.posexplode("bands").alias("band", "key"))
    shared = every.groupBy("key").agg(F.count("*").alias("size"), F.min("c").alias("star")).filter("size > 1")
    shared = scratch.table(shared, "shared")
    banded = scratch.table(every.join(shared, "key").select("key", "band", "c", "star"), "banded")
    members = banded.select("c").distinct()
    some = scratch.table(sketch.join(members, "c", "left_semi"), "some")
    chosen = some.select("id", "c", "s1", "s2")
    texts = rows.join(chosen, rows.doc_id == chosen.id).select(F.col("c").alias("id"), "text", "s1", "s2")
    sets = scratch.table(_matching(texts), "sets")
    scratch.settle()

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        a, b = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        linked = pairs.join(a, "a").join(b, "b").filter(100 * both >= THRESHOLD * (F.size("sa") + F.size("sb") - both))
        return scratch.table(linked.select("a", "b"), name)

    def estimated(pairs: DataFrame, best: int) -> DataFrame:
        """Of the candidates (a, b) of each a, the ``best`` likeliest that the sketches allow."""
        x, y = some.select("c", "n", "samples", *odd).alias("x"), some.select("c", "n", "samples", *odd).alias("y")
        value, enough = _likely("x", "y")
        like = pairs.join(x, F.col("a") == F.col("x.c")).join(y, (F.col("b") == F.col("y.c")) & enough).select("a", "b", value.alias("like"))
        w = Window.partitionBy("a").orderBy(F.desc("like"), "b")
        return like.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= best).select("a", "b")

    def grouped(links: DataFrame, name: str) -> DataFrame:
        """Band rows with the component of each class, of bands that more than one component shares; ``major``: the largest there."""
        of = components(scratch, links, name)
        row = banded.join(of, banded.c == of.id, "left").select("key", "band", "c", F.coalesce("component", "c").alias("g"))
        count = row.groupBy("key", "g").agg(F.count("*").alias("size"))
        major = count.groupBy("key").agg(F.max_by("g", F.struct("size", "g")).alias("major"), F.count("*").alias("groups")).filter("groups > 1").select("key", "major")
        return scratch.table(row.join(scratch.table(major, f"{name}-major"), "key"), f"{name}-rows")

    links = confirmed(estimated(banded.filter("c <> star").select(F.col("c").alias("a"), F.col("star").alias("b")).distinct(), 3), "links-0")
    for r in range(ROUNDS):
        row = grouped(links, f"round-{r}")
        picks = [F.min_by("c", F.xxhash64("c", F.lit(r * DELEGATES + i))) for i in range(DELEGATES)]
        heads = row.filter("g = major").groupBy("key").agg(F.array_distinct(F.array(*picks)).alias("heads"))
        heads = scratch.table(heads, f"heads-{r}")
        near = row.filter("g <> major").join(heads, "key").select(F.col("c").alias("a"), F.explode("heads").alias("b")).distinct()
        links = scratch.table(links.unionByName(confirmed(estimated(near, 3), f"more-{r}")), f"links-{r + 1}")
        scratch.settle()
    row = grouped(links, "rest")
    wide = scratch.table(row.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > DIRECT).select("key"), "wide")
    # small bands: all that stand outside the largest component meet the band
    full = row.join(wide, "key", "left_anti").join(some.select("c", "n", "samples", "bands", *odd), "c")
    outer, inner = full.filter("g <> major").alias("x"), full.alias("y")
    # once for each pair: in the first band that it shares
    earlier = F.arrays_overlap(*[F.slice(F.col(f"{t}.bands"), F.lit(1), F.col("x.band")) for t in "xy"])
    pairs = outer.join(inner, (F.col("x.key") == F.col("y.key")) & _apart() & _likely("x", "y")[1] & ~earlier).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))
    links = links.unionByName(confirmed(pairs, "links-rest"))
    scratch.settle()
    # wide bands: their members meet where they share rare shingles
    near = _sharing_rare_shingles(scratch, sets, row.join(wide, "key", "left_semi").select("c", "g").distinct(), some.select("c", "samples", *odd))
    links = links.unionByName(confirmed(near, "links-wide"))
    scratch.settle()
    of = components(scratch, links, "final")

    # components are named by their smallest document
    named = sketch.select("c", "id", "s1", "s2", "n").join(of.withColumnRenamed("id", "of"), F.col("c") == F.col("of"), "left").withColumn("g", F.coalesce("component", "c"))
    least = scratch.table(named.groupBy("g").agg(F.min("id").alias("component_id")), "least")
    named = named.join(least, "g").select("s1", "s2", "n", "component_id")
    out = signed.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    back = lambda c: F.when(c != LAST, c)
    out = out.select(back(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    out = scratch.table(out, "out")
    scratch.clear("out")
    return out


def _matching(texts: DataFrame) -> DataFrame:
    """The set of each class, from a text whose set it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, _, offsets = shingles(part.column("text"), WIDTH)
                sums = [_per_set(np.add, mix(h ^ np.uint64(c)), offsets, 0).view(np.int64) for c in (0x1234567, 0x89ABCDEF)]
                same = (sums[0] == part.column("s1").to_numpy()) & (sums[1] == part.column("s2").to_numpy())
                whole = pa.record_batch([part.column("id"), list_array(h.view(np.int64), offsets, pa.int64())], names=["id", "set"])
                yield whole.filter(pa.array(same))

    return texts.mapInArrow(run, "id long, set array<long>").dropDuplicates(["id"])


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay: one of each component, that of the smallest identifier.

    Rows that share an identifier stay or go together; of those with one text too, one stays.
    """
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(LAST))
    ids = near_duplicates(docs, id_col, text_col).filter("kept").select(whole("doc_id").alias("id")).distinct()
    # the row travels as one column, so names of its own cannot clash with those used here; the join deals rows as the window needs them
    rows = docs.select(F.struct(*docs.columns).alias("row"), whole(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    again = Window.partitionBy("id", "h").orderBy(F.xxhash64("row"))
    first = rows.join(ids, "id", "left_semi").withColumn("nth", F.row_number().over(again)).filter(F.col("nth") == 1)
    return first.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op7_minhash_dedup": op7_minhash_dedup}
SQL = {
    "op7_minhash_dedup": r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a),
c as (select a as doc_id, min(b) as component_id from r group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from c left join n using (doc_id)"""
}
