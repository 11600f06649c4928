"""Language identification by prediction by partial matching.

For every language a variable-order byte context tree (orders 0 to ``ORDER``) is learned from a sample of labelled texts and frozen. The code
length of a text is the sum over its bytes (lower-cased text) of -log2 of the symbol's probability in the longest context that the tree
has, n / (N + D), plus an escape, D / (N + D), for each longer context that has not seen the symbol (N symbols, D distinct ones in
the context; method C without exclusion), down to 8 bits for a byte never seen. The language of the least code length is
predicted; the score is its share of 2^-length over all languages.

The trees are flattened into tables from context and symbol to the code lengths under ``BLOCK`` languages at a time, so a text is scored by table
look-ups over whole slices. They are learned from at most ``PER_LANGUAGE`` documents a language, those of the least hashes (whole texts, as long as those before
have not filled the language's share of ``SAMPLE_BYTES``); their counts are summed by Spark. If the tables would take more than ``MODEL_BYTES``, which is what
is broadcast at most, symbols seen least often in the longest contexts are left out of the trees. So neither driver nor broadcast grows with
the rows or with the number of languages.

Defined cases: null text and text without a letter are ``und`` with score 0, as is everything if no labelled text is there; ties go to the
first language in order; null languages are not learned; rows that share an identifier are learned together if they are chosen, and repeated rows
are scored each; very long texts are scored whole, a slice of its own each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parallel import dealt
from .common import documents, slices

ORDER = 3
PER_LANGUAGE = 400
SAMPLE_BYTES = 32 << 20
MODEL_BYTES = 256 << 20
BLOCK = 8
SCORED = "doc_id long, held_out boolean, lang_pred string, score double"


def _grams(text: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, context and symbol of every byte as one number; and the offsets of the texts. Zeros precede each text."""
    lower = pc.utf8_lower(pc.fill_null(text.cast(pa.large_string()), pa.scalar("", pa.large_string())))
    joined = pc.binary_join_element_wise(pa.scalar("\0" * ORDER, pa.large_string()), lower, pa.scalar("", pa.large_string()))
    ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint32)
    ends = ends - ends[0]
    own = np.ones(len(data), bool)
    for i in range(ORDER):
        own[ends[:-1] + i] = False
    at = np.flatnonzero(own)
    gram = [data[at]]
    for o in range(1, ORDER + 1):
        gram.append(gram[-1] | data[at - o] << np.uint32(8 * o))
    return gram, ends - ORDER * np.arange(len(ends))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            langs = part.column("lang").to_pylist()
            grams, offsets = _grams(part.column("text"))
            for i, lang in enumerate(langs):
                for o, g in enumerate(grams):
                    key, n = np.unique(g[offsets[i] : offsets[i + 1]], return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(key), pa.string()), pa.array([o] * len(key), pa.int32()), pa.array(key.astype(np.int64)), pa.array(n)], names=["lang", "order", "gram", "n"])


class Lookup:
    """From a 32-bit key to its index, -1 if it has none: open addressing over a table of four slots a key."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint32(32 - min(bits, 31)), (1 << min(bits, 31)) - 1
        self.key = np.zeros(self.mask + 1, np.uint32)
        self.index = np.full(self.mask + 1, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.index[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.index[at], self.key[at] = left[won], keys[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], slot[rest] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.index[slot]
        open_ = np.flatnonzero((out >= 0) & (self.key[slot] != keys))
        while len(open_):
            slot[open_] = slot[open_] + 1 & self.mask
            s = slot[open_]
            out[open_] = self.index[s]
            open_ = open_[(self.index[s] >= 0) & (self.key[s] != keys[open_])]
        return out


class Trees:
    """The frozen trees of all languages: by order, code lengths of the symbols seen and of the escapes."""

    def __init__(self, langs: list[str], counts: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]]):
        self.langs, self.seen, self.cost, self.context, self.escape = langs, [], [], [], []
        for o in range(ORDER + 1):
            keys = np.unique(np.concatenate([counts[o, x][0] for x in langs])).astype(np.uint32)
            contexts = np.unique(self._context(keys))
            cost, escape = np.zeros((len(langs), len(keys))), np.zeros((len(langs), len(contexts)))
            below = self._lengths_below(keys, o)
            for i, lang in enumerate(langs):
                key, n = counts[o, lang]
                at = np.searchsorted(contexts, self._context(key.astype(np.uint32)))
                total, distinct = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
                has = distinct > 0
                escape[i, has] = np.log2((total + distinct)[has] / distinct[has])
                own = np.searchsorted(contexts, self._context(keys))
                cost[i] = below[i] + escape[i, own]
                cost[i, np.searchsorted(keys, key)] = np.log2((total + distinct)[at] / n)
            self.seen.append(Lookup(keys))
            self.cost.append(cost.astype(np.float32))
            self.context.append(Lookup(contexts))
            self.escape.append(escape.astype(np.float32))

    @staticmethod
    def _context(keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint32(8)

    def _lengths_below(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Code lengths (languages, keys) from the next lower order on."""
        if not order:
            return np.full((len(self.langs), len(keys)), 8.0)
        # a key's last symbols, as numbered by the lower order: the symbol is the lowest byte, nearer context the lower ones
        return self.lengths(keys & np.uint32((1 << 8 * order) - 1), order - 1)

    def lengths(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        at = self.seen[order].find(keys)
        out = self.cost[order][:, np.maximum(at, 0)]
        new = np.flatnonzero(at < 0)
        if len(new):
            ctx = self.context[order].find(self._context(keys[new]))
            out[:, new] = self._lengths_below(keys[new], order) + np.where(ctx < 0, 0, self.escape[order][:, np.maximum(ctx, 0)])
        return out


class Forest:
    """The trees of all languages, block by block."""

    def __init__(self, counts: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]], block: int = BLOCK):
        self.langs = sorted({x for _, x in counts})
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.blocks = []
        for i in range(0, len(self.langs), block):
            own = self.langs[i : i + block]
            self.blocks.append(Trees(own, {(o, x): counts.get((o, x), none) for o in range(ORDER + 1) for x in own}))

    def bits(self, gram: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(languages, texts): code lengths of the texts whose grams start there."""
        return np.concatenate([np.add.reduceat(trees.lengths(gram), starts, axis=1, dtype=np.float64) for trees in self.blocks])


def _bytes(counts: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]], block: int) -> int:
    """What the tables of the trees take at most: a cost and 24 bytes of look-up a symbol, the same a context."""
    langs = sorted({x for _, x in counts})
    total = 0
    for i in range(0, len(langs), block):
        own = langs[i : i + block]
        for o in range(ORDER + 1):
            keys = np.unique(np.concatenate([counts[o, x][0] for x in own if (o, x) in counts] or [np.zeros(0, np.int64)]))
            total += (4 * len(own) + 32) * (len(keys) + len(np.unique(keys >> 8)))
    return total


def pruned(counts: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]], limit: int, block: int = BLOCK) -> dict[tuple[int, str], tuple[np.ndarray, np.ndarray]]:
    """Counts whose tables take at most ``limit`` bytes: of the highest order first, what was seen least often goes."""
    counts, order, least = dict(counts), ORDER, 1
    while order and _bytes(counts, block) > limit:
        for (o, x), (key, n) in list(counts.items()):
            if o == order:
                counts[o, x] = key[n > least], n[n > least]
        if not any(len(key) for (o, _), (key, _) in counts.items() if o == order):
            order, least = order - 1, 0
        least = 2 * least or 1
    return counts


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in batches:
            for part in slices(batch):
                text = part.column("text")
                grams, offsets = _grams(text)
                bits = np.zeros((len(trees.langs), part.num_rows))
                full = np.flatnonzero(np.diff(offsets))
                if len(full):
                    bits[:, full] = trees.bits(grams[ORDER], offsets[:-1][full])
                best = bits.argmin(axis=0)
                score = 1 / np.exp2(np.minimum(0, bits.min(axis=0) - bits)).sum(axis=0)
                told = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False)
                lang = pc.if_else(told, pa.array(trees.langs, pa.string()).take(pa.array(best)), "und")
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), lang, pc.if_else(told, pa.array(score), 0.0)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE, sample_bytes: int = SAMPLE_BYTES, model_bytes: int = MODEL_BYTES) -> Forest | None:
    """Trees from (doc_id, text, lang): counts by language, order and gram, summed by Spark."""
    known = labelled.filter("lang is not null and text is not null")
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id")
    chosen = known.select("lang", "doc_id").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= per_language)
    sample = known.join(F.broadcast(chosen.select("lang", "doc_id").distinct()), ["lang", "doc_id"]).select("lang", "doc_id", "text")
    share = sample_bytes // max(8, known.agg(F.approx_count_distinct("lang")).first()[0])
    before = F.sum(F.octet_length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1))  # over the rows chosen
    sample = sample.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < share).select("lang", "text")
    counts = sample.repartition(sample.sparkSession.sparkContext.defaultParallelism).mapInArrow(_count, "lang string, order int, gram long, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return None
    by = {k: (g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.int64)) for k, g in counts.groupby(["order", "lang"])}
    return Forest(pruned(by, model_bytes))


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Learns from the rows that are not held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out.alias("held_out"))
    trees = learn(rows.filter("not held_out").select("doc_id", "text", "lang"), per_language)
    scored = rows.select("doc_id", "text", "held_out")
    if trees is None:
        return scored.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return dealt(scored).mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(trees)), SCORED)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the identifier as text, modulo the folds; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir), fold("doc_id", 5) == 0)


QUERIES = {"op1_language_id": op1_language_id}
SQL: dict[str, str] = {}
