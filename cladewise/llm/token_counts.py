"""Edit-aware token counts.

A document's pre-tokens are put in leaves of ``LEAF``; a segment tree over the leaves keeps sums of characters and of tokens. An edit finds its
leaf by descending the character sums, and re-encodes from the start of the leaf that holds the context to the left of the edit. The
pre-token pattern looks at nothing before a pre-token and at less than ``AHEAD`` characters behind it, so everything that ends two characters
before the edit stands; and as soon as a new pre-token ends behind the edit where a leaf of the old text began, all that follows stands too.
The re-encoded pre-tokens take the places of the old leaves, and the sums above them are updated. Leaves hold their own text, so an edit
touches a few leaves and the sums above them, whatever the length of the text; leaves that have grown beyond ``FULL`` pre-tokens are split by
laying out the tree anew, which so many insertions pay for.

The token count of a pre-token is that of its byte-pair encoding; counts of pre-tokens seen are kept in a bounded cache. Trees can be
stored (``token_trees``) and edits applied to them later (``apply_edits``), or both be done in one pass (``edited_counts``). Documents
are read once and never shuffled by the one-pass form.

Defined cases: null and empty texts have no tokens and an empty tree; edits beyond the end of a text are cut to it; edits of null start
count from 0, of null length delete nothing, of null replacement insert nothing; documents without edits keep their tree; repeated
rows are counted each (edits apply to every row of their identifier); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from operator import add

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parallel import dealt
from .common import documents, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
LEAF = 16
FULL, AHEAD = 4, 4  # leaves, characters
CACHE = 300_000
Edit = tuple[int, int, str]  # start, length, replacement


class Counter:
    """Token counts of pre-tokens under a vocabulary."""

    def __init__(self, vocabulary: str, pattern: str):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return list(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > CACHE:
            known.clear()
        single = self.encoding._encode_single_piece
        for p in pieces:
            if p not in known:
                known[p] = len(single(p))
        return [known[p] for p in pieces]


@functools.lru_cache(2)
def counter(vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Counter:
    return Counter(vocabulary, pattern)


class Tree:
    """Sums of characters and of tokens over leaves, as a heap: node i has the children 2i and 2i + 1."""

    def __init__(self, chars: Iterable[int], tokens: Iterable[int]):
        chars, tokens = list(chars), list(tokens)
        self.leaves = len(chars)
        self.base = 1 << max(0, self.leaves - 1).bit_length()
        self.chars, self.tokens_ = self._sums(chars), self._sums(tokens)

    def _sums(self, own: list[int]) -> list[int]:
        levels = [own + [0] * (self.base - len(own))]
        while len(levels[-1]) > 1:
            low = levels[-1]
            levels.append([*map(add, low[::2], low[1::2])])
        return [0, *itertools.chain.from_iterable(reversed(levels))]

    @property
    def tokens(self) -> int:
        return self.tokens_[1]

    def leaf_of(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place`` (the last one beyond the end), and the leaf's start."""
        chars, base = self.chars, self.base
        at, start = 1, 0
        place = min(place, chars[1] - 1)
        while at < base:
            at *= 2
            if place >= start + chars[at]:
                start += chars[at]
                at += 1
        return at - base, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        at = self.base + leaf
        c, t = chars - self.chars[at], tokens - self.tokens_[at]
        if c or t:
            while at:
                self.chars[at] += c
                self.tokens_[at] += t
                at //= 2

    def lists(self) -> tuple[list[int], list[int]]:
        own = slice(self.base, self.base + self.leaves)
        both = [(c, t) for c, t in zip(self.chars[own], self.tokens_[own], strict=True) if c]
        return [c for c, _ in both], [t for _, t in both]


class Counted:
    """A text with its tree: the texts of the leaves, in order."""

    def __init__(self, text: str, counter_: Counter, leaves: tuple[list[int], list[int]] | None = None):
        self.counter = counter_
        self.pieces = self.encoded = 0
        if leaves is None:
            pieces = counter_.pattern.findall(text)
            self.pieces = len(pieces)
            leaves = self._leaves(pieces, LEAF)
        ends = [0, *itertools.accumulate(leaves[0])]
        self.parts = [text[i:j] for i, j in itertools.pairwise(ends)]
        self.tree = Tree(*leaves)

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def _leaves(self, pieces: list[str], size: int) -> tuple[list[int], list[int]]:
        """Characters and tokens of leaves of so many pieces."""
        if len(pieces) <= size:
            return ([sum(map(len, pieces))], [sum(self.counter.counts(pieces))]) if pieces else ([], [])
        chars, tokens = [*map(len, pieces)], self.counter.counts(pieces)
        at = range(0, len(pieces), size)
        return [sum(chars[i : i + size]) for i in at], [sum(tokens[i : i + size]) for i in at]

    def _laid_out(self, first: int, last: int, pieces: list[str]) -> None:
        """The tree anew, with pieces in the place of the leaves from first to last; all leaves of at most ``LEAF``."""
        own = slice(self.tree.base, self.tree.base + self.tree.leaves)
        chars, tokens = self._leaves(pieces, LEAF)
        old_chars, old_tokens = self.tree.chars[own], self.tree.tokens_[own]
        ends = [0, *itertools.accumulate(chars)]
        text = "".join(pieces)
        parts = self.parts[:first] + [text[i:j] for i, j in itertools.pairwise(ends)] + self.parts[last + 1 :]
        chars, tokens = old_chars[:first] + chars + old_chars[last + 1 :], old_tokens[:first] + tokens + old_tokens[last + 1 :]
        keep = [i for i, c in enumerate(chars) if c]
        self.parts = [parts[i] for i in keep]
        self.tree = Tree([chars[i] for i in keep], [tokens[i] for i in keep])

    def edit(self, start: int, length: int, new: str) -> None:
        tree, parts = self.tree, self.parts
        total = tree.chars[1] if parts else 0
        start = max(0, min(start, total))
        end = min(total, start + max(0, length))
        if not total or not new and end - start == total:
            pieces = self.counter.pattern.findall(new)
            self.encoded += len(pieces)
            self._laid_out(0, len(parts) - 1, pieces)
            return
        first, left = tree.leaf_of(max(0, start - 2))
        stop, right, more = first, left + len(parts[first]), 1
        while True:
            # leaves up to the edit's end, and some behind it
            starts = []  # of leaves behind the edit: place in the edited text, leaf
            while stop + 1 < len(parts) and (right < end or more):
                more -= right >= end and bool(parts[stop + 1])
                stop += 1
                right += len(parts[stop])
            region = "".join(parts[first : stop + 1])
            text = region[: start - left] + new + region[end - left :]
            delta, at = len(text) - len(region), left
            for i in range(first, stop + 1):
                if i > first and at >= end and parts[i]:
                    starts.append((at - left + delta, i))
                at += len(parts[i])
            whole = stop + 1 == len(parts) or right == total
            pieces, at, last, limit = [], 0, None, len(text) if whole else len(text) - AHEAD
            waiting = iter(starts)
            place, leaf = next(waiting, (len(text) + 1, stop + 1))
            for m in self.counter.pattern.finditer(text):
                pieces.append(m.group())
                at = m.end()
                while place < at:
                    place, leaf = next(waiting, (len(text) + 1, stop + 1))
                if place == at <= limit:
                    last = leaf - 1
                    break
            self.encoded += len(pieces)
            if last is None and whole:
                last = stop
            if last is not None:
                break
            more = stop - first + 1
        room = last - first + 1
        size = max(LEAF, -(-len(pieces) // room))
        if size > FULL * LEAF:
            self._laid_out(first, last, pieces)
            return
        chars, tokens = self._leaves(pieces, size)
        done = 0
        for i in range(room):
            c, t = (chars[i], tokens[i]) if i < len(chars) else (0, 0)
            parts[first + i] = text[done : done + c]
            done += c
            tree.put(first + i, c, t)


def token_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, leaf_chars, leaf_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                each = [Counted(t or "", counter(vocabulary, pattern)) for t in part.column("text").to_pylist()]
                chars, tokens = zip(*(c.tree.lists() for c in each), strict=True)
                columns = [part.column("doc_id"), pa.array([c.pieces for c in each], pa.int64()), pa.array([c.tree.tokens for c in each], pa.int64()), pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))]
                yield pa.record_batch(columns, names=["doc_id", "n_pretokens", "n_tokens", "leaf_chars", "leaf_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return dealt(rows).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>")


def apply_edits(docs: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Documents (doc_id, text, leaf_chars, leaf_tokens) after edits (doc_id, seq, start, length, replacement), in order of seq.

    Each edit counts from the text that the one before it left. Adds n_tokens and n_reencoded (pre-tokens).
    """
    grouped = edits.filter("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("replacement", F.lit("")).alias("replacement")))).alias("edits"))
    schema = "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long, n_reencoded long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for r in part.to_pylist():
                    own = Counted(r["text"] or "", counter(vocabulary, pattern), (r["leaf_chars"] or [], r["leaf_tokens"] or []))
                    for e in r["edits"] or []:
                        own.edit(e["start"], e["length"], e["replacement"])
                    out.append((r["doc_id"], own.text, *own.tree.lists(), own.tree.tokens, own.encoded))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64()), strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    joined = docs.select("doc_id", "text", "leaf_chars", "leaf_tokens").join(grouped, "doc_id", "left")
    return joined.mapInArrow(run, schema)


#: What the query's edits replace: addresses, keys and long numbers.
PRIVATE = r"[0-9A-Fa-f]{16,}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[^\s@]+@[^\s@]+\.[^\s@]+|[0-9]{4,}"


def redactions(text: str) -> list[Edit]:
    """Private strings become ``<redacted>``, from the last to the first, and a text ends in a line break."""
    out = [(m.start(), m.end() - m.start(), "<redacted>") for at, to in _suspects(text) for m in _private().finditer(text, at, to)][::-1]
    return out + [(len(text) + sum(len(n) - k for _, k, n in out), 0, "\n")] if text and not text.endswith("\n") else out


@functools.lru_cache(1)
def _private():
    return regex.compile(PRIVATE)


#: What has none of these has nothing private: matches lie within a word, and are long hexadecimals or have a digit or @.
_SUSPECT, _BLANK = re.compile(r"[0-9@]|[A-Fa-f]{16}"), regex.compile(r"\s")
_BLANK_BEFORE = regex.compile(r"(?r)\s")


def _suspects(text: str) -> Iterator[tuple[int, int]]:
    """Words that may have something private."""
    to = 0
    while m := _SUSPECT.search(text, to):
        before, behind = _BLANK_BEFORE.search(text, to, m.start()), _BLANK.search(text, m.end())
        at, to = before.end() if before else to, behind.start() if behind else len(text)
        yield at, to


COUNTS = "doc_id long, n_pretokens long, n_tokens long, n_edits long, n_tokens_after long, n_reencoded long"


def edited_counts(docs: DataFrame, edits_of: Callable[[str], list[Edit]] = redactions, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Counts of every row before and after the edits that ``edits_of`` finds in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for text in part.column("text").to_pylist():
                    own = Counted(text or "", counter(vocabulary, pattern))
                    before, edits = own.tree.tokens, edits_of(text or "")
                    for e in edits:
                        own.edit(*e)
                    out.append((own.pieces, before, len(edits), own.tree.tokens, own.encoded))
                yield pa.record_batch([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], names=[c.split()[0] for c in COUNTS.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return dealt(rows).mapInArrow(run, COUNTS)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(documents(spark, sf_dir))


QUERIES = {"op10_token_counts": op10_token_counts}
SQL: dict[str, str] = {}
