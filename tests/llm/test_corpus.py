import collections
import hashlib
import math
import random
import re

import pytest
from conftest_llm import make, prose
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_dedup import shingles

import corpus_pipeline
from cladewise.llm import decontamination, graph, mixing, sharding, token_counts
from cladewise.llm.common import Scratch


# --- decontamination --------------------------------------------------------------------------------------------------


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_contained_items_against_brute_force(spark, odd_texts):
    rng = random.Random(1)
    tests = [prose(rng, n) for n in (5, 7, 12, 20, 33, 60)] + [None, "", "two words", odd_texts[5]]
    texts = list(odd_texts)
    for _ in range(60):
        t = rng.choice(tests[:6]).split(" ")
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = "changed"
        texts.append(f"{prose(rng, rng.randrange(200))} {' '.join(t)} {prose(rng, rng.randrange(200))}")
    texts.append("Two   WORDS")
    want = sorted((d, i, len(shingles(t) & shingles(q)), len(shingles(q))) for d, t in enumerate(texts) for i, q in enumerate(tests) if shingles(q) and len(shingles(t) & shingles(q)) >= 0.75 * len(shingles(q)))
    docs = make(spark, texts)
    for block in (decontamination.BLOCK, 20):  # one pass, and several
        got = decontamination.contained_items(docs, items(spark, tests), block=block).collect()
        assert sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got) == want
        clean = decontamination.drop_contaminated(docs, items(spark, tests), block=block)
        assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == sorted({*range(len(texts))} - {w[0] for w in want})


def test_items_of_fewer_than_five_words_inside_long_documents(spark):
    long = prose(random.Random(9), 300)
    tests = ["Yes", "two words", "just three words", "now there are four", "there are two words now", None]
    texts = [f"{long} two WORDS {long}", f"{long} now there  are four", f"yes {long}", "just three words", "two words", f"{long} two x words", f"yesterday {long}", None, "", f"{long} there are two words now {long}"]
    want = [(0, 1), (1, 3), (2, 0), (3, 2), (4, 1), (9, 1), (9, 4)]
    docs = make(spark, texts)
    for block in (decontamination.BLOCK, 2):
        got = decontamination.contained_items(docs, items(spark, tests), block=block).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == want and {(r.n_shared, r.n_item, r.containment) for r in got} == {(1, 1, 1.0)}
        clean = decontamination.drop_contaminated(docs, items(spark, tests), block=block)
        assert sorted(r.doc_id for r in clean.collect()) == [5, 6, 7, 8]


def test_repeated_items_and_null_identifiers(spark):
    text = prose(random.Random(3), 30)
    docs = make(spark, [text, text, "x"], ids=[None, 4, None])
    tests = spark.createDataFrame([(1, text), (1, text), (None, text)], "item_id long, text string")
    for block in (decontamination.BLOCK, 2):
        got = decontamination.contained_items(docs, tests, block=block).collect()
        assert sorted(((r.doc_id, r.item_id) for r in got), key=repr) == sorted([(d, i) for d in (None, 4) for i in (1, 1, None)], key=repr)
        assert [r.doc_id for r in decontamination.drop_contaminated(docs, tests, block=block).collect()] == [None]


def test_no_items_or_documents(spark):
    assert decontamination.contained_items(make(spark, ["a b c d e"]), items(spark, [])).count() == 0
    assert decontamination.contained_items(make(spark, []), items(spark, ["a b c d e"])).count() == 0
    assert decontamination.drop_contaminated(make(spark, ["a b"]), items(spark, [])).count() == 1


@given(st.integers(1, 400))
def test_signatures_lose_nothing(q):
    """A document that has the share of a set lacks fewer shingles than sign it."""
    assert decontamination.signature_size(q, 0.75) > q - math.ceil(0.75 * q)


# --- mixing -------------------------------------------------------------------------------------------------------------


def test_mixing_reaches_the_weights(spark):
    rng = random.Random(2)
    sources = ["hot"] * 3000 + ["b"] * 600 + [None] * 400
    texts = [prose(rng, rng.randrange(5, 15)) for _ in sources]
    docs = make(spark, texts, sources=sources)
    out = mixing.mix_sources(docs, {"hot": 1, "b": 2, None: 1})
    assert out.columns == [*(c for c in docs.columns if c not in ("copy", "n_copies", "place")), "copy", "n_copies", "place"]
    rows = out.collect()
    size = collections.Counter()
    for r in rows:
        size[r.source] += len(r.text) + 1
    total = sum(size.values())
    for s, w in (("hot", 0.25), ("b", 0.5), (None, 0.25)):
        assert abs(size[s] / total - w) < 0.05
    assert abs(total - sum(len(t) + 1 for t in texts)) < 0.1 * total
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.copy, r.n_copies))
    assert all(sorted(v) == [(i + 1, len(v)) for i in range(len(v))] for v in by.values())
    assert sorted(map(tuple, mixing.mix_sources(docs, {"hot": 1, "b": 2, None: 1}).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_poisson_table(spark):
    rates = spark.createDataFrame([("a", 0.0), ("b", 0.3), ("c", 7.5), ("d", 900.0)], "mix_source string, rate double")
    for r in mixing.poisson_table(rates).collect():
        mean = r.rate / r.parts
        assert mean <= mixing.PART and abs(r.cdf[-1] - 1) < 1e-9
        want = [math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) if mean else float(k == 0) for k in range(5)]
        assert all(abs(r.cdf[k] - sum(want[: k + 1])) < 1e-9 for k in range(5))


def test_large_means_and_left_out_sources(spark):
    docs = make(spark, ["x"] * 40 + ["y" * 4000] * 10, sources=["tiny"] * 40 + ["huge"] * 10)
    rows = mixing.mix_sources(docs, {"tiny": 1.0}).collect()
    assert {r.source for r in rows} == {"tiny"} and abs(len(rows) * 2 - 40090) < 2500
    assert mixing.mix_sources(make(spark, [])).count() == 0


def test_mixing_beyond_what_its_sql_holds(spark):
    """Null sources and documents of more than 200 and 256 mean copies, against draws written out."""
    texts, sources = ["x" * 99] * 40 + ["y" * 3, "z" * 4, "z" * 5], ["big"] * 40 + [None, "tiny", "tiny"]
    weights = {"big": 0.1, None: 0.3, "tiny": 0.6}
    got = collections.Counter(r.doc_id for r in mixing.mix_sources(make(spark, texts, sources=sources), weights).collect())
    total = sum(len(t) + 1 for t in texts)
    for doc, source in enumerate(sources):
        rate = weights[source] * total / sum(len(t) + 1 for t, s in zip(texts, sources, strict=True) if s == source)
        parts, n = max(1, math.ceil(rate / mixing.PART)), 0
        for part in range(1, parts + 1):
            u = int(hashlib.md5(f"{mixing.SEED}:{doc}:{part}".encode()).hexdigest()[:13], 16) / 2**52
            mean, cdf, k = rate / parts, 0.0, 0
            while (cdf := cdf + math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))) <= u:
                k += 1
            n += k
        assert got[doc] == n
    assert min(got[40], got[41], got[42]) > 200


def test_mixing_odd_rows(spark, odd_texts):
    rows = mixing.mix_sources(make(spark, odd_texts * 3, ids=[None, 1, 1] * (len(odd_texts)), sources=[None, "a", "b"] * len(odd_texts))).collect()
    assert all(1 <= r.copy <= r.n_copies for r in rows)


# --- sharding -----------------------------------------------------------------------------------------------------------


def check_law(rows, n, shards):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(by[s]) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("n", [0, 1, 7, 16, 500])
def test_shards_of_texts_of_their_own(spark, n):
    check_law(sharding.shard_documents(make(spark, [f"t{i}" for i in range(n)])).collect(), n, 16)


def test_groups_stay_together(spark, odd_texts):
    rng = random.Random(3)
    texts = [f"g{i}" for i in range(150) for _ in range(rng.randrange(2, 6))] + [f"single {i}" for i in range(900)] + odd_texts + ["hot"] * 700
    rng.shuffle(texts)
    ids = [None if i % 50 == 0 else i // 2 for i in range(len(texts))]
    rows = sharding.shard_documents(make(spark, texts, ids)).collect()
    check_law(rows, len(texts), 16)
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 1 for t in texts)
    where = collections.defaultdict(collections.Counter)
    for r in rows:
        where[r.size, r.text_crc32][r.shard] += 1
    small = [c for c in where.values() if 1 < sum(c.values()) < 50]
    assert sum(len(c) > 1 for c in small) <= 0.03 * len(small)
    hot = max(where.values(), key=lambda c: sum(c.values()))
    assert max(hot.values()) >= 2 * sum(hot.values()) / 16  # a group beyond a shard's size crowds where there is room


def test_links_that_are_not_groups(spark):
    """Hubs that overlap: neighbours are drawn to one shard, capacities hold."""
    n = 240
    rows = spark.createDataFrame([(i, i % 8) for i in range(n)], "rid long, start int")
    links = spark.createDataFrame([(i, i // 6 * 10 + h) for i in range(n) for h in range(2)] + [(i, 5000 + i // 6) for i in range(n)], "rid long, hub long")
    got = {r.rid: r.label for r in sharding.propagate(Scratch(spark), rows, links, 8, n, steps=8).collect()}
    cut = sum(len({got[i] for i in range(b, b + 6)}) > 1 for b in range(0, n, 6))
    size = collections.Counter(got.values())
    assert cut <= 20 and max(size.values()) <= 1.5 * n / 8  # at the start every block is cut


def test_the_last_few_that_ask_move_too(spark):
    """One member of one group stands elsewhere, among so many rows that it is less than a thousandth of them."""
    n = 2400
    rows = spark.createDataFrame([(i, (i // 3 + (i == 0)) % 8) for i in range(n)], "rid long, start int")
    links = spark.createDataFrame([(i, i // 3) for i in range(n)], "rid long, hub long")
    got = {r.rid: r.label for r in sharding.propagate(Scratch(spark), rows, links, 8, n).collect()}
    assert got == {i: i // 3 % 8 for i in range(n)}


def test_large_hubs_in_parts(spark, monkeypatch):
    """Hubs beyond HEAVY rows are dealt into parts wherever they are ranked or counted; law and groups are as before."""
    monkeypatch.setattr(sharding, "HEAVY", 3)
    monkeypatch.setattr(sharding, "WHOLE", 0.5)
    texts = [f"g{i}" for i in range(40) for _ in range(10)] + [f"single {i}" for i in range(800)]
    random.Random(4).shuffle(texts)
    rows = sharding.shard_documents(make(spark, texts)).collect()
    check_law(rows, len(texts), 16)
    where = collections.defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 2


@pytest.mark.parametrize("heavy", [2000, 2])
def test_a_propagation_step_against_brute_force(spark, monkeypatch, heavy):
    """Where every member of a hub asks to go to: the shard that its hubs' members pull to most, by shares and then by a hash."""
    monkeypatch.setattr(sharding, "HEAVY", heavy)
    rng, n = random.Random(8), 90
    links = [(i, h) for i in range(n) for h in {rng.randrange(12), 20 + rng.randrange(9)}]
    start = {i: rng.randrange(4) for i in range(n)}
    # room for all, so every move that is asked for is made
    monkeypatch.setattr(sharding, "SLACK", 100.0)
    monkeypatch.setattr(sharding, "WHOLE_LEAST", 10**6)
    got = sharding.propagate(Scratch(spark), spark.createDataFrame(list(start.items()), "rid long, start int"), spark.createDataFrame(links, "rid long, hub long"), 4, n, steps=1)
    members = collections.defaultdict(list)
    for i, h in links:
        members[h].append(i)
    for r in got.collect():
        pull = collections.Counter()
        for h in {h for i, h in links if i == r.rid and len(members[h]) > 1}:
            for m in members[h]:
                pull[start[m]] += 1 / len(members[h])
        assert pull[r.label] >= max(pull.values()) - 1e-9


# --- components -----------------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    want = {x: top(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    table = spark.createDataFrame(edges, "a long, b long")
    assert {r.id: r.component for r in graph.components(Scratch(spark), table, "t").collect()} == want
    old = graph.PART
    graph.PART = 20  # many parts, joined by star steps
    try:
        assert {r.id: r.component for r in graph.components(Scratch(spark), table, "t").collect()} == want
    finally:
        graph.PART = old


# --- token counts -----------------------------------------------------------------------------------------------------------

PIECES = st.sampled_from(["a", "é", " ", "  ", "\n", " \n ", "'s", "'", "12", "#", "abc", "The ", " x", "\t", "日本", "ſ"])
TEXT = st.lists(PIECES, max_size=60).map("".join)


@pytest.mark.parametrize("leaf", [1, 2, 3, 5, 16])
@settings(max_examples=120, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXT, st.lists(st.tuples(st.integers(0, 130), st.integers(0, 12), st.lists(PIECES, max_size=5).map("".join)), max_size=20))
def test_edited_counts_are_those_of_the_edited_text(leaf, text, edits):
    """Few pre-tokens a leaf, so edits cross leaves and trees are laid out anew."""
    c, old = token_counts.counter(), token_counts.LEAF
    token_counts.LEAF = leaf
    try:
        _edit_all(token_counts.Counted(text, c), edits, c)
    finally:
        token_counts.LEAF = old


def _edit_all(own, edits, c):
    for e in edits:
        own.edit(*e)
        assert own.tree.tokens == len(c.encoding.encode_ordinary(own.text)) and own.tree.chars[1] == len(own.text)


def test_edits_touch_little():
    rng = random.Random(5)
    own = token_counts.Counted(prose(rng, 20_000), token_counts.counter())
    own.edit(50_000, 3, "new words ")
    assert own.encoded < 4 * token_counts.LEAF
    assert own.tree.tokens == len(own.counter.encoding.encode_ordinary(own.text))


def test_edits_of_one_long_text_cost_as_much_each():
    """Many edits of a text of 260,000 characters: what each re-encodes does not follow the text's length."""
    rng = random.Random(6)
    own = token_counts.Counted(prose(rng, 60_000), token_counts.counter())
    for _ in range(5000):
        own.edit(rng.randrange(250_000), rng.randrange(4), rng.choice(["ab ", "", "zz"]))
    assert own.encoded < 5000 * 8 * token_counts.LEAF
    assert own.tree.tokens == len(own.counter.encoding.encode_ordinary(own.text))


def test_words_with_something_private():
    rng = random.Random(7)
    parts = ["a", "f", "0", "1", ".", "@", "x.y", " ", "\u3000", "abcdefabcdefabcdef", "12345", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        want = [m.span() for m in token_counts._private().finditer(text)]
        assert [m.span() for at, to in token_counts._suspects(text) for m in token_counts._private().finditer(text, at, to)] == want


def test_stored_trees_and_edits(spark, odd_texts):
    docs = make(spark, odd_texts)
    c = token_counts.counter()
    trees = token_counts.token_trees(docs)
    assert {r.doc_id: r.n_tokens for r in trees.collect()} == {i: len(c.encoding.encode_ordinary(t or "")) for i, t in enumerate(odd_texts)}
    edits = spark.createDataFrame([(5, 2, 0, 3, "start "), (5, 1, 9, 0, "inserted"), (9, 1, 10**9, 5, " tail"), (0, 1, None, None, "now text"), (3, 1, 0, 1, None), (10, 1, 5, 0, "one"), (10, 1, 5, 0, "two"), (12345, 1, 0, 1, "none")], "doc_id long, seq int, start int, length int, replacement string")
    got = {r.doc_id: r for r in token_counts.apply_edits(docs.select("doc_id", "text").join(trees, "doc_id"), edits).collect()}
    for i, t in enumerate(odd_texts):
        assert got[i].n_tokens == len(c.encoding.encode_ordinary(got[i].text)) == sum(got[i].leaf_tokens)
    assert got[0].text == "now text" and got[3].text == "" and got[5].text == "start " + (odd_texts[5][:9] + "inserted" + odd_texts[5][9:])[3:] and got[9].text == odd_texts[9] + " tail"
    assert got[15].n_reencoded == 0
    # of edits with one number the order is that of their other columns
    assert got[10].text == odd_texts[10][:5] + "twoone" + odd_texts[10][5:]


def test_redacted_counts(spark, odd_texts):
    texts = [*odd_texts, "mail me@x.org from 10.0.0.1 key abcdef0123456789abcdef and 123456 ok"]
    c = token_counts.counter()
    got = {r.doc_id: r for r in token_counts.edited_counts(make(spark, texts)).collect()}
    for i, t in enumerate(texts):
        after = re.sub(token_counts.PRIVATE, "<redacted>", t or "")
        after += "\n" if after and not after.endswith("\n") else ""
        assert (got[i].n_tokens, got[i].n_tokens_after) == (len(c.encoding.encode_ordinary(t or "")), len(c.encoding.encode_ordinary(after)))
    assert token_counts.edited_counts(make(spark, [])).count() == 0


# --- pipeline ---------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(6)
    leak = prose(rng, 40)
    good = [prose(rng, rng.randrange(30, 90)) for _ in range(120)]
    bad = [" ".join(w + "$$$" for w in prose(rng, 40).split(" ")) for _ in range(40)]
    texts = good + bad + [good[0], good[1] + " end", f"{good[2]} {leak} {good[3]}", None, ""]
    labels = [(i, 1, 0) for i in range(100)] + [(i, 0, 0) for i in range(120, 150)]
    make(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items(spark, [leak]).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        columns, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        assert name == "shard" or docs.columns == columns
    assert set(range(120)) <= set(ids["quality"]) and not set(ids["quality"]) & set(range(120, 160))
    assert sorted(ids["near_dedup"]) == sorted(set(ids["quality"]) - {160, 161})
    assert sorted(ids["decontaminate"]) == sorted(set(ids["near_dedup"]) - {162})
    assert set(ids["mix"]) <= set(ids["decontaminate"]) and sorted(ids["mix"]) == sorted(ids["shard"])
    check_law(docs.collect(), len(ids["mix"]), 16)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(ids["mix"])


def test_pipeline_of_nothing(spark, tmp_path):
    make(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items(spark, []).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_with_null_and_shared_identifiers(spark, tmp_path):
    """Rows without an identifier, with a shared one and repeated in full pass each stage by their texts."""
    rng = random.Random(16)
    texts = [prose(rng, 40) for _ in range(30)]
    rows, ids = texts + [texts[0], texts[0], None, ""], [*range(28), None, None, 0, 0, 7, None]
    make(spark, rows, ids=ids).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items(spark, [None, "", prose(rng, 9)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == len(rows)
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text and r.doc_id is not None) == sorted((i, texts[i]) for i in range(28))
    assert corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).count() == len(rows)
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_scratch_uses_the_shared_folder(spark):
    s = Scratch(spark)
    s.table(spark.range(5).select(F.col("id")), "t")
    assert s.base.startswith(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
    assert spark.read.parquet(f"{s.base}/t").count() == 5
    s.clear()
    assert not s.names
