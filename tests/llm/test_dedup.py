import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from conftest_llm import make, prose

from cladewise.llm import exact_dedup, minhash_dedup, substring_dedup
from cladewise.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, i, doc))
    out = []
    for norm, g in groups.items():
        first = min(g)
        out += [(d, first[4], len(g), hashlib.sha256(norm.encode()).hexdigest()) for *_, d in g]
    return sorted(out, key=repr), len(groups)


def brute_substring(rows, width=20):
    words = [(doc, WORD.findall(text or "")) for doc, text in rows]
    first = {}
    for doc, w in words:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, (1 << 63, 0)), (doc, i))
    out = []
    for doc, w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] != (doc, i):
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), kept))
    return sorted(out, key=repr)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows):
    sets = [(doc, shingles(t)) for doc, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[top(i)] = top(j)
    least = defaultdict(lambda: 1 << 62)
    for i, (doc, _) in enumerate(sets):
        least[top(i)] = min(least[top(i)], doc)
    return sorted((doc, len(s), least[top(i)], doc == least[top(i)]) for i, (doc, s) in enumerate(sets))


def family(rng, n=60):
    """Texts that share passages, and copies edited more and less."""
    passage = prose(rng, 45)
    out = []
    for i in range(n):
        if i % 3 == 0 and out:
            w = (out[rng.randrange(len(out))] or "x").split(" ")
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(9)}"
            out.append(" ".join(w))
        elif i % 3 == 1:
            out.append(f"{prose(rng, rng.randrange(40))} {passage} {prose(rng, rng.randrange(60))}")
        else:
            out.append(prose(rng, rng.randrange(1, 150)))
    return out


def test_exact_against_brute_force(spark, odd_texts):
    texts = [*odd_texts, *family(random.Random(1))]
    texts += [texts[5]] * 40 + [t and t.replace(" ", "\n") for t in texts[20:30]]
    got = exact_dedup.exact_dedup(make(spark, texts)).collect()
    want, groups = brute_exact(list(enumerate(texts)))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == groups and all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_with_null_and_repeated_identifiers(spark):
    rows = [(None, "a b"), (None, "ab"), (3, "ab "), (3, "ab "), (3, "ab "), (4, "z"), (4, "z")]
    got = exact_dedup.exact_dedup(make(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert [r.keep_id for r in got if r.doc_id == 3] == [3] * 3 and sum(r.kept for r in got) == 2
    assert {r.group_size for r in got} == {5, 2}


def test_exact_group_over_many_partitions(spark):
    """A group that is cut between partitions is one group."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = exact_dedup.exact_dedup(make(spark, ["same text"] * 900 + [f"t{i}" for i in range(50)])).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id < 900} == {(0, 900)} and sum(r.kept for r in got) == 51


def test_substring_against_brute_force(spark, odd_texts):
    texts = [*odd_texts, *family(random.Random(2)), " ".join(["again"] * 90)]
    got = substring_dedup.substring_dedup(make(spark, texts)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute_substring(list(enumerate(texts)))


def test_substring_over_many_parts_and_slices(spark):
    texts = family(random.Random(3), 90)
    want = brute_substring(list(enumerate(texts)))
    for part_bytes, owned in ((200, 1 << 24), (5000, 8)):
        got = substring_dedup.substring_dedup(make(spark, texts), part_bytes=part_bytes, owned=owned)
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()), key=repr) == want


def test_sketch_lets_as_few_windows_through_at_any_size(spark):
    """Windows that occur once: the share that passes does not grow with the input."""
    share = []
    for n in (40, 640):
        rng = random.Random(n)
        rows = spark.createDataFrame([(i, 0, prose(rng, 300, 10**9)) for i in range(n)], "doc long, tag long, text string")
        share.append(substring_dedup.candidates(rows, part_bytes=20_000).count() / (n * 281))
    assert max(share) < 0.03


def test_gaps_round_trip():
    rng = np.random.default_rng(2)
    gap = np.concatenate([rng.integers(1 << b, size=50, dtype=np.uint64) for b in (1, 7, 8, 14, 20, 40, 62)])
    rng.shuffle(gap)
    bounds = np.array([0, 0, 3, 200, 200, len(gap)])
    got, n = substring_dedup.unpack_gaps(substring_dedup.pack_gaps(gap, bounds))
    assert (got == gap).all() and n.tolist() == np.diff(bounds).tolist()


def test_substring_with_shared_identifiers(spark):
    w = [f"u{i}" for i in range(25)]
    a, b = " ".join(w), " ".join(["x", *w])
    got = substring_dedup.substring_dedup(make(spark, [a, a, b], [7, 7, 7])).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(25, 0), (25, 0), (26, 25)]
    none = substring_dedup.substring_dedup(make(spark, [a, a], [None, 2])).collect()
    assert {(r.doc_id, r.n_removed) for r in none} == {(None, 25), (2, 0)}


def test_near_against_brute_force(spark, odd_texts):
    texts = [*odd_texts, *family(random.Random(5), 120)]
    got = minhash_dedup.near_duplicates(make(spark, texts)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_near(list(enumerate(texts)))


def test_near_large_group_of_copies(spark):
    """Copies edited so that many of them are not linked with one another: components are those of all links."""
    rng = random.Random(6)
    base = prose(rng, 120).split(" ")
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
        texts.append(" ".join(w))
    got = minhash_dedup.near_duplicates(make(spark, texts)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_near(list(enumerate(texts)))


def sketched(spark, sets):
    """Rows (i, n, samples, bitmap words) of the odd sketches of many sets of hashes."""
    m = minhash_dedup
    odd, samples = m._odd(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets))
    rows = [(i, len(s), int(k), *o.tolist()) for i, (s, k, o) in enumerate(zip(sets, samples, odd, strict=True))]
    return spark.createDataFrame(rows, f"i long, n long, samples int, {', '.join(f'o{j} long' for j in range(m.ODD_BITS // 64))}")


def kept_pairs(spark, pairs):
    """How many of the pairs of sets the sketches let through."""
    a, b = sketched(spark, [x for x, _ in pairs]).alias("x"), sketched(spark, [y for _, y in pairs]).alias("y")
    return a.join(b, "i").filter(minhash_dedup._likely("x", "y")[1]).count()


def random_pair(rng, union, share, own):
    """Two sets of a union, that share so much of it; of the rest the first has the share ``own``."""
    u = rng.integers(1 << 63, size=union, dtype=np.int64).astype(np.uint64)
    common = -(-union * share // 100)
    cut = common + round((union - common) * own)
    return u[:cut], np.concatenate([u[:common], u[cut:]])


@pytest.mark.parametrize("seed", [1, 2])
def test_wide_bands_lose_no_link(spark, monkeypatch, seed):
    """All bands count as wide, so what the last round finds comes from rare shingles: components are those of all links."""
    monkeypatch.setattr(minhash_dedup, "DIRECT", 0)
    monkeypatch.setattr(minhash_dedup, "ROUNDS", 0)
    rng = random.Random(seed)
    texts = family(rng, 60)
    for _ in range(3):
        base = prose(rng, rng.randrange(8, 90)).split(" ")
        for _ in range(25):
            w = base[: rng.randrange(len(base) * 3 // 4, len(base) + 1)]
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(20)}"
            texts.append(" ".join(w))
    got = minhash_dedup.near_duplicates(make(spark, texts)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_near(list(enumerate(texts)))


def test_rare_shingles_find_every_link(spark):
    """The prefix filter alone against all pairs of random sets, each a component of its own."""
    rng, sets = random.Random(3), []
    for _ in range(12):
        base = rng.sample(range(400), rng.randrange(1, 60))
        for _ in range(8):
            own = set(base) - set(rng.sample(base, rng.randrange(1 + len(base) // 4)))
            sets.append(sorted((own or set(base)) | {1000 + rng.randrange(300) for _ in range(rng.randrange(1 + len(base) // 5))}))
    links = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len({*sets[a]} & {*sets[b]}) >= 75 * len({*sets[a]} | {*sets[b]})}
    table = spark.createDataFrame(list(enumerate(sets)), "id long, set array<long>")
    chosen = spark.createDataFrame([(i, i) for i in range(len(sets))], "c long, g long")
    hashes = np.random.default_rng(1).integers(1 << 63, size=2000, dtype=np.int64).astype(np.uint64)
    sketches = sketched(spark, [hashes[s] for s in sets]).withColumnRenamed("i", "c").drop("n")
    got = {tuple(sorted(r)) for r in minhash_dedup._sharing_rare_shingles(Scratch(spark), table, chosen, sketches).collect()}
    assert links <= got and len(links) > 50 and len(got) < 0.1 * len(sets) * (len(sets) - 1) / 2


@pytest.mark.parametrize("union", [1, 4, 9, 40, 167, 700, 2500, 4600, 7000, 20000])
def test_sketches_keep_pairs_at_the_threshold_and_refute_those_below(spark, union):
    rng, count = np.random.default_rng(union), 300 if union < 3000 else 60
    for own in (0.5, 1.0, 0.9):
        assert kept_pairs(spark, [random_pair(rng, union, 75, own) for _ in range(count)]) == count
    if 40 <= union <= 700:
        assert kept_pairs(spark, [random_pair(rng, union, 66, 0.5) for _ in range(count)]) < 0.1 * count


@pytest.mark.parametrize("n", [10000, 20000, 60000])
def test_pairs_at_the_threshold_are_not_dropped(spark, n):
    """Many pairs of large sets at similarity 0.75: bits that differ as the samples of such sets make them."""
    m, rng, count = minhash_dedup, np.random.default_rng(n), np.zeros(minhash_dedup.ODD_BITS + 1, int)
    union = round(2 * n / 1.75)
    cells, own = (round(m.SAMPLES * (1 - np.exp(-size / m.SAMPLES))) for size in (union, n))
    for _ in range(120):
        common = rng.hypergeometric(union * 3 // 4, union - union * 3 // 4, cells, size=500)
        apart = 2 * (own - common)
        bit = np.repeat(np.arange(500), apart) * m.ODD_BITS + rng.integers(m.ODD_BITS, size=apart.sum())
        odd = np.bincount(bit, minlength=500 * m.ODD_BITS).reshape(500, -1) & 1
        count += np.bincount(odd.sum(axis=1), minlength=len(count))
    words, seen = m.ODD_BITS // 64, np.flatnonzero(count)
    rows = [(int(d), n, own, *np.packbits(np.arange(m.ODD_BITS) < d).view(np.int64).tolist()) for d in seen]
    pairs = spark.createDataFrame(rows, f"d int, n long, samples int, {', '.join(f'o{i} long' for i in range(words))}").alias("x")
    none = spark.createDataFrame([(n, own, *[0] * words)], f"n long, samples int, {', '.join(f'o{i} long' for i in range(words))}").alias("y")
    lost = pairs.crossJoin(none).filter(~m._likely("x", "y")[1]).select("d").collect()
    assert sum(count[r.d] for r in lost) == 0, "of 60,000"


def test_near_keeps_one_row_of_each_group(spark):
    texts = ["one two three four five six"] * 3 + [None, "", "other words that are not like the first at all"]
    docs = make(spark, texts, [5, 2, 2, 9, 8, None])
    kept = minhash_dedup.keep_distinct(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [2, 8, 9, None]


@pytest.mark.parametrize("op", [exact_dedup.exact_dedup, substring_dedup.substring_dedup, minhash_dedup.near_duplicates, minhash_dedup.keep_distinct])
def test_empty_table(spark, op):
    assert op(make(spark, [])).count() == 0
