import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import make, prose
from pyspark.sql import functions as F

from cladewise.llm import language_id, quality, toxicity

VOWELS = {"aa": "aeo", "bb": "iuy"}


def say(rng, lang, n):
    return " ".join("".join(rng.choice("ktsm" if lang == "aa" else "ngld") + rng.choice(VOWELS[lang]) for _ in range(3)) for _ in range(n))


def test_language(spark, odd_texts):
    rng = random.Random(1)
    langs = [rng.choice(["aa", "bb"]) for _ in range(300)]
    texts = [say(rng, x, rng.randrange(3, 40)) for x in langs] + odd_texts
    docs = make(spark, texts, langs=langs + [None] * len(odd_texts))
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.fold("doc_id", 5) == 0).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert len(got) == len(texts) and sum(got[i].lang_pred == langs[i] for i in held) >= 0.98 * len(held) > 30
    for i, t in enumerate(odd_texts):
        r = got[300 + i]
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not t or not any(c.isalpha() for c in t))


def test_code_lengths_against_definition():
    """Every byte's code length, worked out from counts alone."""
    rng = random.Random(2)
    learned = {x: [say(rng, x, 30) for _ in range(4)] for x in VOWELS}
    counts = {}
    for x, texts in learned.items():
        grams, _ = language_id._grams(pa.array(texts))
        for o, g in enumerate(grams):
            counts[o, x] = np.unique(g.astype(np.int64), return_counts=True)
    trees = language_id.Trees(sorted(learned), counts)
    table = {k: dict(zip(a.tolist(), n.tolist(), strict=True)) for k, (a, n) in counts.items()}

    def cost(lang, key, o):
        own = table[o, lang]
        context = [n for k, n in own.items() if k >> 8 == key >> 8]
        if key in own:
            return -np.log2(own[key] / (sum(context) + len(context)))
        below = cost(lang, key & (1 << 8 * o) - 1, o - 1) if o else 8.0
        return below - (np.log2(len(context) / (sum(context) + len(context))) if context else 0)

    grams, _ = language_id._grams(pa.array([say(rng, "aa", 8), "qq zz", "kata"]))
    got = trees.lengths(grams[language_id.ORDER])
    for i, lang in enumerate(sorted(learned)):
        assert np.allclose(got[i], [cost(lang, int(k), language_id.ORDER) for k in grams[language_id.ORDER]], atol=1e-3)


def test_blocks_of_languages_and_pruned_trees(spark):
    """Blocks change nothing; trees cut to a size still tell the languages apart."""
    rng = random.Random(9)
    counts = {}
    for x in VOWELS:
        grams, _ = language_id._grams(pa.array([say(rng, x, 60) for _ in range(5)]))
        for o, g in enumerate(grams):
            counts[o, x] = np.unique(g.astype(np.int64), return_counts=True)
    grams, offsets = language_id._grams(pa.array([say(rng, "aa", 9), say(rng, "bb", 7)]))
    one, two = (language_id.Forest(counts, block).bits(grams[language_id.ORDER], offsets[:-1]) for block in (1, 8))
    assert np.allclose(one, two, atol=1e-2) and one.argmin(axis=0).tolist() == [0, 1]
    limit = language_id._bytes(counts, 8) // 3
    small = language_id.pruned(counts, limit)
    assert language_id._bytes(small, 8) <= limit and len(small[0, "aa"][0]) == len(counts[0, "aa"][0])
    assert language_id.Forest(small).bits(grams[language_id.ORDER], offsets[:-1]).argmin(axis=0).tolist() == [0, 1]


def test_language_ties_and_identifiers(spark):
    """Equal code lengths: the first language in order. Rows of null and of shared identifiers are learned and scored."""
    rows = [(None, "kata"), (None, "kata"), (1, "kata"), (1, "kata"), (2, "kata")]
    docs = make(spark, [t for _, t in rows], ids=[i for i, _ in rows], langs=["bb", "aa", "aa", "bb", None])
    got = language_id.identify(docs, F.lit(False)).collect()
    assert len(got) == 5 and {(r.lang_pred, r.score) for r in got} == {("aa", 0.5)}


def test_lookup_finds_all_and_nothing_else():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(1 << 32, size=5000, dtype=np.uint32))
    found = language_id.Lookup(keys)
    assert (found.find(keys) == np.arange(len(keys))).all()
    other = rng.integers(1 << 32, size=5000, dtype=np.uint32)
    assert ((found.find(other) >= 0) == np.isin(other, keys)).all()
    assert (language_id.Lookup(np.zeros(0, np.uint32)).find(other) < 0).all()


def test_language_without_labels(spark):
    got = language_id.identify(make(spark, ["abc", None], langs=[None, None]), F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity(spark, odd_texts):
    rng = random.Random(4)
    bad = ["vile", "foul", "nasty"]
    texts, y = [], []
    for i in range(600):
        w = prose(rng, rng.randrange(10, 80)).split(" ")
        y.append(int(i % 4 == 0))
        for _ in range(3 * y[-1]):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "!!", ","]))
        texts.append(" ".join(w))
    docs = make(spark, texts + odd_texts)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels(spark, [(i, 1, t) for i, t in enumerate(y)] + [(None, 1, 1), (5, 1, None), (99999, 1, 1)]), language_id.fold("doc_id", 3) == 1).collect()}
    held = [i for i in range(600) if got[i].held_out]
    right = sum(got[i].predicted == y[i] for i in held)
    assert right >= 0.93 * len(held) and all(got[i].predicted == 0 for i in held if not y[i])
    assert len(got) == len(texts) + len(odd_texts) and all(0 <= r.score <= 1 for r in got.values())
    again = toxicity.toxicity(docs, labels(spark, [(i, 1, t) for i, t in enumerate(y)]), language_id.fold("doc_id", 3) == 1)
    assert {r.doc_id: r.score for r in again.collect()} == {i: r.score for i, r in got.items()}


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(5)
    model = toxicity.Ftrl(10)
    for _ in range(2000):
        label = int(rng.random() < 0.3)
        at = np.unique(np.append(rng.integers(10, 1000, 20), 1 if label else 2))
        model.learn(at, label)
    w = model.weights(np.arange(1024))
    assert w[1] > 1 and w[2] < -0.5 and (w == 0).mean() > 0.3


def test_ftrl_against_the_update_written_out():
    """z, n and w of each coordinate, one number at a time, by the published update."""
    rng = np.random.default_rng(15)
    model, z, n, bias, bias_n = toxicity.Ftrl(6), [0.0] * 64, [0.0] * 64, 0.0, 0.0

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * toxicity.L1) / ((toxicity.BETA + np.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(400):
        at, label = np.unique(rng.integers(64, size=12)), int(rng.random() < 0.4)
        model.learn(at, label)
        p = 1 / (1 + np.exp(-(sum(weight(i) for i in at) + bias)))
        g = p - label
        for i in at:
            w, sigma = weight(i), (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / toxicity.ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
        bias_n += g * g
        bias -= toxicity.BIAS_ALPHA / (toxicity.BETA + np.sqrt(bias_n)) * g
    assert np.allclose(model.z, z, atol=1e-2) and np.allclose(model.n, n, rtol=1e-3) and abs(model.bias - bias) < 1e-3
    assert np.allclose(model.weights(np.arange(64)), [weight(i) for i in range(64)], atol=1e-2)


def test_scores_of_null_and_shared_identifiers(spark):
    texts, ids = ["vile a b", "c d e", "vile a b", "c d e", None], [None, 3, 3, 3, None]
    docs = make(spark, texts, ids=ids)
    given = labels(spark, [(3, 1, 0), (3, 1, 1), (None, 0, 1)])
    for got in (toxicity.toxicity(docs, given, F.lit(False)).collect(), quality.rate_quality(docs, given, F.lit(False)).collect()):
        assert sorted((r.doc_id for r in got), key=repr) == sorted(ids, key=repr)


@pytest.mark.parametrize("given,score", [([], 0.0), ([(0, 1, 1)], 1.0)])
def test_toxicity_with_one_label(spark, given, score):
    got = toxicity.toxicity(make(spark, ["a b", None]), labels(spark, given), F.lit(False)).collect()
    assert len(got) == 2 and all(abs(r.score - score) < 1e-6 for r in got)


def graded(rng, grade):
    w = prose(rng, rng.randrange(30, 90)).split(" ")
    return " ".join(x + "###" if rng.random() < (0.5, 0.25, 0.1, 0.0)[grade] else x for x in w)


def test_quality_of_four_grades(spark, odd_texts):
    rng = random.Random(6)
    y = [rng.randrange(4) for _ in range(700)]
    docs = make(spark, [graded(rng, g) for g in y] + odd_texts)
    got = {r.doc_id: r for r in quality.rate_quality(docs, labels(spark, [(i, g, 0) for i, g in enumerate(y)] + [(3, None, 0), (None, 2, 0)]), language_id.fold("doc_id", 5) == 0, good=2).collect()}
    held = [i for i in range(700) if got[i].held_out]
    assert np.mean([abs(got[i].expected_grade - y[i]) for i in held]) < 0.4
    assert np.mean([got[i].kept == (y[i] >= 2) for i in held]) > 0.9
    assert all(0 <= r.tail_prob <= 1 and 0 <= r.expected_grade <= 3 for r in got.values()) and len(got) == 700 + len(odd_texts)


def test_ordered_thresholds_and_gradient():
    rng = np.random.default_rng(7)
    m = quality.CumulativeLink(5)
    for _ in range(500):
        g = int(rng.integers(5))
        m.learn(np.array([g, 9]), np.array([0.8, 0.2]), g)
        assert (np.diff(m.thresholds()) > 0).all()
    score = np.array([m.w[[g, 9]] @ [0.8, 0.2] for g in range(5)])
    assert (np.diff(score) > 0).all()
    p = quality.probabilities(score, m.thresholds(), np.ones(5))
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == np.arange(5)).all()


@pytest.mark.parametrize("grade", range(4))
def test_gradient_against_finite_differences(grade):
    """What a step adds up for each weight and threshold parameter is the gradient of the row's negative log-likelihood."""
    rng = np.random.default_rng(grade)
    at, x = np.arange(5), rng.random(5)
    w, first, gaps = rng.normal(size=5), 0.3, rng.normal(size=2) / 2

    def loss(w, first, gaps):
        t = first + np.append(0.0, np.cumsum(np.exp(gaps)))
        below = np.concatenate([[0.0], 1 / (1 + np.exp(-(t - w @ x))), [1.0]])
        return -np.log(below[grade + 1] - below[grade])

    m = quality.CumulativeLink(4)
    m.w[at], m.first, m.gaps = w, first, gaps.copy()
    m.gw[:], m.gt[:] = 1e-30, 1e-30  # so the sums hold the squares of this one gradient
    m.learn(at, x, grade)
    moved = np.sign(np.concatenate([w - m.w[at], [first - m.first], gaps - m.gaps]))
    got = moved * np.sqrt(np.concatenate([m.gw[at], m.gt]))
    e, want = 1e-6, []
    for i in range(5):
        d = np.eye(5)[i] * e
        want.append((loss(w + d, first, gaps) - loss(w - d, first, gaps)) / (2 * e))
    want.append((loss(w, first + e, gaps) - loss(w, first - e, gaps)) / (2 * e))
    for i in range(2):
        d = np.eye(2)[i] * e
        want.append((loss(w, first, gaps + d) - loss(w, first, gaps - d)) / (2 * e))
    assert np.allclose(got, want, atol=1e-5)


def test_quality_filter_carries_rows(spark):
    rng = random.Random(8)
    y = [i % 2 for i in range(200)]
    docs = make(spark, [graded(rng, 3 if g else 0) for g in y])
    kept = quality.keep_quality(docs, labels(spark, [(i, g, 0) for i, g in enumerate(y) if i < 150]))
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert {r.doc_id for r in rows} >= {i for i in range(200) if y[i]} - {0} and sum(1 - y[r.doc_id] for r in rows) <= 3
    assert {r.tail_prob for r in rows} == {"mine-tail_prob"}
    assert quality.keep_quality(docs, labels(spark, [])).count() == 200


@pytest.mark.parametrize("op", [lambda d, l: language_id.identify(d, F.lit(False)), lambda d, l: toxicity.toxicity(d, l, F.lit(False)), lambda d, l: quality.rate_quality(d, l, F.lit(False)), quality.keep_quality])
def test_empty_table(spark, op):
    assert op(make(spark, []), labels(spark, [(1, 1, 0), (2, 0, 1)])).count() == 0


def test_quality_is_learned_from_flat_arrays(spark):
    """What the driver takes while it learns is the model and little beside it, not objects for each row and feature."""
    rng = random.Random(31)
    rows = 800
    docs = spark.createDataFrame([(i, prose(rng, 500, 100_000)) for i in range(rows)], "id long, text string")
    given = spark.createDataFrame([(i, i % 2) for i in range(rows)], "id long, grade int")
    tracemalloc.start()
    try:
        grades, weights, *_ = quality.fit(docs, given, epochs=1)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert grades == [0, 1] and np.count_nonzero(weights)
    assert most < 2 * weights.nbytes + 1.5e6
