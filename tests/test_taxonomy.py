import itertools
import random

import pytest
from pyspark.sql import functions as F

from cladewise.functions.scalars import common_prefix
from cladewise.operators import report, resolve
from cladewise.operators import taxonomy as tax

NODES = [(1, 0, "no rank", "root"), (10, 1, "superkingdom", "D"), (20, 10, "no rank", "d1"), (30, 20, "family", "F"), (31, 20, "family", "G"), (40, 30, "species", "s"), (41, 30, "species", "t"), (50, 31, "genus", "g"), (99, 98, "species", "loose")]


@pytest.fixture(scope="module")
def tree(spark):
    return tax.with_paths(spark.createDataFrame(NODES, "taxid long, parent long, rank string, name string")).cache()


def path(t):
    up = {n[0]: n[1] for n in NODES}
    out = []
    while t:
        out.append(t)
        t = up[t]
    return out[::-1]


def lca(a, b):
    if not a or not b:
        return a or b
    return next((x for x, y in reversed(list(zip(path(a), path(b)))) if x == y), 0)


def test_paths(tree):
    got = {r.taxid: r.path for r in tree.collect()}
    assert got == {n[0]: path(n[0]) for n in NODES if n[0] != 99}  # what does not hang from the root is not there


def test_codes_and_lineage(tree):
    got = {r.taxid: (r.rank_code, r.depth) for r in tax.described(tree).collect()}
    assert got == {1: ("R", 0), 10: ("D", 1), 20: ("D1", 2), 30: ("F", 3), 31: ("F", 3), 40: ("S", 4), 41: ("S", 4), 50: ("G", 4)}
    row = tax.described(tree).filter("taxid = 40").first()
    assert row.mpa == "d__D|f__F|s__s" and row.lineage.startswith("no rank:root > superkingdom:D")


def test_trim_and_numbers(spark, tree):
    small = tax.trim(tree, spark.createDataFrame([(41,), (777,)], "taxid long"))
    assert sorted(r.taxid for r in small.collect()) == [1, 10, 20, 30, 41]
    assert {r.taxid: r.internal_id for r in tax.number_nodes(tree).collect()} == {1: 1, 10: 2, 20: 3, 30: 4, 31: 5, 40: 6, 41: 7, 50: 8}
    rows = {r.external_id: r for r in tax.node_table(tree).collect()}
    assert rows[30].child_ids == [6, 7] and rows[50].path == [1, 2, 3, 5, 8] and rows[1].parent_id == 0


def test_lca_laws(spark, tree):
    ids = [n[0] for n in NODES[:-1]]
    for a, b in itertools.product(ids, ids):
        assert lca(a, b) == lca(b, a) and lca(a, a) == a
    pairs = tree.select(F.col("taxid").alias("a"), F.col("path").alias("p")).crossJoin(tree.select(F.col("taxid").alias("b"), F.col("path").alias("q")))
    for r in pairs.select("a", "b", tax.lca(F.col("p"), F.col("q")).alias("l"), tax.is_ancestor(F.col("a"), F.col("q")).alias("up"), F.size(common_prefix(F.col("p"), F.col("q"))).alias("n")).collect():
        assert r.l == lca(r.a, r.b) and r.up == (r.a in path(r.b))


def brute_call(counts, n, confidence, least):
    import math

    if n < least or not counts:
        return 0
    score = {t: sum(c for u, c in counts.items() if u in path(t)) for t in counts}
    best = 0
    for t, s in score.items():
        if s == max(score.values()):
            best = lca(best, t)
    need = math.ceil(confidence * n)
    for a in reversed(path(best)):
        if sum(c for u, c in counts.items() if a in path(u)) >= need:
            return a
    return 0


def test_calls_against_brute_force(spark, tree):
    random.seed(5)
    ids = [n[0] for n in NODES[:-1]]
    reads, hits, want = [], [], {}
    for i in range(150):
        n = random.choice([0, 1, 2, 5, 9])
        own = [random.choice([0, *ids]) for _ in range(n)]
        reads.append((i, n))
        hits += [(i, p + 1, t) for p, t in enumerate(own)]
        counts = {t: own.count(t) for t in set(own) if t}
        want[i] = {c: brute_call(counts, n, c, 2) for c in (0.0, 0.25, 0.5, 1.0)}
    r = spark.createDataFrame(reads, "read_index int, n int")
    h = spark.createDataFrame(hits, "read_index int, pos int, taxid long")
    for c in (0.0, 0.25, 0.5, 1.0):
        got = {x.read_index: x.call for x in resolve.resolve(r, h, tree, ["read_index"], c).collect()}
        assert got == {i: w[c] for i, w in want.items()}


def brute_string(n1, n2, at):
    def part(lo, hi):
        runs = [(k, len(list(g))) for k, g in itertools.groupby(at.get(p, "0") for p in range(lo, hi))]
        return " ".join(f"{k}:{n}" for k, n in runs)

    first = part(1, n1 + 1)
    return first if n2 is None else f"{first} |:| {part(n1 + 1, n1 + n2 + 1)}"


def test_hit_strings_against_brute_force(spark):
    random.seed(6)
    reads, hits, amb, want = [], [], [], {}
    for i in range(120):
        n1, n2 = random.choice([0, 1, 4, 12]), random.choice([None, 0, 3, 8])
        at = {p: random.choice(["7", "9", "A"]) for p in range(1, n1 + (n2 or 0) + 1) if random.random() < 0.6}
        reads.append((i, n1, n2))
        hits += [(i, p, int(t)) for p, t in at.items() if t != "A"]
        amb += [(i, p) for p, t in at.items() if t == "A"]
        want[i] = brute_string(n1, n2, at)
    r = spark.createDataFrame(reads, "read_index int, n1 int, n2 int")
    got = resolve.hit_strings(r, spark.createDataFrame(hits, "read_index int, pos int, taxid long"), ["read_index"], spark.createDataFrame(amb, "read_index int, pos int"))
    assert {x.read_index: x.hit_string for x in got.collect()} == want


def test_report_conserves_reads(spark, tree):
    calls = spark.createDataFrame([(i, c) for i, c in enumerate([40, 40, 41, 50, 0, 31, 10, 0])], "read_index int, call long")
    rows = report.kreport(tree, report.clade_counts(calls, tree), report.totals(calls)).orderBy("ord").collect()
    assert [r.taxid for r in rows] == [0, 1, 10, 20, 30, 40, 41, 31, 50]
    assert rows[0].rank_code == "U" and rows[1].clade_reads == 6 and sum(r.taxon_reads for r in rows) == 8
    text = [r.value for r in report.kreport_lines(report.kreport(tree, report.clade_counts(calls, tree), report.totals(calls))).orderBy("ord").collect()]
    assert text[2] == " 75.00\t6\t1\tD\t10\t  D"
    both = report.kreport(tree, report.clade_counts(calls, tree), report.totals(calls), zero_counts=True)
    assert both.count() == 9
    mpa = report.mpa_report(tree, report.clade_counts(calls, tree)).orderBy("ord").collect()
    assert [r.lineage for r in mpa] == ["d__D", "d__D|f__F", "d__D|f__F|s__s", "d__D|f__F|s__t", "d__D|f__G", "d__D|f__G|g__g"]
