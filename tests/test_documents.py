"""The steps that all queries over documents share: letters, packed distinct counts, sieves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.operators import index
from cladewise.operators import minimizers as M
from cladewise.plans import domains, queries_s

SF = "/root/testdata/sf0.001"


def test_letters_by_bytes_equal_the_expression(spark):
    texts = ["", None, "aZ09", "ñandú – Ωμ 7x", "a\x00b\ncé\U0001f600d", "_-_", "ACGT" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {r.id: r.seq for r in df.select("id", domains.pseudo_dna(F.col("text")).alias("seq")).collect()}
    for n in (1, 3):
        assert {r.id: r.seq for r in domains.with_pseudo_dna(df.repartition(n), "text").collect()} == want


@pytest.mark.parametrize("packed", [1, 1 << 22])
def test_distinct_hashes_are_packed(spark, monkeypatch, tmp_path, packed):
    monkeypatch.setattr(M, "PACKED", packed)
    rng = np.random.default_rng(5)
    seqs = ["".join(rng.choice(list("ACGT_"), 300, p=[0.24, 0.25, 0.25, 0.25, 0.01])) for _ in range(20)]
    seqs += seqs[:5] + ["A" * 400, "", None, "ACG"]
    path = str(tmp_path / "reads")
    spark.createDataFrame(list(enumerate(seqs)), "id int, seq string").repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    found = M.minimizers(df, domains.PLAIN, ["id"])
    want = found.agg(F.count("*"), F.count_distinct("hash")).first()
    assert tuple(M.distinct(df, domains.PLAIN).first()) == tuple(want)
    assert tuple(M.distinct(df.filter("id < 0"), domains.PLAIN).first()) == (0, 0)
    once = M.minimizers(df, domains.PLAIN, ["id"], once=True)
    assert once.count() < found.count() and {tuple(r) for r in once.select("id", "hash").collect()} == {tuple(r) for r in found.select("id", "hash").collect()}


def test_no_hash_is_shuffled_as_a_row(spark):
    plan = queries_s.distinct_kmers_exact(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part" in plan and "hashpartitioning(hash" not in plan


def test_sieve_lets_all_entries_through_and_little_else(spark):
    rng = np.random.default_rng(7)
    own, other = (rng.integers(0, 1 << 64, 30000, np.uint64) for _ in range(2))
    entries = spark.createDataFrame([(int(x),) for x in own.view(np.int64)], "hash long")
    bits = np.frombuffer(index.sieve(entries, len(own)), np.uint8)
    assert M.in_sieve(bits, own).all() and M.in_sieve(bits, other).mean() < 0.1
    assert not M.in_sieve(np.frombuffer(index.sieve(entries.limit(0), 0), np.uint8), own).any()
    assert index.sieve(entries, 1 << 28) is None


def test_kmers_that_the_index_lacks_do_not_leave_the_kernel(spark):
    hits = queries_s._hits(spark, SF, "shuffle")
    found = M.minimizers(domains.reads_s(spark, SF), domains.PLAIN, ["read_index"])
    entries = queries_s._index(spark, SF)
    n = entries.count()
    passed = M.minimizers(domains.reads_s(spark, SF), domains.PLAIN, ["read_index"], sieve=index.sieve(entries, n))
    assert passed.count() < found.count() / 5
    same = lambda kmers: sorted(map(tuple, index.annotate(kmers, entries, "shuffle").select("read_index", "pos", "taxid").collect()))
    assert same(passed) == same(found) == sorted(map(tuple, hits.select("read_index", "pos", "taxid").collect()))
