import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cladewise.functions import hashing as H
from cladewise.functions import scalars as S
from cladewise.operators import minimizers as M

U64 = (1 << 64) - 1


def ref_fmix(k):
    k ^= k >> 33
    k = k * H.FMIX_1 & U64
    k ^= k >> 33
    k = k * H.FMIX_2 & U64
    return k ^ k >> 33


def rotl(x, r):
    return (x << r | x >> 64 - r) & U64


def ref_murmur(k):
    h = rotl(rotl(k * H.MURMUR_1 & U64, 31) * H.MURMUR_2 & U64, 27) * 5 + H.MURMUR_ADD & U64
    return ref_fmix(h ^ 8)


def test_known_hashes():
    assert ref_fmix(123) == 9208534749291869864
    assert ref_murmur(123) == 15548744828003690463
    assert ref_murmur(0) == 9135616379521106945


def test_hash_columns(spark):
    random.seed(1)
    values = [0, 1, 123, U64, 1 << 63] + [random.getrandbits(64) for _ in range(200)]
    df = spark.createDataFrame([(H.signed(v),) for v in values], "x long")
    rows = df.select("x", H.fmix64(F.col("x")).alias("f"), H.murmur_hash3(F.col("x")).alias("m"), H.slot_index(F.col("x"), 31818).alias("i"), H.unsigned_at_least(F.col("x"), 1 << 63).alias("g"), H.wrapping_multiply(F.col("x"), U64 - 4).alias("w")).collect()
    fast = H.with_murmur_hash3(H.with_fmix64(df, F.col("x"), "f"), F.col("x"), "m")
    assert sorted(map(tuple, fast.collect())) == sorted((r.x, r.f, r.m) for r in rows)
    for r in rows:
        v = r.x & U64
        assert (r.f & U64, r.m & U64, r.i, r.g, r.w & U64) == (ref_fmix(v), ref_murmur(v), v % 31818, v >= 1 << 63, v * (U64 - 4) & U64)
    assert [int(h) for h in M._murmur(np.array(values, np.uint64))] == [ref_murmur(v) for v in values]


def test_cells(spark):
    x = 0x1234567890ABCDEF
    r = spark.range(1).select(H.compacted(F.lit(x), 16).alias("k"), H.cell32(F.lit(x), 16, F.lit(0xABCD)).alias("c"), H.left32(F.lit(0x1234ABCD).cast("long"), 16).alias("l"), H.right32(F.lit(0x1234ABCD).cast("long"), 0xFFFF).alias("r"), H.cell64(F.lit(x), 16, F.lit(7)).alias("c64"), H.left64(F.lit(x), 16).alias("l64"), H.right64(F.lit(x), 0xFFFF).alias("r64"), H.sequence_id(F.lit(x)).alias("s"), H.combined32(F.lit(0x1234).cast("long"), F.lit(0xABCD).cast("long"), 16).alias("b")).first()
    assert (r.k, r.c, r.l, r.r, r.s, r.b) == (0x1234, 0x1234ABCD, 0x1234, 0xABCD, 0x90ABCDEF, 0x1234ABCD)
    assert (r.c64, r.l64, r.r64) == (0x1234 << 48 | 7, 0x1234, 0x567890ABCDEF)


def test_bits():
    assert H.taxid_bits(26) == 5 and H.taxid_bits(35) == 6 and H.taxid_bits(1) == 1 and H.taxid_bits(26, 8) == 8
    with pytest.raises(ValueError):
        H.taxid_bits(26, 3)
    assert H.index_bits(1) == 1 and H.index_bits(1 << 30) == 30


def test_seed_masks():
    assert S.seed_template(31, 7) == "1" * 17 + "01" * 7
    assert S.seed_mask(31, 7) == 4611686018212639539
    assert S.expand_mask(0b1010, 2) == 204 and S.expand_mask(0b0101, 1) == 5
    assert S.expand_mask(9, 0) == 9 and S.expand_mask(9, 65) == 9
    with pytest.raises(ValueError):
        S.seed_template(31, 8)


def test_masks_expand_to_all_64_bits(spark):
    values = [0, 5, (1 << 20) - 1, 1 << 20, 1199999, 1 << 31, U64 >> 1, U64]
    df = spark.createDataFrame([(H.signed(v),) for v in values] + [(None,)], "x long")
    for factor in (1, 2, 3, 32, 33, 64):
        got = [r.m for r in df.select(S.expand_mask_col(F.col("x"), factor).alias("m")).collect()]
        assert got == [H.signed(S.expand_mask(v, factor)) for v in values] + [None], factor


def test_sizes(spark):
    assert [S.parse_size(x) for x in ("1G", "1M", "1k", "1.5G")] == [1 << 30, 1 << 20, 1024, 1610612736]
    for bad in ("1B", "G", "", "xM"):
        with pytest.raises(ValueError):
            S.parse_size(bad)
    assert S.format_bytes(31817.14 * 4) == "124.29KB" and S.format_bytes(5) == "5.00B"
    rows = spark.createDataFrame([("1G",), ("1.5m",), ("3B",), ("",)], "t string").select(S.parse_size_col(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [1 << 30, 1572864, None, None]


def test_formatted_sizes_of_ties_and_nulls(spark):
    sizes = [0.0, 0.005, 1.005, 1152.0, 1408.0, 1023.995, 1048576.0 * 2.675, 16.0 * 262144**2, 16.0 * 8999999**2, 2.0**63, 2.0**75, -784.0]
    rows = spark.createDataFrame([(x,) for x in [*sizes, None]], "x double").select(S.format_bytes_col(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [*map(S.format_bytes, sizes), None]


@given(st.text("ACGTN", max_size=80), st.sampled_from([M.Scheme(12, 8, 2), M.Scheme(9, 9, 0, 0), M.Scheme(10, 7, 0)]))
def test_scan_against_definition(seq, scheme):
    """Each k-mer by its definition."""
    code, comp = {c: i for i, c in enumerate("ACGT")}, {"A": "T", "C": "G", "G": "C", "T": "A"}
    number = lambda s: sum(code[c] << 2 * (len(s) - 1 - i) for i, c in enumerate(s))
    want = []
    for p in range(len(seq) - scheme.k + 1):
        kmer = seq[p : p + scheme.k]
        if "N" in kmer:
            continue
        subs = [kmer[i : i + scheme.l] for i in range(scheme.k - scheme.l + 1)]
        cand = [min(number(s), number("".join(comp[c] for c in reversed(s)))) & scheme.mask ^ scheme.flip for s in subs]
        want.append((p, ref_murmur(min(cand) ^ scheme.flip)))
    at, h = M.scan(np.frombuffer(seq.encode(), np.uint8), scheme)
    assert list(zip(at.tolist(), map(int, h))) == want


def test_reverse_complement_has_the_same_minimizers(spark):
    random.seed(2)
    seq = "".join(random.choice("ACGT") for _ in range(400))
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    df = spark.createDataFrame([(1, seq), (2, back)], "id int, seq string")
    rows = M.minimizers(df, M.Scheme(), ["id"]).collect()
    assert sorted(r.hash for r in rows if r.id == 1) == sorted(r.hash for r in rows if r.id == 2)
    assert {tuple(r) for r in rows} == {(r.id, r.pos, r.hash) for r in M.minimizers_sql(df, M.Scheme(), ["id"]).collect()}
