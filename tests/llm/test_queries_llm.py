"""Every corpus query over the smallest tables: against its SQL in DuckDB where there is one, else by what its contract says."""

import os
import zlib

import duckdb
import pytest

from cladewise.llm import registry

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_against_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    found = duck.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    assert got == sorted((tuple(map(plain, r)) for r in found.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql(spark, duck, name):
    rows = registry.queries()[name](spark, SF).collect()
    ids = [r[0] for r in duck.sql("select doc_id from documents").fetchall()]
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    folds = {"op1_language_id": (5, 0), "op2_toxicity": (3, 1), "op8_quality": (5, 0)}
    if name in folds:
        by, at = folds[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % by == at) for r in rows)
    if name == "op2_toxicity":
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    if name == "op1_language_id":
        known = {r[0] for r in duck.sql("select distinct lang from documents").fetchall()} | {"und"}
        assert all(0 <= r.score <= 1 and r.lang_pred in known for r in rows)
    if name == "op5_sharding":
        text = dict(duck.sql("select doc_id, coalesce(text, '') from documents").fetchall())
        assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
        sizes = [sum(r.shard == s for r in rows) for s in range(16)]
        assert max(sizes) - min(sizes) <= 1
