"""Every query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from cladewise.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    assert got == sorted((tuple(map(plain, r)) for r in found.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_lca_pairs_reach_the_whole_tree(spark):
    got = registry.queries()["lca_line_pairs"](spark, SF).collect()
    tree = {r.taxid for r in registry.queries()["taxonomy_nodes"](spark, SF).collect()}
    assert tree <= {r.b for r in got}
    species = [r for r in got if r.a > 1000 or r.b > 1000]
    assert any(r.a > 1000 and r.b > 1000 and r.a != r.b for r in species) and any(r.a == 0 for r in species)
    assert any(r.is_ancestor and 0 < r.a < 100 for r in species) and {1, *range(10, 15)} <= {r.lca for r in species}
