"""Queries against their SQL twins on the smallest tables, where they are there."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NAMES = ["p4_found", "p6_found", "ref_a02_complete_entities", "ref_a03_dense_panel", "ref_a05_quarterly_forward_fill", "ref_g02_metrics_two_grains", "ref_j10_published_quarter", "ref_p01_features", "ref_p13_level_shifts", "ref_p24_own_volatility", "ref_p28_region_split", "ref_p39_interval_bands", "ref_p41_online_choice", "ref_w06_spikes"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW \"{os.path.basename(f)[:-8]}\" AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 4) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    ran = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in ran.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-4) if isinstance(x, float) and isinstance(y, (int, float)) else x == y for x, y in zip(a, b))


def test_every_twin_has_a_query():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q) and len(q) > 80


def test_columns_of_the_found_queries(spark):
    q = entry.queries()
    want = {"p4_found": "src_table territory_id field", "p5_found": "src_table territory_id category month", "p6_found": "shock_id indicator quarterly_id"}
    for name, cols in want.items():
        df = q[name](spark, SF)
        assert df.columns == cols.split() and df.count() == df.distinct().count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
