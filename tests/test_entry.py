import duckdb
import pytest

import __spark_entry__ as entry
from binfold.plans import queries as histograms

QUICK = ["build_1dxp", "build_4dxf", "build_specials", "merge_nway", "percentile_bounds", "percentile_specials", "grouped_percentile", "cdf_interp", "topk_5", "min_count", "max_value_specials", "boundary_2d", "grid_3d", "grid_mult", "grid_inf", "bbox_batch"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("lineitem", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same(v):
    return "nan" if isinstance(v, float) and v != v else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", QUICK)
def test_against_duckdb(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    got = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(same, r)) for r in got.fetchall())
    assert sorted(tuple(same(r[c]) for c in columns) for r in df.collect()) == want and want


def test_every_histogram_query_has_its_sql():
    assert histograms.queries().keys() == histograms.oracle_sql().keys() and len(histograms.queries()) >= 35
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_flagship(spark):
    assert entry.entry(spark).columns == ["percentile", "value", "lower", "upper"]


def test_encoding_is_generated_code_with_map_side_counts(spark, sf_dir):
    plan = entry.queries()["build_1dxp"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Python" not in plan and "ReadSchema: struct<l_extendedprice:double>" in plan
