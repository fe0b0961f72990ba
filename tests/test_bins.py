import numpy as np
import pytest
from pyspark.sql import functions as F

from binfold.functions.bins import FIELDS, with_bins
from binfold.functions.codec import bin_table
from binfold.operators import many_axes, one_axis
from binfold.operators.histogram import build
from binfold.plans import queries as histograms


@pytest.mark.parametrize("bits", [12, 13, 16, 20])
def test_columns_agree_with_the_table_for_every_code(spark, bits):
    t, codes = bin_table(bits), np.arange(1 << bits)
    at = t.position[codes]
    found = with_bins(spark.range(len(codes), numPartitions=4), {"c": "CAST(id AS int)"}, bits).toPandas().sort_values("id")
    assert list(found.columns) == ["id", *(f"c_{f}" for f in FIELDS)]
    assert (found["c_pos"].to_numpy() == at).all()
    for f, want in (("value", t.values), ("next", t.next), ("prev", t.prev), ("lower", t.lower), ("upper", t.upper)):
        # bit by bit: -0.0 is another number here
        assert (found[f"c_{f}"].to_numpy(np.float64).view(np.int64) == want[at].view(np.int64)).all(), f


def test_a_null_code_has_nulls(spark):
    df = spark.createDataFrame([(None, 5)], "a int, b int")
    row = with_bins(df, {"x": "a", "y": "b"}, 12).first().asDict()
    assert [row[f"x_{f}"] for f in FIELDS] == [None] * 6 and None not in [row[f"y_{f}"] for f in FIELDS]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["export_rows_1d", "export_rows_2d", "export_rows_4d", "boundary_3d", "percentile_50", "grouped_percentile", "cdf_interp", "topk_5", "min_count", "max_value"])
def test_bins_take_no_python_worker(spark, sf_dir, name):
    """A look-up in Python took a worker for each axis and task."""
    assert "Python" not in plan(histograms.queries()[name](spark, sf_dir))


def test_filters_on_bins_stay_above_the_aggregation(spark):
    h = build(spark.range(5).select(F.col("id").cast("double").alias("x")), "x", "1DxP")
    for df in (many_axes.boundaries(h), one_axis.ordered(h)):
        lines = plan(df).splitlines()
        inner = max(i for i, line in enumerate(lines) if "Aggregate" in line)
        assert not [line for line in lines[inner + 1 :] if "Filter" in line and "_p0" in line or "CASE" in line and "Filter" in line], lines
