import math

import numpy as np
import pytest

from binfold.functions.codec import bin_table, encode_numpy
from binfold.operators import many_axes as m
from binfold.operators.histogram import build, merge
from pyspark.sql import functions as F

INF, NAN = math.inf, math.nan


def points(spark, rows):
    names = "xyzw"[: len(rows[0])]
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{n} double" for n in names)), list(names)


def hist(spark, rows, layout=None):
    df, names = points(spark, rows)
    return build(df, names, layout or f"{len(names)}DxP")


def some(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dims)) * [30, 5, 2, 100][:dims]


@pytest.mark.parametrize("dims", [2, 3, 4])
def test_grid_keeps_all_counts(spark, dims):
    rows = [*some(200, dims).tolist(), [0.0] * dims, [INF] + [1.0] * (dims - 1), [NAN] * dims, [-INF] * dims]
    h = hist(spark, rows)
    g = m.grid(h, [m.Axis(-INF, INF, 4)] * dims)
    assert g.agg(F.sum("count")).first()[0] == len(rows) - 1
    assert g.count() == g.select("cell").distinct().count()


def test_grid_against_intervals(spark):
    rows = some(300, 2, 7)
    h = hist(spark, rows.tolist())
    t = bin_table(12)
    g = m.grid(h, [m.Axis(-40, 55, 5), m.Axis(0.5, 9, 3, m.MULTIPLICATIVE)]).collect()
    value = t.values[t.position[encode_numpy(rows.ravel(), 6)]].reshape(rows.shape)
    for r in g:
        inside = np.ones(len(rows), bool)
        for i, a in enumerate("xy"):
            v, low, high = value[:, i], r[f"{a}_start"], r[f"{a}_end"]
            inside &= ((v > low) | (v == low) & r[f"{a}_start_inclusive"]) & ((v < high) | (v == high) & r[f"{a}_end_inclusive"])
        assert inside.sum() == r["count"]


def test_grid_edges_and_zero(spark):
    h = hist(spark, [[0.0, 1.0], [5.0, 1.0]])
    rows = m.grid(h, [m.Axis(0, 10, 2), m.Axis(1, 1, 1)]).orderBy("cell").collect()
    assert (rows[0]["x_start"], rows[0]["x_end"], rows[0]["count"]) == (0.0, 0.0, 1)
    assert rows[0]["y_is_edge"] and sum(r["count"] for r in rows) == 2


def test_grid_is_checked(spark):
    h = hist(spark, [[1.0, 2.0]])
    good = m.Axis(0, 1, 2)
    for axes, cells in (([good], 10), ([good, m.Axis(2, 1, 1)], 10), ([good, m.Axis(0, 1, 0)], 10), ([good, m.Axis(NAN, 1, 1)], 10), ([good, m.Axis(0, 1, 1, m.MULTIPLICATIVE)], 10), ([good, good], 0), ([good, good], 1)):
        with pytest.raises(ValueError):
            m.grid(h, axes, cells)
    with pytest.raises(ValueError):
        m.grid(build(points(spark, [[1.0, 2.0]])[0], ["x", "y"], "2DxF"), [good, good])


def test_boxes_take_true_extents(spark):
    h = hist(spark, [[10.1, 50.1], [20.1, 30.1]])
    r = m.count_boxes(h, [[(5.03, 60.03)] * 2]).first()
    assert r["safe_count"] == r["total_count"] == 2


@pytest.mark.parametrize("dims", [2, 3])
def test_boxes_against_brute_force(spark, dims):
    rows = np.vstack([some(400, dims, 3), [[0.0] * dims, [INF] * dims]])
    h, t = hist(spark, rows.tolist()), bin_table(12)
    pos = t.position[encode_numpy(rows[:400].ravel(), 6)].reshape(400, dims)
    value = t.values[pos]
    wanted = [[(-20.0, 30.0)] * dims, [(-INF, INF)] * dims, [(0.5, 1.5)] * dims, [(1000.0, 2000.0)] * dims]
    for r, box in zip(m.count_boxes(h, wanted).orderBy("box_id").collect(), wanted):
        low, high = np.array(box).T
        safe = ((value >= low) & (value <= high)).all(axis=1)
        assert r["safe_count"] == safe.sum()
        if safe.any():
            lo, hi = pos[safe].min(axis=0) - 1, pos[safe].max(axis=0) + 1
            assert r["total_count"] == ((pos >= lo) & (pos <= hi)).all(axis=1).sum()
            assert r["safe_x_min"] == value[safe][:, 0].min()
        else:
            assert r["total_count"] == 0 and r["safe_x_min"] is None


def test_boundaries_of_specials(spark):
    h = hist(spark, [[INF, 0.0], [NAN, -INF], [-2.5, 3.0]])
    rows = {str((r["x_min"], r["x_max"], r["y_min"], r["y_max"])): r["counts"] for r in m.boundaries(h).collect()}
    assert str((INF, INF, 0.0, 0.0)) in rows and str((NAN, NAN, -INF, -INF)) in rows and len(rows) == 3
    assert h.specials().first().asDict() == {"pos_inf": 1, "neg_inf": 1, "pos_zero": 1, "neg_zero": 0, "nan": 1}
    assert h.trie_count().first()[0] == 3


@pytest.mark.parametrize("layout", ["2DxF", "3DxF", "4DxF", "2DxP"])
def test_merge_is_a_true_sum(spark, layout):
    dims = int(layout[0])
    a, b = some(60, dims, 1).tolist(), (-some(60, dims, 2)).tolist()
    rows = lambda h: sorted(map(str, h.df.select(*h.keys, "count").collect()))
    assert rows(merge([hist(spark, a, layout), hist(spark, b, layout)])) == rows(hist(spark, a + b, layout))
