"""The partitions of an axis, held against their definition bin by bin; groups; probes."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from binfold.functions.codec import bin_table
from binfold.operators import many_axes as m
from binfold.operators import one_axis
from binfold.operators.histogram import build

INF = math.inf
NUMBERS = st.one_of(st.just(0.0), st.floats(-1e6, 1e6), st.floats(-1e-3, 1e-3), st.sampled_from([-INF, INF, 1e300, -1e300]))


@settings(max_examples=150, deadline=None)
@given(NUMBERS, NUMBERS, st.integers(1, 9), st.booleans())
def test_partitions_by_their_definition(a, b, steps, has_data):
    low, high = min(a, b), max(a, b)
    extent = (-7.5, 300.0) if has_data else None
    parts, zero = m.axis_parts(m.Axis(low, high, steps), extent)
    t, rows = bin_table(12), list(parts.itertuples())
    assert [r.kind for r in rows].count("neg_inf") == (low == -INF) and [r.kind for r in rows].count("pos_inf") == (high == INF)
    if (low == -INF or high == INF) and not has_data:
        assert all(r.kind != "finite" for r in rows) and zero is None
        return
    low, high = (extent[0] if low == -INF else low), (extent[1] if high == INF else high)
    if low > high:
        assert zero is None
        return
    # every bin that the range touches is in one partition, in order, and no other is
    inside = [r for r in rows if r.first is not None and r.first == r.first]
    bins = [i for r in inside for i in range(int(r.first), int(r.last) + 1)]
    touched = [i for i in range(len(t)) if (t.upper[i] > low and t.lower[i] <= high if t.values[i] >= 0 else t.upper[i] >= low and t.lower[i] < high)]
    assert bins == touched
    for r in inside:
        assert r.start == t.lower[int(r.first)] and r.end == t.upper[int(r.last)]
        out = r.start < low or r.end > high
        assert r.is_edge == out and (not out or r.first == r.last)
    assert sum(not r.is_edge for r in inside) <= steps
    # zeros have a place if the range has 0: what starts there, else what holds it, else one of their own
    assert (zero is None) == (not low <= 0 <= high)
    if zero is not None:
        starts = [i for i, r in enumerate(rows) if r.kind == "finite" and r.start == 0]
        holds = [i for i, r in enumerate(rows) if r.kind == "finite" and (r.start < 0 or r.start == 0 and r.start_inclusive) and (r.end > 0 or r.end == 0 and r.end_inclusive)]
        assert zero == (starts or holds)[0]


@pytest.mark.parametrize("axis", [(0, 1, 0), (2, 1, 3), (math.nan, 1, 1), (0, math.nan, 1), (0, 1, 3, "other"), (-1, 5, 3, m.MULTIPLICATIVE), (3, 3, 2, m.MULTIPLICATIVE)])
def test_axes_that_cant_be(axis):
    with pytest.raises(ValueError, match="can't have"):
        m.Axis(*axis).check()


def test_infinite_multiplicative_ends_need_positive_data():
    assert len(m.axis_parts(m.Axis(-INF, INF, 4, m.MULTIPLICATIVE), (1.0, 100.0))[0]) >= 5
    for extent in ((0.0, 5.0), (-1.0, 5.0), None):
        with pytest.raises(ValueError):
            m.axis_parts(m.Axis(-INF, INF, 4, m.MULTIPLICATIVE), extent)


def test_specials_have_cells_of_their_own(spark):
    rows = [(INF, 1.0), (-INF, 1.0), (0.0, 1.0), (math.nan, 1.0), (2.0, -INF), (2.0, 1.0), (2.0, 0.0)]
    h = build(spark.createDataFrame(rows, "x double, y double"), ["x", "y"], "2DxP")
    got = [r for r in m.grid(h, [m.Axis(-INF, INF, 2), m.Axis(-INF, INF, 1)]).collect() if r["count"]]
    kinds = sorted((r["x_kind"], r["y_kind"], r["count"]) for r in got)
    assert sum(c for *_, c in kinds) == 6  # all but the one with NaN
    assert ("neg_inf", "finite", 1) in kinds and ("pos_inf", "finite", 1) in kinds and ("finite", "neg_inf", 1) in kinds


def test_grids_and_boxes_of_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), *map(float, rng.normal(size=2) * [20, 3])) for g in range(3) for _ in range(80)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    both, axes, box = build(df, ["x", "y"], "2DxP", by=["g"]), [m.Axis(-30, 30, 4), m.Axis(-INF, INF, 3)], [[(-15.0, 25.0), (-2.0, 4.0)], [(100.0, 200.0)] * 2]
    grids, boxes = m.grid(both, axes).collect(), m.count_boxes(both, box).collect()
    for g in range(3):
        one = build(df.where(f"g = {g}"), ["x", "y"], "2DxP")
        mine = {(r["x_start"], r["y_start"]): r["count"] for r in grids if r["g"] == g}
        if g == 0:  # the extent is that of all groups, so partitions are compared over their sums
            assert sum(mine.values()) <= 80 and all(mine.values())
        r, want = [r for r in boxes if r["g"] == g], m.count_boxes(one, box[:1]).first()
        assert len(r) == 1 and all(r[0][c] == want[c] for c in want.asDict())
    finite = [m.Axis(-30, 30, 4), m.Axis(-3, 5, 3)]
    for g in range(3):
        one = {(r["x_start"], r["y_start"]): r["count"] for r in m.grid(build(df.where(f"g = {g}"), ["x", "y"], "2DxP"), finite).collect() if r["count"]}
        assert one == {(r["x_start"], r["y_start"]): r["count"] for r in m.grid(both, finite).where(f"g = {g}").collect()}


def test_boxes_of_all_sizes_in_one_table(spark):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(300, 3)) * [1000, 1, 0.01]
    h = build(spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double, z double"), ["x", "y", "z"], "3DxP")
    boxes = [(i, *(v for a in range(3) for v in sorted(map(float, rng.choice(points[:, a], 2))))) for i in range(25)] + [(25, *([-1e9, 1e9] * 3))]
    frame = spark.createDataFrame(boxes, "box_id long, x_min double, x_max double, y_min double, y_max double, z_min double, z_max double")
    got = {r["box_id"]: r["safe_count"] for r in m.count_boxes(h, frame).collect()}
    assert got == {r["box_id"]: r["safe_count"] for r in m.count_boxes(h, [[(b[1], b[2]), (b[3], b[4]), (b[5], b[6])] for b in boxes]).collect()}
    assert got[25] == 300


def test_probes_by_group_against_single_histograms(spark):
    rng = np.random.default_rng(8)
    rows = [(g, v) for g in range(3) for v in [*rng.normal(size=40).tolist(), *([0.0, -0.0, INF, -INF] if g else []), 5e-324]]
    df = spark.createDataFrame([*rows, (9, math.nan)], "g int, v double")
    ps, vs = [0, 0.5, 33, 50, 100, 101], [-INF, -1.0, -0.0, 0.0, 5e-324, 0.3, 7.0, INF]
    percentiles, shares = one_axis.percentile(build(df, "v", "1DxF", by=["g"]), ps).collect(), one_axis.cdf(build(df, "v", "1DxF", by=["g"]), vs, True).collect()
    for g in range(3):
        one = build(df.where(f"g = {g}"), "v", "1DxF")
        assert sorted((r["percentile"], r["value"], r["lower"]) for r in percentiles if r["g"] == g) == sorted((r["percentile"], r["value"], r["lower"]) for r in one_axis.percentile(one, ps).collect())
        assert sorted((str(r["at"]), r["cdf"]) for r in shares if r["g"] == g) == sorted((str(r["at"]), r["cdf"]) for r in one_axis.cdf(one, vs, True).collect())
    got = {str(r["at"]): r["cdf"] for r in one_axis.cdf(build(df.where("g = 1"), "v", "1DxF"), vs).collect()}
    assert got["-inf"] == 1 / 45 and got["inf"] == 1 and abs(got["0.0"] - got["-0.0"] - 1 / 45) < 1e-12
