import math

import numpy as np
import pytest

from binfold.functions.codec import bin_table, encode_numpy
from binfold.operators import one_axis as q
from binfold.operators.histogram import Histogram, build, merge

INF, NAN = math.inf, math.nan
SALES = [13.75, 9.5, 312.1, 145.02, 67.26, 8.0, 55.751, 89.99, 210.51, 4.25, 22.0, 13.0]


def hist(spark, values, layout="1DxF"):
    return build(spark.createDataFrame([(v,) for v in values], "x double"), "x", layout)


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_published_percentiles(spark):
    p = q.percentile(hist(spark, [0.0] * 4 + [1.0] * 3), [50, 60, 80, 0, 101]).orderBy("percentile")
    assert values(p, "value") == [(-INF,), (0.0,), (1.0000020345052083,), (1.0000162760416667,), (-INF,)]
    p = q.percentile(hist(spark, [-INF] * 2 + [1.0] * 3 + [INF] * 2), [10, 50, 90]).orderBy("percentile")
    assert values(p, "value") == [(-INF,), (1.0000152587890625,), (INF,)]
    assert values(q.percentile(hist(spark, [NAN, NAN, NAN, 1.0, 2.0, 3.0, 4.0, 5.0]), [50]), "value") == [(3.0009765625,)]


def test_published_cdf_of_specials(spark):
    h = hist(spark, sum(([v] * 5 for v in (-INF, -0.0, 0.0, INF, NAN)), []))
    assert values(q.cdf(h, [-INF, -0.0, 0.0, INF]), "cdf") == [(0.25,), (0.5,), (0.75,), (1.0,)]


def test_empty(spark):
    h = hist(spark, [None, NAN])
    assert values(q.percentile(h, [50]), "value", "lower") == [(-INF, -INF)]
    assert values(q.cdf(h, [1.0]), "cdf") == [(0.0,)]
    for f in (q.min_count, q.max_count, q.min_value, q.max_value, lambda x: q.top_k(x, 10)):
        assert f(h).collect() == []


def test_top_k_is_a_tail_by_mass(spark):
    h = hist(spark, SALES, "1DxP")
    top = values(q.top_k(h, 25).orderBy("ord", ascending=False), "lower", "upper", "count")
    assert top == [(312.0, 312.125, 1), (210.5, 210.53125, 1), (145.0, 145.03125, 1)]
    h = hist(spark, [INF, -INF, 0.0, -0.0, 2.0, -2.0, NAN])
    assert values(q.top_k(h, 100).orderBy("ord", ascending=False), "lower", "count") == [(INF, 1), (2.0, 1), (0.0, 1), (-0.0, 1), (-2.0, 1), (-INF, 1)]
    for k in (0, -1, 100.5):
        with pytest.raises(ValueError):
            q.top_k(h, k)


def test_extremes(spark):
    h = hist(spark, [-0.0, 0.0, 0.0, 3.0, 3.0, -7.0])
    assert values(q.min_count(h).orderBy("special", "ord"), "lower", "count") == [(bin_table(16).values[bin_table(16).position[encode_numpy(np.array([-7.0]), 10)[0]]], 1), (-0.0, 1)]
    assert values(q.max_count(h).orderBy("ord"), "lower") == [(0.0,), (3.0,)]
    assert values(q.min_value(h), "count") == [(1,)] and values(q.max_value(h), "lower") == [(3.0,)]
    zero = hist(spark, [-0.0, 0.0])
    assert math.copysign(1, q.min_value(zero).first()["lower"]) == -1 and math.copysign(1, q.max_value(zero).first()["lower"]) == 1


@pytest.mark.parametrize("layout", ["1DxT", "1DxF", "1DxP"])
def test_percentiles_against_a_plain_walk(spark, layout):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=300) * 50, [0.0, -0.0, INF, -INF, -INF]])
    h = hist(spark, [float(v) for v in x], layout)
    t = bin_table(h.config.bits)
    finite = x[np.isfinite(x) & (x != 0)]
    pos, counts = np.unique(t.position[encode_numpy(finite, h.config.precision)], return_counts=True)
    rows = [(-INF, 2, None)] + [(t.values[p], c, p) for p, c in zip(pos, counts) if t.values[p] < 0] + [(-0.0, 1, None), (0.0, 1, None)] + [(t.values[p], c, p) for p, c in zip(pos, counts) if t.values[p] > 0] + [(INF, 1, None)]

    def walk(percent):
        rank, cum = percent / 100 * len(x), 0
        if rank <= 0:
            return -INF
        for v, c, p in rows:
            if cum + c >= rank:
                return v if p is None or p == len(t) - 1 else v + (rank - cum) / c * (t.next[p] - v)
            cum += c
        return -INF

    ps = [0.0, 0.1, 1, 10, 33.3, 50, 66, 90, 99, 99.9, 100]
    got = q.percentile(h, ps).orderBy("percentile")
    assert values(got, "value") == [(walk(p),) for p in ps]


def test_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), (None, 7.0), (None, 7.0)], "g string, x double")
    h = build(df, "x", "1DxP", ["g"])
    assert sorted(values(q.max_value(h), "g", "lower"), key=str) == [("a", 2.0), ("b", 5.0), (None, 7.0)]
    assert {g: v for g, v in values(q.percentile(h, [100]), "g", "lower")} == {"a": 2.0, "b": 5.0, None: 7.0}


def test_merge_laws(spark):
    rng = np.random.default_rng(4)
    parts = [[float(v) for v in rng.normal(size=50)] + [0.0, -0.0, INF, NAN] for _ in range(5)]
    whole = hist(spark, sum(parts, []))
    each = [hist(spark, p) for p in parts]
    rows = lambda h: sorted(map(tuple, h.df.select("kind", "code", "count").collect()), key=str)
    assert rows(merge(each)) == rows(whole) == rows(merge([merge(each[:2]), merge(each[2:])]))
    assert merge(each[:1]) is each[0]
    assert whole.trie_count().first()[0] == 250
    assert whole.specials().first().asDict() == {"pos_inf": 5, "neg_inf": 0, "pos_zero": 5, "neg_zero": 5, "nan": 5}
    with pytest.raises(ValueError):
        merge([])
    with pytest.raises(ValueError):
        merge([each[0], hist(spark, [1.0], "1DxT")])


def test_columns_are_checked(spark):
    df = spark.createDataFrame([("a", 1, 2.5)], "s string, i int, d double")
    assert isinstance(build(df, "i", "1DxP"), Histogram)
    for columns, layout, error in ((["s"], "1DxP", TypeError), (["none"], "1DxP", TypeError), (["i"], "2DxP", ValueError), (["i"], "5DxP", ValueError)):
        with pytest.raises(error):
            build(df, columns, layout)
