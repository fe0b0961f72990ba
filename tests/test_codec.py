import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from binfold.functions import codec
from binfold.functions.configs import BY_WIRE, CONFIGS, config, for_kind
from binfold.operators.histogram import bin_columns

WIDTHS = [12, 13, 16, 20]


@pytest.mark.parametrize("bits", WIDTHS)
def test_all_codes_come_back(bits):
    codes = np.arange(1 << bits)
    values = codec.start_values(codes, bits)
    # deep exponents lose bits to the field's end
    usual = (np.abs(values) < 2.0**128) & (np.abs(values) > 2.0**-128)
    assert (codec.encode_numpy(values[usual], bits - 6) == codes[usual]).all()


@pytest.mark.parametrize("bits", WIDTHS)
@settings(max_examples=300, deadline=None)
@given(x=st.floats(2.0**-127, 2.0**127) | st.floats(-(2.0**127), -(2.0**-127)))
def test_native_interval_holds_the_value(bits, x):
    t = codec.bin_table(bits)
    pos = int(t.position[codec.encode_numpy(np.array([x]), bits - 6)[0]])
    assert t.lower[pos] <= x < t.upper[pos] if x > 0 else t.lower[pos] < x <= t.upper[pos]


@pytest.mark.parametrize("bits", WIDTHS)
def test_table_is_in_order(bits):
    t = codec.bin_table(bits)
    assert (np.diff(t.values) >= 0).all() and (t.code_at[t.position] == np.arange(len(t))).all()
    assert t.index(1.0) == int(t.position[codec.encode_numpy(np.array([1.0]), bits - 6)[0]])
    assert t.index(float("inf")) == len(t) - 1


@pytest.mark.parametrize("layout", ["1DxT", "1DxF", "1DxP", "2DxP"])
def test_columns_agree_with_numpy(spark, layout):
    rng = np.random.default_rng(5)
    edges = 2.0 ** rng.integers(-1000, 1000, 100)
    x = np.concatenate([rng.integers(1, 0x7FF << 52, 500).view(np.float64), edges, np.nextafter(edges, 0), [5e-324, 1.0, 1.5, 2.0, 0.5]])
    x = np.concatenate([x, -x])
    k = config(layout)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").coalesce(1)
    got = bin_columns(df, ["x"] * k.dims, k, ["i"]).orderBy("i").toPandas()
    assert (got["code" if k.dims == 1 else "code_x"].to_numpy() == codec.encode_numpy(x, k.precision)).all()


def test_fast_layouts_put_one_to_two_in_the_last_field(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 1.25, 1.999, -1.5)], "x double")
    codes = [r["code_x"] for r in bin_columns(df, ["x", "x"], config("2DxF")).collect()]
    assert {c & 255 for c in codes} == {31} and sorted({c >> 8 for c in codes}) == [0, 2]


def test_layouts():
    assert len(CONFIGS) == len(BY_WIRE) == 9
    assert for_kind(3, "P").name == "3DxP" and config("1DxP").bits == 20 and config("4DxF").bits == 10
    with pytest.raises(ValueError):
        for_kind(2, "T")
