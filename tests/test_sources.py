import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from binfold import cli
from binfold.operators.histogram import build
from binfold.sources import readers, tables, wire

INF, NAN = math.inf, math.nan


def rows(h):
    return sorted(str(tuple(r)) for r in h.df.select(*h.keys, "count").collect())


def test_binary_and_arrays(spark, tmp_path):
    for kind, (code, _) in readers.PACKED.items():
        np.arange(10).astype(code).tofile(tmp_path / f"{kind}.bin")
        got = readers.read(spark, str(tmp_path / f"{kind}.bin"), "binary", data_type=kind)
        assert sorted(r[0] for r in got.collect()) == list(range(10))
    (tmp_path / "bad.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="multiple"):
        readers.read_binary(spark, str(tmp_path / "bad.bin"), "double").count()
    np.savez(tmp_path / "a.npz", p=np.arange(3.0), q=np.arange(3))
    assert readers.read_npy(spark, str(tmp_path / "a.npz")).dtypes == [("x", "double"), ("y", "bigint")]
    with pytest.raises(ValueError):
        readers.from_arrays(spark, [1.0], [1.0, 2.0])


def test_csv_and_parquet(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,2.5,x\n3,,y\n")
    got = readers.read(spark, str(tmp_path / "a.csv"), "csv", ["a", "b"])
    assert got.dtypes == [("a", "int"), ("b", "double")]
    assert build(got, ["a", "b"], "2DxP").trie_count().first()[0] == 1  # a null axis leaves the row out
    pq.write_table(pa.table({"a": [1, 2], "s": ["x", "y"]}), tmp_path / "a.parquet")
    assert readers.read(spark, str(tmp_path / "a.parquet"), "parquet", ["a"]).count() == 2
    for columns, error in ((["s"], TypeError), (["none"], ValueError), ([], ValueError)):
        with pytest.raises(error):
            readers.read(spark, str(tmp_path / "a.parquet"), "parquet", columns)
    plan = readers.read_parquet(spark, str(tmp_path / "a.parquet"), ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:bigint>" in plan


@pytest.mark.parametrize("layout", ["1DxT", "1DxF", "1DxP", "2DxP", "3DxP", "4DxP"])
def test_wire_round_trip(spark, tmp_path, layout):
    dims, rng = int(layout[0]), np.random.default_rng(2)
    x = rng.normal(size=(120, dims)) * 40
    x[:4] = [[0.0] * dims, [INF] * dims, [-INF] + [1.0] * (dims - 1), [NAN] * dims]
    names = list("xyzw"[:dims])
    h = build(spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names)), names, layout)
    path = str(tmp_path / "h.bin")
    wire.write(h, path)
    data = open(path, "rb").read()
    head = wire.header(data)
    assert head["payload_length"] == len(data) - 49 and head["config"] == h.config.wire
    assert head["observations"] == h.trie_count().first()[0]
    assert rows(wire.read(spark, path)) == rows(h)
    for bad in (data[:30], b"X" + data[1:], data[:20] + b"\xff" + data[21:], data[:-1]):
        with pytest.raises(ValueError):
            wire.decode(bad)
    with pytest.raises(ValueError):
        wire.encode(h.config, [{**h.df.first().asDict(), "count": 1 << 32}])


def test_tables_and_exports(spark, tmp_path):
    h = build(spark.createDataFrame([(v,) for v in (1.0, 1.0, -2.0, 0.0, -0.0, INF, NAN)], "x double"), "x", "1DxP")
    tables.write_histogram(h, str(tmp_path / "h"))
    back = tables.read_histogram(spark, str(tmp_path / "h"))
    assert back.config == h.config and rows(back) == rows(h)
    for kind in ("parquet", "arrow", "csv"):
        tables.export(h, str(tmp_path / f"o.{kind}"), kind)
    t = pq.read_table(tmp_path / "o.parquet")
    assert t.column_names == ["x-min", "x-max", "counts"] and sum(t["counts"].to_pylist()) == 3
    assert {k: int(v) for k, v in t.schema.metadata.items() if not k.startswith(b"ARROW")} == {b"+Inf": 1, b"-Inf": 0, b"+0": 1, b"-0": 1, b"NaN": 1}
    assert pa.ipc.open_file(str(tmp_path / "o.arrow")).read_all().equals(t)
    text = (tmp_path / "o.csv").read_text().splitlines()
    assert text[0] == "# Special Value Counts" and text[6] == "x-min,x-max,counts" and len(text) == 9
    with pytest.raises(ValueError):
        tables.export(h, str(tmp_path / "o.x"), "x")
    with pytest.raises(ValueError):
        tables.read_histogram(spark, str(tmp_path / "o.parquet"))


@pytest.mark.parametrize("text", ["1:2", "1:2:3:4:5", "1:2x:3", "1:2:3:cube", "2:1:3", "0:1:3:mult", "1:2:0"])
def test_axes_that_are_refused(text):
    with pytest.raises(ValueError):
        cli.parse_axis(text)


def test_command_line(spark, tmp_path, capsys):
    pq.write_table(pa.table({"a": [1.0, 2.0, 3.0, 50.0], "b": [1, 2, 3, 4]}), tmp_path / "in.parquet")
    path = lambda n: str(tmp_path / n)
    run = lambda *a: cli.main(list(a), spark)
    assert run("generate", "parquet", path("in.parquet"), path("one"), "-s", "1DxP", "-c", "a") == 0
    assert run("generate", "parquet", path("in.parquet"), path("two"), "-s", "2DxP", "-c", "a", "b") == 0
    assert run("merge", path("one"), path("one"), path("sum")) == 0
    assert run("query", "percentile", path("sum"), path("p.csv"), "-p", "50", "100") == 0
    assert (tmp_path / "p.csv").read_text().splitlines()[0] == "percentile,value"
    assert run("query", "topk", path("sum"), path("t.csv"), "-k", "25") == 0
    assert (tmp_path / "t.csv").read_text().splitlines() == ["lower,upper,count", "50.0,50.0078125,2"]
    for kind in ("min_count", "max_count", "min_value", "max_value"):
        assert run("query", kind, path("sum")) == 0
    assert run("query", "cdf", path("sum"), "-v", "2.5", "--interpolate") == 0
    assert run("query", "grid", path("two"), "-a", "0:100:2", "-a", "1:4:2:mult") == 0
    assert run("query", "bbox", path("two"), "-b", "0:10", "-b", "0:10") == 0
    assert run("export", path("two"), "-o", path("e.csv"), "--format", "csv") == 0
    assert "x_start" in capsys.readouterr().out
    assert run("query", "grid", path("two"), "-a", "0:100:2") == 1
