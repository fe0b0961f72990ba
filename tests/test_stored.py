"""Stored histograms: merges by path, the binary form on the command line, packed files in ranges, the shared folder."""

import struct
from types import SimpleNamespace

import numpy as np
import pytest

import binfold
from binfold import cli
from binfold.operators.histogram import build
from binfold.sources import readers, tables, wire, workspace


def rows(h):
    return sorted(map(str, h.df.select(*h.keys, "count").collect()))


@pytest.mark.parametrize("layout", ["1DxF", "2DxF", "4DxP"])
def test_merge_by_path_is_the_whole(spark, tmp_path, layout):
    n = int(layout[0])
    rng = np.random.default_rng(n)
    df = spark.createDataFrame([(i % 6, *map(float, r)) for i, r in enumerate(rng.normal(size=(90, n)).round(1))], "part int, " + ", ".join(f"{c} double" for c in "xyzw"[:n]))
    paths = []
    for i in range(6):
        paths.append(str(tmp_path / f"h{i}"))
        tables.write_histogram(build(df.where(f"part = {i}"), list("xyzw"[:n]), layout), paths[-1])
    whole = build(df, list("xyzw"[:n]), layout)
    assert rows(binfold.merge_stored(spark, paths)) == rows(whole)
    assert rows(tables.read_histogram(spark, paths[0])) == rows(build(df.where("part = 0"), list("xyzw"[:n]), layout))
    with pytest.raises(ValueError):
        tables.merge_stored(spark, [])


def test_layouts_that_differ_dont_merge(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    for layout in ("1DxF", "1DxP"):
        tables.write_histogram(build(df, "x", layout), str(tmp_path / layout))
    with pytest.raises(ValueError, match="don't merge"):
        tables.merge_stored(spark, [str(tmp_path / "1DxF"), str(tmp_path / "1DxP")])


def test_groups_keep_their_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (1, 3.0)], "g int, x double")
    for i in range(2):
        tables.write_histogram(build(df, "x", "1DxT", by=["g"]), str(tmp_path / str(i)))
    h = tables.merge_stored(spark, [str(tmp_path / "0"), str(tmp_path / "1")])
    assert h.by == ("g",) and {r["count"] for r in h.df.collect()} == {2}


def test_the_command_line_takes_binary_files(spark, tmp_path, capsys):
    spark.createDataFrame([(float(i),) for i in range(50)], "x double").write.parquet(str(tmp_path / "in"))
    a, b, c, d = (str(tmp_path / n) for n in "abcd")
    assert cli.main(["generate", "parquet", str(tmp_path / "in"), a, "-s", "1DxP", "-c", "x", "--binary"], spark) == 0
    assert cli.main(["generate", "parquet", str(tmp_path / "in"), b, "-s", "1DxP", "-c", "x"], spark) == 0
    assert open(a, "rb").read(4) == wire.MAGIC
    assert cli.main(["merge", a, b, c, "--binary"], spark) == 0 and cli.main(["merge", a, b, d], spark) == 0
    answers = []
    for path in (c, d):
        capsys.readouterr()
        assert cli.main(["query", "percentile", path, "-p", "50", "90"], spark) == 0
        answers.append(capsys.readouterr().out)
        assert cli.main(["export", path, "-o", str(tmp_path / "out.csv"), "--format", "csv"], spark) == 0
        answers.append(open(tmp_path / "out.csv").read())
    assert answers[:2] == answers[2:] and "49.0,49.0" in answers[1].replace("49.0009765625", "49.0")


def test_long_packed_files_are_read_in_ranges(spark, tmp_path):
    values = np.arange(1000, dtype="<i4")
    (tmp_path / "a").write_bytes(values.tobytes())
    (tmp_path / "b").write_bytes(values[:10].tobytes())
    df = readers.read_binary(spark, str(tmp_path), "int32", part=64)
    assert sorted(r["value"] for r in df.collect()) == sorted([*values.tolist(), *range(10)])
    (tmp_path / "a").write_bytes(values.tobytes() + b"\0")
    with pytest.raises(Exception, match="multiple"):
        readers.read_binary(spark, str(tmp_path), "int32", part=64).count()


def session(master, folder=None):
    """What the shared folder depends on."""
    conf = SimpleNamespace(get=lambda key, default: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_the_shared_folder_is_the_cluster_s():
    for master in ("local[2]", "yarn"):
        assert workspace.fresh(session(master, "hdfs://somewhere/"), "x").startswith("hdfs://somewhere/x-")
    assert workspace.shared_folder(session("local[2]")).startswith("file:///")
    for master in ("yarn", "spark://a:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            workspace.shared_folder(session(master))


def test_headers_that_cant_be():
    good = wire.encode(binfold.config("1DxT"), [])
    assert wire.decode(good) == (binfold.config("1DxT"), [])
    for bad in (good[:20], b"XXXX" + good[4:], good[:4] + struct.pack("<H", 9) + good[6:], good[:45] + b"\0\0\0\0" + good[49:], good[:-4]):
        with pytest.raises(ValueError):
            wire.decode(bad)
