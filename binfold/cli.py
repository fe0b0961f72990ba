"""python -m binfold.cli generate|query|merge|export ..."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from binfold.operators import many_axes, one_axis
from binfold.operators.histogram import Histogram, build, merge
from binfold.operators.many_axes import LINEAR, MULTIPLICATIVE, Axis
from binfold.sources import readers, tables, wire

_SCALES = {"linear": LINEAR, "mult": MULTIPLICATIVE, "multiplicative": MULTIPLICATIVE}


def parse_axis(text: str) -> Axis:
    """min:max:steps, or min:max:steps:linear|mult|multiplicative."""
    parts = text.split(":")
    if len(parts) not in (3, 4):
        raise ValueError(f"{text!r} isn't min:max:steps or min:max:steps:scaling")
    try:
        low, high, steps = float(parts[0]), float(parts[1]), int(parts[2])
    except ValueError:
        raise ValueError(f"{text!r} has a number with something behind it, or none") from None
    scale = parts[3].lower() if len(parts) == 4 else "linear"
    if scale not in _SCALES:
        raise ValueError(f"{text!r}: scaling is linear, mult or multiplicative")
    axis = Axis(low, high, steps, _SCALES[scale])
    axis.check()
    return axis


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="binfold")
    what = top.add_subparsers(dest="what", required=True)
    generate = what.add_parser("generate").add_subparsers(dest="kind", required=True)
    for kind in ("parquet", "csv", "binary"):
        p = generate.add_parser(kind)
        p.add_argument("input")
        p.add_argument("output")
        p.add_argument("-s", "--schema", required=True)
        p.add_argument("--binary", action="store_true", help="write the binary form, one local file")
        if kind == "binary":
            p.add_argument("-d", "--data-type", required=True, choices=list(readers.PACKED))
        else:
            p.add_argument("-c", "--columns", nargs="+", required=True)
    query = what.add_parser("query").add_subparsers(dest="kind", required=True)
    for kind in ("topk", "min_count", "max_count", "min_value", "max_value", "percentile", "cdf", "grid", "bbox"):
        p = query.add_parser(kind)
        p.add_argument("histogram")
        p.add_argument("output", nargs="?")
        if kind == "topk":
            p.add_argument("-k", type=float, required=True)
        elif kind == "percentile":
            p.add_argument("-p", type=float, nargs="+", required=True)
        elif kind == "cdf":
            p.add_argument("-v", type=float, nargs="+", required=True)
            p.add_argument("--interpolate", action="store_true")
        elif kind == "grid":
            p.add_argument("-a", "--axis", action="append", required=True)
            p.add_argument("--max-cells", type=int, default=1_000_000)
        elif kind == "bbox":
            p.add_argument("-b", "--bound", action="append", required=True, help="min:max of an axis")
    p = what.add_parser("merge")
    p.add_argument("inputs", nargs="+")
    p.add_argument("output")
    p.add_argument("--binary", action="store_true", help="write the binary form, one local file")
    p = what.add_parser("export")
    p.add_argument("histogram")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--format", choices=["parquet", "csv", "arrow"], default="parquet")
    return top


def _is_binary(path: str) -> bool:
    """A local file in the binary form."""
    if not os.path.isfile(path):
        return False
    with open(path, "rb") as source:
        return source.read(len(wire.MAGIC)) == wire.MAGIC


def _stored(spark: SparkSession, path: str) -> Histogram:
    return wire.read(spark, path) if _is_binary(path) else tables.read_histogram(spark, path)


def _store(hist: Histogram, path: str, binary: bool) -> None:
    if binary:
        wire.write(hist, path)
    else:
        tables.write_histogram(hist, path)


def _merged(spark: SparkSession, paths: list[str]) -> Histogram:
    """All tables in one read, and the binary files."""
    files = [p for p in paths if _is_binary(p)]
    others = [p for p in paths if p not in files]
    return merge([*(wire.read(spark, p) for p in files), *([tables.merge_stored(spark, others)] if others else [])])


def _answer(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    axes = [parse_axis(a) for a in args.axis] if args.kind == "grid" else []  # before anything is read
    hist = _stored(spark, args.histogram)
    if args.kind == "topk":
        return one_axis.top_k(hist, args.k).orderBy("ord", ascending=False).drop("ord")
    if args.kind == "percentile":
        return one_axis.percentile(hist, args.p).orderBy("percentile").select("percentile", "value")
    if args.kind == "cdf":
        return one_axis.cdf(hist, args.v, args.interpolate).orderBy("at")
    if args.kind == "grid":
        return many_axes.grid(hist, axes, args.max_cells).orderBy("cell").drop("cell")
    if args.kind == "bbox":
        return many_axes.count_boxes(hist, [[tuple(map(float, b.split(":"))) for b in args.bound]])
    rows = getattr(one_axis, args.kind)(hist)
    return rows.orderBy(*(["special"] if "special" in rows.columns else []), "ord", ascending=[False, True] if "special" in rows.columns else True).select("lower", "upper", "count")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("binfold").getOrCreate()
    try:
        if args.what == "generate":
            df = readers.read(spark, args.input, args.kind, getattr(args, "columns", ()), getattr(args, "data_type", None))
            _store(build(df, df.columns, args.schema), args.output, args.binary)
        elif args.what == "merge":
            _store(_merged(spark, args.inputs), args.output, args.binary)
        elif args.what == "export":
            tables.export(_stored(spark, args.histogram), args.output, args.format)
        elif args.output:
            tables.write_result(_answer(spark, args), args.output)
        else:
            df = _answer(spark, args)
            print(",".join(df.columns))
            for row in df.toLocalIterator():
                print(",".join(map(str, row)))
    except (ValueError, TypeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
