"""Histograms as tables, and exports of their populated bins.

A histogram is stored as Parquet; its layout and group columns are in the table's first file
metadata, as column comments. Exports of one file go through the driver row group by row group;
a distributed export is boundaries(hist).write.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binfold.functions.configs import config
from binfold.operators.histogram import AXES, Histogram
from binfold.operators.many_axes import boundaries

_MARK, _LAYOUT = "histogram", "_layout"
ROW_GROUP = 1024


def write_histogram(hist: Histogram, path: str) -> None:
    """One row for each populated bin. The layout is a column too: of one value, so it takes no room."""
    mark = {_MARK: json.dumps({"layout": hist.config.name, "by": list(hist.by)})}
    hist.df.withMetadata("count", mark).withColumn(_LAYOUT, F.lit(hist.config.name)).write.mode("overwrite").parquet(path)


def _stored(df: DataFrame, path: str) -> Histogram:
    known = df.schema["count"].metadata.get(_MARK) if "count" in df.columns else None
    if not known:
        raise ValueError(f"{path} holds no histogram")
    known = json.loads(known)
    return Histogram(config(known["layout"]), df.drop(_LAYOUT), tuple(known["by"]))


def read_histogram(spark: SparkSession, path: str) -> Histogram:
    return _stored(spark.read.parquet(path), path)


def merge_stored(spark: SparkSession, paths: Sequence[str]) -> Histogram:
    """The sum of stored histograms of one layout, any number of them: one read of all paths and one aggregation.

    Whether the layouts agree is told from their least and greatest name, which Parquet keeps
    with its row groups.
    """
    if not paths:
        raise ValueError("nothing to merge")
    df = spark.read.parquet(*paths)
    first = _stored(df, paths[0])
    if _LAYOUT in df.columns:
        least, most = df.agg(F.min(_LAYOUT), F.max(_LAYOUT)).first()
        if least is not None and (least, most) != (first.config.name, first.config.name):
            raise ValueError(f"histograms of {least} and {most} don't merge")
    return Histogram(first.config, first.df.groupBy(*first.keys).agg(F.sum("count").alias("count")), first.by)


def export_rows(hist: Histogram) -> DataFrame:
    """x-min, x-max, y-min, ..., counts, in the order of the bounds."""
    rows = boundaries(hist)
    axes = AXES[: hist.config.dims]
    named = rows.select(*hist.by, *(F.col(f"{a}_{e}").alias(f"{a}-{e}") for a in axes for e in ("min", "max")), "counts")
    return named.orderBy(*hist.by, *(F.col(f"`{a}-min`") for a in axes))


def special_counts(hist: Histogram) -> dict[str, int]:
    """Counts by name: +Inf, -Inf, +0, NaN, and -0 in one dimension."""
    r = hist.specials().first()
    got = r.asDict() if r else {}
    names = {"+Inf": "pos_inf", "-Inf": "neg_inf", "+0": "pos_zero", "NaN": "nan"} | ({"-0": "neg_zero"} if hist.config.dims == 1 else {})
    return {k: int(got.get(v) or 0) for k, v in names.items()}


def _batches(hist: Histogram) -> Iterator[pa.RecordBatch]:
    rows = export_rows(hist)
    schema = pa.schema([(f.name, pa.int64() if f.name == "counts" else pa.float64()) for f in rows.schema])
    part: list = []
    for r in rows.toLocalIterator(prefetchPartitions=True):
        part.append(tuple(r))
        if len(part) == ROW_GROUP:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)
            part = []
    columns = list(zip(*part)) if part else [[] for _ in schema]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def export(hist: Histogram, path: str, kind: str = "parquet") -> None:
    """One local file: parquet or arrow with the special counts as metadata, or csv with them in comment lines."""
    if hist.by:
        raise ValueError("a file holds one histogram, not groups of them")
    specials = special_counts(hist)
    batches = _batches(hist)
    first = next(batches)
    schema = first.schema.with_metadata({k: str(v) for k, v in specials.items()})

    def every() -> Iterator[pa.RecordBatch]:
        yield first.replace_schema_metadata(schema.metadata)
        for b in batches:
            yield b.replace_schema_metadata(schema.metadata)

    if kind == "parquet":
        with pq.ParquetWriter(path, schema) as out:
            for b in every():
                if b.num_rows:
                    out.write_batch(b)
    elif kind == "arrow":
        with pa.ipc.new_file(path, schema) as out:
            for b in every():
                out.write_batch(b)
    elif kind == "csv":
        with open(path, "w") as out:
            out.write("# Special Value Counts\n" + "".join(f"# {k}: {v}\n" for k, v in specials.items()))
            out.write(",".join(schema.names) + "\n")
            for b in every():
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    out.write(",".join(map(repr, row)) + "\n")
    else:
        raise ValueError(f"kind {kind!r}; there are parquet, csv, arrow")


def write_result(df: DataFrame, path: str) -> None:
    """A query's result as one local CSV file with a header; doubles keep all their digits."""
    with open(path, "w") as out:
        out.write(",".join(df.columns) + "\n")
        for row in df.toLocalIterator():
            out.write(",".join("" if v is None else repr(v) if isinstance(v, float) else str(v) for v in row) + "\n")
