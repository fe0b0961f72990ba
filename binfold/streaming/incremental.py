"""Histograms of a stream: one for each window, kept up to date as rows arrive.

The stream's rows become bins and are counted by (window, bin): the state is a count for each
populated bin of each open window. Windows close behind the watermark; a row that comes later
is left out. Stored windows merge on read into the histogram of any span.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binfold.functions.configs import Config, config
from binfold.operators.histogram import Histogram, bin_columns


def windowed(stream: DataFrame, columns: Sequence[str], layout: str | Config, time_col: str, window: str, late: str, by: Sequence[str] = ()) -> DataFrame:
    """window_start, window_end, group columns, bin, count: for append or update mode."""
    layout = config(layout)
    keep = [time_col, *by]
    # a watermark takes a timestamp with a zone
    bins = bin_columns(stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late), columns, layout, keep)
    keys = [c for c in bins.columns if c != time_col]
    return bins.groupBy(F.window(time_col, window).alias("_w"), *keys).count().select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, "count")


def over_span(stored: DataFrame, layout: str | Config, start: str | None = None, end: str | None = None, by: Sequence[str] = ()) -> Histogram:
    """The histogram of the stored windows that begin in [start, end)."""
    layout = config(layout)
    tests = [F.col("window_start") >= F.lit(start).cast("timestamp")] * (start is not None) + [F.col("window_start") < F.lit(end).cast("timestamp")] * (end is not None)
    rows = stored.where(reduce(lambda a, b: a & b, tests)) if tests else stored
    empty = Histogram(layout, rows, tuple(by))
    return Histogram(layout, rows.groupBy(*empty.keys).agg(F.sum("count").alias("count")), tuple(by))
