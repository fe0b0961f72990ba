"""Queries of histograms of two to four axes, and the list of populated bins of any.

An axis's partitions are worked out on the driver, over the 4096 bins of an axis; the histogram
meets them in broadcast tables of at most 4099 rows. Boxes meet cells by buckets of all axes,
as wide as the boxes, so no pair of box and cell is tried that lies in different buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binfold.functions.bins import special_value, with_bins
from binfold.functions.codec import bin_table
from binfold.operators.histogram import AXES, Histogram

BITS = 12
LINEAR, MULTIPLICATIVE = "linear", "multiplicative"


def boundaries(hist: Histogram) -> DataFrame:
    """A row for each populated bin: x_min, x_max, y_min, ..., counts; native intervals.

    One axis: finite bins alone. More: special axes have their value as both bounds.
    """
    if not hist.config.queryable:
        raise ValueError(f"{hist.config.name} can be built and merged, but its bins have no values")
    axes = AXES[: hist.config.dims]
    names = {a: ("kind", "code") if len(axes) == 1 else (f"kind_{a}", f"code_{a}") for a in axes}
    rows = with_bins(hist.df, {f"_{a}": code for a, (_, code) in names.items()}, hist.config.bits, ["pos", "lower", "upper"])
    out = [*hist.by]
    for a, (kind, _) in names.items():
        special = special_value(F.col(kind))
        out += [F.coalesce(special, F.col(f"_{a}_lower")).alias(f"{a}_min"), F.coalesce(special, F.col(f"_{a}_upper")).alias(f"{a}_max")]
    if hist.config.dims == 1:
        rows = rows.where("_x_pos IS NOT NULL")
    return rows.select(*out, F.col("count").alias("counts"))


@dataclass(frozen=True)
class Axis:
    """A range cut into at most `steps` partitions; infinite ends stand for the data's extent and add partitions of their own."""

    min: float
    max: float
    steps: int
    scaling: str = LINEAR

    def check(self) -> None:
        """Raises one error that names all that is wrong."""
        ends = (self.min, self.max)
        ordered = self.min <= self.max  # not so for NaN
        wrong = {
            f"{self.steps} steps": self.steps < 1,
            f"the range {self.min} to {self.max}": not ordered,
            f"the scaling {self.scaling!r}": self.scaling not in (LINEAR, MULTIPLICATIVE),
            f"multiplicative steps from {self.min} to {self.max}": self.scaling == MULTIPLICATIVE and all(map(math.isfinite, ends)) and not _has_ratio(*ends),
        }
        if any(wrong.values()):
            raise ValueError("an axis can't have " + ", or ".join(what for what, bad in wrong.items() if bad))


def _has_ratio(low: float, high: float) -> bool:
    return 0 < low < high < math.inf


#: A partition's row: ends, whether they belong to it, what it is, and its first and last bin (none for a single value).
PART = ["start", "end", "start_inclusive", "end_inclusive", "kind", "is_edge", "first", "last"]
#: Places in the order of an axis: a bin has twice its position, zero stands before the bins from 0 on, infinities outside all.
_BELOW, _ZERO, _ABOVE = -1, (1 << BITS) - 1, 2 << BITS


def step_labels(low: float, high: float, steps: int, scaling: str) -> tuple[np.ndarray, np.ndarray]:
    """Of the bins that a range touches: their positions, and the step of each. An end's bin that sticks out has the step -1, or `steps`."""
    t = bin_table(BITS)
    closed_above = t.values < 0
    touched = np.flatnonzero(np.where(closed_above, (t.upper >= low) & (t.lower < high), (t.upper > low) & (t.lower <= high)))
    out = np.zeros(len(touched), np.int64)
    sticks_out = (t.lower[touched] < low) | (t.upper[touched] > high)
    inner = touched[~sticks_out]
    if steps > 1 and len(inner) > 1:
        places = np.array([t.lower[inner[0]], *t.lower[inner], t.upper[inner[-1]]])
        with np.errstate(all="ignore"):
            if scaling == MULTIPLICATIVE:
                # the scalar function, as numpy's own may differ in the last bit
                places = np.array([math.log(x) for x in (places / places[0]).tolist()])
            step = np.floor((places[1:-1] - places[0]) / (places[-1] - places[0]) * steps)
        out[~sticks_out] = np.clip(np.where(np.isfinite(step), step, 0), 0, steps - 1)
    # what sticks out is the first bin, the last one, or both in one
    out[sticks_out] = np.where(np.arange(len(touched)) == 0, -1, steps)[sticks_out]
    return touched, out


def axis_parts(axis: Axis, extent: tuple[float, float] | None) -> tuple[pd.DataFrame, int | None]:
    """The partitions (PART) in ascending order, and which one takes zeros. extent: least and largest value of the data, for infinite ends.

    A partition is a run of touched bins of one step. All partitions, those of infinities and a
    zero without a home among the bins included, are sorted by their place on the axis.
    """
    t, low, high = bin_table(BITS), axis.min, axis.max
    ends = [(_BELOW, -math.inf, "neg_inf")] * (low == -math.inf) + [(_ABOVE, math.inf, "pos_inf")] * (high == math.inf)
    if ends and extent:
        low, high = extent[0] if low == -math.inf else low, extent[1] if high == math.inf else high
    bounded = low <= high and (extent is not None or not ends)
    if axis.scaling == MULTIPLICATIVE and not (bounded and _has_ratio(low, high)):
        raise ValueError(f"an axis can't have multiplicative steps from {low} to {high}")
    touched, label = step_labels(low, high, axis.steps, axis.scaling) if bounded else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    runs = pd.DataFrame({"bin": touched, "label": label}).groupby("label", sort=False)["bin"].agg(["min", "max"])
    first, last = runs["min"].to_numpy(np.int64), runs["max"].to_numpy(np.int64)
    of_bins = pd.DataFrame({"start": t.lower[first], "end": t.upper[last], "start_inclusive": t.values[first] >= 0, "end_inclusive": t.values[last] < 0, "kind": "finite", "is_edge": ~runs.index.isin(range(axis.steps)), "first": first, "last": last, "place": 2 * first})
    singles = list(ends)
    zero_place = None
    if bounded and low <= 0 <= high:
        from_zero = of_bins["start"] == 0
        around = ((of_bins["start"] < 0) | from_zero & of_bins["start_inclusive"]) & ((of_bins["end"] > 0) | (of_bins["end"] == 0) & of_bins["end_inclusive"])
        homes = of_bins["place"][from_zero if from_zero.any() else around]
        zero_place = int(homes.min()) if len(homes) else _ZERO
        singles += [(_ZERO, 0.0, "finite")] * (not len(homes))
    alone = pd.DataFrame([(v, v, True, True, kind, False, None, None, place) for place, v, kind in singles], columns=[*PART, "place"])
    every = pd.concat([x for x in (of_bins, alone) if len(x)] or [alone]).sort_values("place", kind="stable").reset_index(drop=True)
    return every[PART], None if zero_place is None else int(np.flatnonzero(every["place"] == zero_place)[0])


def _lookup(spark: SparkSession, parts: pd.DataFrame, zero: int | None, name: str) -> DataFrame:
    """(kind, code, partition) of everything that the axis takes: at most 4099 rows."""
    code_at, rows = bin_table(BITS).code_at, []
    for i, part in enumerate(parts.itertuples()):
        if part.kind == "finite":
            rows += [("fin", int(c), i) for c in (code_at[int(part.first) : int(part.last) + 1] if not pd.isna(part.first) else ())]
        else:
            rows.append(("ninf" if part.kind == "neg_inf" else "pinf", -1, i))
    if zero is not None:
        rows.append(("zero", -1, zero))
    return spark.createDataFrame(rows, f"k_{name} string, c_{name} int, part_{name} int")


def _check_nd(hist: Histogram, dims: tuple[int, ...]) -> None:
    if hist.config.dims not in dims or not hist.config.queryable:
        raise ValueError(f"{hist.config.name} doesn't support this query")


def extents(hist: Histogram) -> list[tuple[float, float] | None]:
    """Each axis's least and largest representative value, zero included, infinities not; None if there is none."""
    axes, out = AXES[: hist.config.dims], []
    rows = with_bins(hist.df.where("count > 0"), {f"_{a}": f"code_{a}" for a in axes}, BITS, ["value"])
    got = rows.withColumns({f"_{a}": F.when(F.col(f"kind_{a}") == "zero", 0.0).otherwise(F.col(f"_{a}_value")) for a in axes}).agg(*(f(f"_{a}").alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max)))).first()
    for a in axes:
        out.append(None if got[f"lo_{a}"] is None else (got[f"lo_{a}"], got[f"hi_{a}"]))
    return out


def grid(hist: Histogram, axes: Sequence[Axis], max_cells: int = 1_000_000) -> DataFrame:
    """Counts in a grid, row by row, empty cells too: x_start, x_end, x_kind, x_start_inclusive, x_end_inclusive, x_is_edge, y_..., count, cell.

    Records with NaN in any axis, or outside the axes, count nowhere. Of histograms with group
    columns, all groups have the same partitions (infinite ends stand for the extent of all), and
    only populated cells are listed, behind the group columns.
    """
    _check_nd(hist, (2, 3, 4))
    if len(axes) != hist.config.dims or max_cells < 1:
        raise ValueError(f"{len(axes)} axes and up to {max_cells} cells for {hist.config.name}")
    for a in axes:
        a.check()
    spark, names = hist.df.sparkSession, AXES[: hist.config.dims]
    endless = any(math.inf in (-a.min, a.max) for a in axes)
    models = [axis_parts(a, e) for a, e in zip(axes, extents(hist) if endless else [None] * len(axes))]
    sizes = [len(parts) for parts, _ in models]
    if math.prod(sizes) > max_cells:
        raise ValueError(f"{math.prod(sizes)} cells; max_cells is {max_cells}")
    rows, cell = hist.df, F.lit(0).cast("bigint")
    for name, (parts, zero) in zip(names, models):
        # keys that can't be null: no test for that is pushed below the aggregation
        look = _lookup(spark, parts, zero, name)
        rows = rows.join(F.broadcast(look), (F.coalesce(f"kind_{name}", F.lit("")) == F.col(f"k_{name}")) & (F.coalesce(F.col(f"code_{name}"), F.lit(-1)) == F.col(f"c_{name}")))
        cell = cell * len(parts) + F.col(f"part_{name}")
    out, left = rows.groupBy(*hist.by, cell.alias("cell")).agg(F.sum("count").alias("count")), math.prod(sizes)
    if not hist.by:
        out = spark.range(left).select(F.col("id").alias("cell")).join(out, "cell", "left")
    columns = [*hist.by]
    for name, (parts, _), n in zip(names, models, sizes):
        left //= max(n, 1)
        fields = [(i, *r) for i, r in enumerate(parts[PART[:6]].itertuples(index=False, name=None))]
        known = spark.createDataFrame(fields, f"p_{name} int, {name}_start double, {name}_end double, {name}_start_inclusive boolean, {name}_end_inclusive boolean, {name}_kind string, {name}_is_edge boolean")
        out = out.join(F.broadcast(known), (F.floor(F.col("cell") / left) % n).cast("int") == F.col(f"p_{name}"))
        columns += [f"{name}_{c}" for c in ("start", "end", "kind", "start_inclusive", "end_inclusive", "is_edge")]
    return out.select(*columns, F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), "cell")


#: Buckets of an axis that a box covers at most, and positions that a bucket has at least.
MOST_BUCKETS, LEAST_BUCKET = 32, 4


def count_boxes(hist: Histogram, boxes: Sequence[Sequence[tuple[float, float]]] | DataFrame) -> DataFrame:
    """For each box: safe_count, safe_<axis>_min and _max, total_count, total_<axis>_min and _max, by box_id.

    boxes: for each the (min, max) of every axis, or a DataFrame box_id, x_min, x_max, y_min, ...
    The safe region has the bins whose value lies in the box, shrunk to those that hold
    records; the total region is one bin wider on all sides. Records with a special value in
    an axis are in no box. Without records in the box, counts are 0 and bounds null; of
    histograms with group columns, boxes without records of a group aren't listed.
    """
    _check_nd(hist, (2, 3))
    spark, names, t = hist.df.sparkSession, AXES[: hist.config.dims], bin_table(BITS)
    edges = t.values
    columns = ["box_id", *(f"{n}_{e}" for n in names for e in ("min", "max"))]

    def positions(b: pd.DataFrame) -> pd.DataFrame:
        """Of each box and axis: the first bin at or above min, the last at or below max."""
        out = {"box_id": b["box_id"]}
        for n in names:
            out[f"{n}_a"] = np.searchsorted(edges, b[f"{n}_min"].to_numpy(float), "left").clip(0, len(edges) - 1)
            out[f"{n}_b"] = np.searchsorted(edges, b[f"{n}_max"].to_numpy(float), "right") - 1
        return pd.DataFrame(out)

    schema = "box_id long, " + ", ".join(f"{n}_a long, {n}_b long" for n in names)
    spans = [(f(F.col(f"{n}_b") - F.col(f"{n}_a"))) for n in names for f in (F.avg, F.max)]
    if isinstance(boxes, DataFrame):
        wanted = boxes.select(columns).mapInPandas(lambda batches: map(positions, batches), schema)
        got = list(wanted.agg(*spans).first())
    else:
        given = pd.DataFrame([(i, *(float(v) for pair in b for v in pair)) for i, b in enumerate(boxes)], columns=columns)
        placed = positions(given)
        wanted = spark.createDataFrame(placed, schema)
        got = [f for n in names for d in [placed[f"{n}_b"] - placed[f"{n}_a"]] for f in (d.mean(), d.max())]
    # buckets as wide as a usual box, so that it covers two or so on each axis, and a large one not too many
    shifts = [max(LEAST_BUCKET, math.ceil(math.log2(max(mean or 1, (most or 1) / MOST_BUCKETS, 1)))) for mean, most in zip(got[::2], got[1::2])]
    buckets = [f"_b{n}" for n in names]
    # records with a special axis have no position there, and so meet no box
    cells = with_bins(hist.df.where("count > 0"), {f"_{n}": f"code_{n}" for n in names}, BITS, ["pos"])
    cells = cells.select(*hist.by, *(F.col(f"_{n}_pos").alias(f"{n}_pos") for n in names), "count").withColumns({b: F.shiftright(f"{n}_pos", s) for b, n, s in zip(buckets, names, shifts)})

    def inside(regions: DataFrame, on: Sequence[str]) -> DataFrame:
        cut = regions.where(" AND ".join(f"{n}_a <= {n}_b" for n in names))
        for b, n, s in zip(buckets, names, shifts):
            cut = cut.withColumn(b, F.explode(F.sequence(F.shiftright(f"{n}_a", s), F.shiftright(f"{n}_b", s))))
        return cut.join(cells, [*on, *buckets]).where(" AND ".join(f"{n}_pos BETWEEN {n}_a AND {n}_b" for n in names))

    keys = [*hist.by, "box_id"]
    safe = inside(wanted, []).groupBy(*keys).agg(F.sum("count").alias("safe_count"), *(f(f"{n}_pos").alias(f"{n}_{s}") for n in names for s, f in (("lo", F.min), ("hi", F.max))))
    last = (1 << BITS) - 1
    wider = safe.select(*keys, *(e for n in names for e in (F.greatest(F.col(f"{n}_lo") - 1, F.lit(0)).alias(f"{n}_a"), F.least(F.col(f"{n}_hi") + 1, F.lit(last)).alias(f"{n}_b"))))
    total = inside(wider, hist.by).groupBy(*keys).agg(F.sum("count").alias("total_count"))
    both = safe.join(total, keys) if hist.by else wanted.select("box_id").join(safe, "box_id", "left").join(total, "box_id", "left")
    out = [*keys, F.coalesce("safe_count", F.lit(0)).alias("safe_count"), F.coalesce("total_count", F.lit(0)).alias("total_count")]

    @F.pandas_udf("double")
    def start(positions: pd.Series) -> pd.Series:  # a row for each box
        return positions.map(lambda i: None if pd.isna(i) else float(edges[int(i)])).astype(float)

    for n in names:
        lo, hi = F.col(f"{n}_lo"), F.col(f"{n}_hi")
        out += [start(lo).alias(f"safe_{n}_min"), start(hi).alias(f"safe_{n}_max"), start(F.greatest(lo - 1, F.when(lo.isNotNull(), 0))).alias(f"total_{n}_min"), start(F.least(hi + 1, F.when(hi.isNotNull(), last))).alias(f"total_{n}_max")]
    return both.select(*out)
