"""Queries of one-dimensional histograms.

Each works for a single histogram or, with group columns, for all of them at once. Rows are put
in the order of their values; a running sum over that order answers all. Of a single histogram
the order's window has at most 2^20 rows, of grouped ones it is cut by group.

NaN counts nowhere. Intervals are [start, next start) except where a function says "native".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binfold.functions.bins import order_key, special_value, with_bins
from binfold.operators.histogram import Histogram

_NINF, _PINF = float("-inf"), float("inf")


def ordered(hist: Histogram) -> DataFrame:
    """The group columns, kind, count, ord, pos, value, next, native lower and upper of each row but NaN."""
    if hist.config.dims != 1:
        raise ValueError(f"{hist.config.name} has several axes")
    bits = hist.config.bits
    info = with_bins(hist.df.where("count > 0"), {"_i": "code"}, bits)
    own = special_value(F.col("kind"))
    fields = [F.coalesce(own, F.col(f"_i_{f}")).alias(f) for f in ("value", "next", "lower", "upper")]
    return info.select(*hist.by, "kind", "code", "count", order_key(F.col("kind"), F.col("_i_pos"), bits).alias("ord"), F.col("_i_pos").alias("pos"), *fields).where("ord IS NOT NULL")


def _running(hist: Histogram) -> DataFrame:
    """ordered(), with the running sum `cum` and the sum `total` of each group."""
    rows = ordered(hist)
    w = Window.partitionBy(*hist.by)
    return rows.withColumn("cum", F.sum("count").over(w.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("count").over(w))


def percentile(hist: Histogram, percents: Sequence[float]) -> DataFrame:
    """percentile, value, lower, upper: the bin where the running sum reaches the rank, and the place in it by linear interpolation; bounds are native.

    A rank of 0 or less, one beyond all counts and an empty histogram give -inf. Each rank
    is reached in one row, which alone emits it; a group's last row emits those that none reaches.
    """
    last = (1 << hist.config.bits) - 1
    asked = F.array(*(F.lit(float(x)) for x in dict.fromkeys(percents)))
    cum, count, total = F.col("cum"), F.col("count"), F.col("total")

    def mine(p: Column) -> Column:
        rank = p / 100 * total
        return ((rank > 0) & (rank <= cum) & (rank > cum - count)) | ((cum == total) & ((rank <= 0) | (rank > total)))

    rows = _running(hist).withColumn("percentile", F.explode(F.filter(asked, mine))).withColumn("rank", F.col("percentile") / 100 * total)
    rank, start = F.col("rank"), F.col("value")
    none = (rank <= 0) | (rank > total)
    inside = start + (rank - (cum - count)) / count * (F.col("next") - start)
    value = F.when(none, _NINF).when((F.col("kind") != "fin") | (F.col("pos") == last), start).otherwise(inside)
    found = rows.select(*hist.by, "percentile", value.alias("value"), *(F.when(none, _NINF).otherwise(F.col(b)).alias(b) for b in ("lower", "upper")))
    if hist.by:
        return found
    wanted = hist.df.sparkSession.range(1).select(F.explode(asked).alias("percentile"))
    return wanted.join(found, "percentile", "left").select("percentile", *(F.coalesce(c, F.lit(_NINF)).alias(c) for c in ("value", "lower", "upper")))


def cdf(hist: Histogram, values: Sequence[float], interpolate: bool = False) -> DataFrame:
    """at, cdf: the share of counts up to each value. A bin that the value is inside of counts in proportion, or not at all.

    +0 doesn't count at -0.0. An empty histogram gives 0. The last row that begins at or
    below a value emits it, or the first row if none does.
    """
    # a number for each value, as -0.0 and 0.0 are one value to Spark
    asked = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(v)).alias("at"), F.lit(str(float(v)) == "-0.0").alias("minus")) for i, v in enumerate(values)))
    by_order = Window.partitionBy(*hist.by).orderBy("ord")
    zero = F.lit((4 << hist.config.bits - 1) - 1)  # the place of +0
    rows = _running(hist).withColumns({"after": F.lead("value").over(by_order), "after_ord": F.lead("ord").over(by_order), "first": F.row_number().over(by_order) == 1})

    def begun(start: Column, place: Column, q: Column) -> Column:
        """What begins at +0 hasn't begun at -0.0."""
        return (q["at"] > start) | ((q["at"] == start) & ~((start == 0) & q["minus"] & (place >= zero)))

    def mine(q: Column) -> Column:
        own = begun(F.col("value"), F.col("ord"), q)
        return (own | F.col("first")) & (F.col("after_ord").isNull() | ~begun(F.col("after"), F.col("after_ord"), q))

    emitted = rows.withColumn("q", F.explode(F.filter(asked, mine)))
    v, start, end, count = F.col("q.at"), F.col("value"), F.col("next"), F.col("count")
    part = F.when(F.lit(interpolate), (v - start) / (end - start) * count).otherwise(0.0)
    own = F.when(~begun(start, F.col("ord"), F.col("q")), 0.0).when((F.col("kind") != "fin") | (v >= end), count.cast("double")).otherwise(part)
    got = emitted.select(*hist.by, "q", (((F.col("cum") - count).cast("double") + own) / F.col("total")).alias("cdf"))
    if not hist.by:
        got = hist.df.sparkSession.range(1).select(F.explode(asked).alias("q")).join(got, "q", "left")
    return got.select(*hist.by, F.col("q.at").alias("at"), F.coalesce("cdf", F.lit(0.0)).alias("cdf"))


def _table(rows: DataFrame, hist: Histogram) -> DataFrame:
    return rows.select(*hist.by, F.col("value").alias("lower"), F.col("next").alias("upper"), "count", "ord")


def top_k(hist: Histogram, k: float) -> DataFrame:
    """lower, upper, count, ord of the largest values that hold k percent of the counts; the bin that crosses counts whole. ord sorts them."""
    if not 0 < k <= 100:
        raise ValueError("k is above 0 and at most 100")
    rows = _running(hist)
    wanted = F.greatest(F.floor(F.col("total") * F.lit(float(k)) / 100), F.lit(1))
    # the counts above this row: all less those up to it
    return _table(rows.where(F.col("total") - F.col("cum") < wanted), hist)


def _extreme_count(hist: Histogram, best) -> DataFrame:
    rows = ordered(hist)
    return _table(rows.withColumn("_m", best("count").over(Window.partitionBy(*hist.by))).where("count = _m"), hist).withColumn("special", F.col("lower") == F.col("upper"))


def min_count(hist: Histogram) -> DataFrame:
    """All rows with the least count; specials are marked, as they come first, then bins by ord."""
    return _extreme_count(hist, F.min)


def max_count(hist: Histogram) -> DataFrame:
    """All rows with the largest count."""
    return _extreme_count(hist, F.max)


def _extreme_value(hist: Histogram, best) -> DataFrame:
    row: Column = F.struct("ord", "value", "next", "count")
    found = ordered(hist).groupBy(*hist.by).agg(best(row).alias("r")).where("r IS NOT NULL")
    return found.select(*hist.by, F.col("r.value").alias("lower"), F.col("r.next").alias("upper"), F.col("r.count").alias("count"), F.col("r.ord").alias("ord"))


def min_value(hist: Histogram) -> DataFrame:
    """The first row in the order of values, or none."""
    return _extreme_value(hist, F.min)


def max_value(hist: Histogram) -> DataFrame:
    """The last row in the order of values, or none."""
    return _extreme_value(hist, F.max)
