"""Histograms: build and merge.

A histogram is a handle on a DataFrame with a row for each populated bin: in one dimension
`kind`, `code`, `count`, in more `kind_x`, `code_x`, `kind_y`, ..., `count`, and any group
columns in front. kind is fin for a bin; specials (nan, pinf, ninf, zeros) have rows too, with
a null code. Building is one aggregation by code with a map-side part, so a task sends at most
a row for each bin; merging is the same sum over a union, so build(A + B) = merge(build A, build B).

Rows with a null in any axis are left out. Counts are 64-bit.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binfold.functions import codec
from binfold.functions.configs import Config, config

AXES = "xyzw"
_NUMBERS = ("double", "float", "int", "bigint")


@dataclass(frozen=True)
class Histogram:
    config: Config
    df: DataFrame
    by: tuple[str, ...] = ()

    @property
    def keys(self) -> list[str]:
        """The columns that name a bin."""
        if self.config.dims == 1:
            return [*self.by, "kind", "code"]
        return [*self.by, *(f"{k}_{a}" for a in AXES[: self.config.dims] for k in ("kind", "code"))]

    def kinds(self) -> list[str]:
        return [k for k in self.keys[len(self.by) :] if k.startswith("kind")]

    def trie_count(self) -> DataFrame:
        """count of the rows that the reference layout counts as observations: finite ones in one dimension, all in more."""
        counted = F.when(F.col("kind") == "fin", F.col("count")) if self.config.dims == 1 else F.col("count")
        return self.df.groupBy(*self.by).agg(F.coalesce(F.sum(counted), F.lit(0)).alias("observations"))

    def specials(self) -> DataFrame:
        """pos_inf, neg_inf, pos_zero, neg_zero, nan: in more dimensions a record counts once for each special axis."""

        def total(*names: str) -> Column:
            return F.coalesce(F.sum(F.col("count") * sum((F.col(k).isin(*names).cast("int") for k in self.kinds()), F.lit(0))), F.lit(0)).cast("bigint")

        return self.df.groupBy(*self.by).agg(total("pinf").alias("pos_inf"), total("ninf").alias("neg_inf"), total("pzero", "zero").alias("pos_zero"), total("nzero").alias("neg_zero"), total("nan").alias("nan"))


def _packed(df: DataFrame, columns: Sequence[str], layout: Config, keep: Sequence[str]) -> DataFrame:
    """`keep`, and _p0, _p1, ...: each axis's code, or -1 less a special kind's place in codec.KINDS."""
    kinds = dict(df.dtypes)
    for c in columns:
        if kinds.get(c) not in _NUMBERS:
            raise TypeError(f"{c} is {kinds.get(c, 'missing')}; axes are double, float, int or bigint columns")
    if len(columns) != layout.dims:
        raise ValueError(f"{layout.name} takes {layout.dims} columns, not {len(columns)}")
    some = reduce(Column.__and__, (F.col(c).isNotNull() for c in columns))
    axes, fast = range(layout.dims), layout.fast_nd
    # step by step, so that no step's expression is computed twice
    bits = df.where(some).select(*keep, *(codec.ieee_bits(F.col(c)).alias(f"_b{i}") for i, c in enumerate(columns)))
    cut = bits.withColumns({f"_e{i}": codec.exponent(F.col(f"_b{i}")) for i in axes})
    folded = cut.withColumns({f"_k{i}": codec.folded(F.col(f"_b{i}"), F.col(f"_e{i}"), fast) for i in axes})
    rough = folded.withColumns({f"_g{i}": codec.rough_top(F.col(f"_k{i}")) for i in axes})
    placed = rough.withColumns({f"_f{i}": codec.leading_one(F.col(f"_k{i}"), F.col(f"_g{i}")) for i in axes})
    out = []
    for i in axes:
        b, e, k, f = (F.col(f"_{x}{i}") for x in "bekf")
        code = codec.code(b, e, k, f, layout.precision, fast)
        out.append(F.when(codec.is_finite(b), code).otherwise(-1 - codec.special(b, signed_zero=layout.dims == 1)).alias(f"_p{i}"))
    return placed.select(*keep, *out)


def _unpacked(df: DataFrame, layout: Config) -> list[Column]:
    """kind and code of each axis from _p0, _p1, ..."""
    out, names = [], F.array(*map(F.lit, codec.KINDS))
    for i in range(layout.dims):
        p, suffix = F.col(f"_p{i}"), "" if layout.dims == 1 else f"_{AXES[i]}"
        out += [F.when(p >= 0, "fin").otherwise(F.get(names, -1 - p)).alias(f"kind{suffix}"), F.when(p >= 0, p).alias(f"code{suffix}")]
    return out


def bin_columns(df: DataFrame, columns: Sequence[str], layout: Config, keep: Sequence[str] = ()) -> DataFrame:
    """df's rows as bins: `keep`, then the kind and code of each axis. Rows with a null axis go."""
    packed = _packed(df, columns, layout, keep)
    return packed.select(*keep, *_unpacked(packed, layout))


def build(df: DataFrame, columns: str | Sequence[str], layout: str | Config, by: Sequence[str] = ()) -> Histogram:
    """The histogram of 1 to 4 columns; with `by`, one for each group."""
    layout, columns = config(layout), [columns] if isinstance(columns, str) else list(columns)
    # counted by one number an axis; kinds get their names afterwards
    counts = _packed(df, columns, layout, by).groupBy(*by, *(f"_p{i}" for i in range(layout.dims))).count()
    return Histogram(layout, counts.select(*by, *_unpacked(counts, layout), "count"), tuple(by))


def merge(histograms: Iterable[Histogram]) -> Histogram:
    """The sum of any number of histograms of one layout: one union and one aggregation."""
    parts = list(histograms)
    if not parts:
        raise ValueError("nothing to merge")
    first = parts[0]
    if any(h.config != first.config or h.by != first.by for h in parts):
        raise ValueError("histograms of different layouts or groups don't merge")
    if len(parts) == 1:
        return first
    both = reduce(DataFrame.unionByName, (h.df.select(*h.keys, "count") for h in parts))
    return Histogram(first.config, both.groupBy(*first.keys).agg(F.sum("count").alias("count")), first.by)
