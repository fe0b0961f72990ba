"""What is known of a bin, for columns of codes.

A constant array by code for narrow codes, arithmetic for wide ones, inside generated code: no join, so a table of
histograms of any size stays where it is, and no Python worker, however many axes are looked at.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binfold.functions.codec import bin_table, start_values

#: What with_bins() adds for a code.
FIELDS = ("pos", "value", "next", "prev", "lower", "upper")
#: Bits up to which a field is a constant array by code: arithmetic for several axes would make a method that the JVM doesn't compile.
NARROW = 13
#: Always true, but not deterministic: else a filter on a field would be pushed below the aggregation, and run for each input row.
_FENCE = "spark_partition_id() >= 0"
#: Special kinds take their places between bins by their own numbers; a bin has four times its position.
BEFORE_ALL, AFTER_ALL = -(1 << 40), 1 << 40


@lru_cache(maxsize=4)
def _blocks(bits: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """How codes turn into positions, by the 64 blocks of codes that differ in their precision field alone.

    Of each block: its place in the order of values, and what to flip of its fields, so that they
    ascend as values do. Of each place: its block, and the same flip.
    """
    p = bits - 6
    place, flip = [], []
    for block in range(64):
        negative, small, zeros = block >> 5, block >> 4 & 1, block & 15
        # below 1 a larger exponent makes a smaller number: so many bits of the field are the exponent's
        of_exponent = min(max(9 - zeros, 0), p) if small else 0
        size = (zeros if zeros < 10 else 25 - zeros) if small else 31 - zeros
        turned = (1 << p) - (1 << p - of_exponent)
        place.append(31 - size if negative else 32 + size)
        flip.append(turned ^ (1 << p) - 1 if negative else turned)
    block_at = np.argsort(place).tolist()
    return place, flip, block_at, [flip[b] for b in block_at]


@lru_cache(maxsize=4)
def _ties(bits: int) -> tuple[list[int], list[int]]:
    """Wide codes have two exponents for each sub-normal number and each zero. Of the positions around the middle, where these lie: from the place that _blocks() gives to the one by value and code, and back."""
    p, middle = bits - 6, 1 << bits - 1
    reach = 2 << p - 9 if p > 9 else 0
    _, _, block_at, flip_at = _blocks(bits)
    codes = np.array([block_at[i >> p] << p | (i & (1 << p) - 1) ^ flip_at[i >> p] for i in range(middle - reach, middle + reach)], np.int64)
    back = np.lexsort((codes, start_values(codes, bits)))
    return np.argsort(back).tolist(), back.tolist()


def _array(numbers: list, kind: str = "int") -> str:
    """In SQL, and one constant to the planner. Python's digits of a double give the same double again."""
    return f"CAST(split('{','.join(map(repr, numbers))}', ',') AS array<{kind}>)"


def with_bins(df: DataFrame, codes: Mapping[str, str], bits: int, fields: Sequence[str] = FIELDS) -> DataFrame:
    """df with those fields of each name's column of codes, as <name>_pos, <name>_value, ...: what codec.BinTable holds. Null for a null code."""
    if bits <= NARROW:
        t = bin_table(bits)
        known = {"pos": t.position, "value": t.values[t.position], "next": t.next[t.position], "prev": t.prev[t.position], "lower": t.lower[t.position], "upper": t.upper[t.position]}
        tables = {f: _array(known[f].tolist(), "bigint" if f == "pos" else "double") for f in fields}
        return df.select("*", *(F.expr(f"CASE WHEN {_FENCE} THEN get({tables[f]}, {c}) END AS {n}_{f}") for n, c in codes.items() for f in fields))
    p, given, names = bits - 6, df.columns, list(codes)
    place, flip, block_at, flip_at = map(_array, _blocks(bits))
    there, back = _ties(bits)
    first_tied, field = (1 << bits - 1) - len(there) // 2, (1 << p) - 1
    beside = {"before": "- 1", "after": "+ 1"}
    every = [f"{n}_{s}" for n in names for s in ("own", *beside)]

    def step(**made: str) -> None:
        """Columns in SQL, step by step, so that no step's expression is computed twice."""
        nonlocal df
        df = df.select("*", *(F.expr(f"{e} AS {c}") for c, e in made.items()))

    def moved(c: str, blocks: str, flips: str) -> str:
        """From codes to places, or back. Null outside of both."""
        return f"shiftleft(get({blocks}, shiftright({c}, {p})), {p}) + (({c} & {field}) ^ get({flips}, shiftright({c}, {p})))"

    def retied(at: str, ties: list[int]) -> str:
        return f"coalesce(get({_array(ties)}, {at} - {first_tied}) + {first_tied}, {at})" if ties else at

    step(**{f"{n}_own": f"CAST({c} AS int)" for n, c in codes.items()})
    step(**{f"{n}_place": moved(f"{n}_own", place, flip) for n in names})
    step(**{f"{n}_at": retied(f"{n}_place", there) for n in names})
    # the codes before and after; beyond the ends there is none
    step(**{f"{n}_{s}_place": retied(f"({n}_at {d})", back) for n in names for s, d in beside.items()})
    step(**{f"{n}_{s}": moved(f"{n}_{s}_place", block_at, flip_at) for n in names for s in beside})
    # as codec.start_values(), with powers of two, which are exact
    step(**{f"{c}_zeros": f"shiftright({c}, {p}) & 15" for c in every})
    step(**{f"{c}_stream": f"({c} & {field}) + if({c}_zeros = 15, 0, {1 << p})" for c in every}, **{f"{c}_rest": f"least({c}_zeros + 1, 15) + {p - 10}" for c in every})
    step(**{f"{c}_folded": f"shiftleft(shiftright({c}_stream, greatest({c}_rest, 0)), greatest(-{c}_rest, 0))" for c in every}, **{f"{c}_unit": f"shiftleft(1, greatest({c}_rest, 0))" for c in every})
    step(**{f"{c}_e": f"if((shiftright({c}, {p + 4}) & 1) = 1, -{c}_folded - 1, {c}_folded)" for c in every})
    step(**{f"{c}_v": f"if(shiftright({c}, {p + 5}) = 1, -1D, 1D) * (({c}_stream & ({c}_unit - 1)) / {c}_unit + if({c}_e < -1022, 0D, 1D)) * pow(2D, greatest({c}_e, -1022))" for c in every})
    out = [F.col(c) for c in given]
    for n in names:
        value, prev, after = f"{n}_own_v", f"if({n}_own IS NULL, NULL, coalesce({n}_before_v, -double('inf')))", f"if({n}_own IS NULL, NULL, coalesce({n}_after_v, double('inf')))"
        found = {"pos": f"bigint({n}_at)", "value": value, "next": after, "prev": prev, "lower": f"if({value} < 0, {prev}, {value})", "upper": f"if({value} < 0, {value}, {after})"}
        out += [F.expr(f"CASE WHEN {_FENCE} THEN {found[f]} END AS {n}_{f}") for f in fields]
    return df.select(*out)


def order_key(kind: Column, pos: Column, bits: int) -> Column:
    """A number that sorts rows as their values do: -inf, bins below 0, -0, +0, bins above, +inf. Null for NaN."""
    zero = 4 << bits - 1
    return (
        F.when(kind == "fin", pos * 4)
        .when(kind == "ninf", F.lit(BEFORE_ALL))
        .when(kind == "nzero", F.lit(zero - 2))
        .when(kind.isin("pzero", "zero"), F.lit(zero - 1))
        .when(kind == "pinf", F.lit(AFTER_ALL))
        .cast("bigint")
    )


def special_value(kind: Column) -> Column:
    """The value of a special kind; null for bins. One look-up, so that the kind's own expression isn't repeated."""
    values = {"ninf": float("-inf"), "pinf": float("inf"), "nzero": -0.0, "pzero": 0.0, "zero": 0.0, "nan": float("nan")}
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[kind]
