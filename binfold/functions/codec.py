"""Numbers to bin codes, as Columns and in numpy, and codes back to the values that bins start at.

A code keeps a number's sign, the sign of its exponent, the number of zeros before the leading
one of (folded exponent, mantissa) and the bits behind that one, so bins are densest around 1.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MANTISSA = (1 << 52) - 1


def ieee_bits(x: Column) -> Column:
    """The 64 bits of a number as a double: exact for -0.0, sub-normal numbers and NaN."""
    return F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), x.cast("double")).cast("bigint")


#: The kinds other than fin.
KINDS = ("nan", "pinf", "ninf", "pzero", "nzero", "zero")


def special(bits: Column, signed_zero: bool) -> Column:
    """The place in KINDS of a number that isn't finite or is zero."""
    size = bits.bitwiseAND(F.lit((1 << 63) - 1))
    zero = F.when(bits < 0, 4).otherwise(3) if signed_zero else F.lit(5)
    return F.when(size == 0, zero).when(size > F.lit(0x7FF << 52), 0).when(bits < 0, 2).otherwise(1)


def is_finite(bits: Column) -> Column:
    """A finite number other than zero."""
    size = bits.bitwiseAND(F.lit((1 << 63) - 1))
    return (size != 0) & (size < F.lit(0x7FF << 52))


def rough_top(mk: Column) -> Column:
    """About the place of the highest set bit of a positive number below 2^62, by log2 of its double, which rounds. 0 where there is none."""
    return F.when(mk > 0, F.floor(F.log2(mk.cast("double"))).cast("int")).otherwise(0)


def _shift_left(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n)


def _shift_right(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n)


def exponent(bits: Column) -> Column:
    """The exponent of a double, without its bias."""
    return F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(0x7FF)).cast("int") - 1023


def folded(bits: Column, e: Column, fast_nd: bool = False) -> Column:
    """The folded exponent above the mantissa. Negative for 1 <= |x| < 2 in n-D Fast layouts, whose fold takes exponent 0 for a negative one."""
    fold = F.when(e <= 0 if fast_nd else e < 0, -e - 1).otherwise(e).cast("bigint")
    return F.shiftleft(fold, 52).bitwiseOR(bits.bitwiseAND(F.lit(MANTISSA)))


def leading_one(mk: Column, rough: Column) -> Column:
    """The place of the highest set bit, from rough_top()."""
    return rough - ((mk > 0) & (_shift_left(rough) > mk)).cast("int") + (_shift_left(rough + 1) <= mk).cast("int")


def code(bits: Column, e: Column, mk: Column, f: Column, precision: int, fast_nd: bool = False) -> Column:
    """The code of a finite number other than zero, from its bits, exponent(), folded() and leading_one(), which are columns of steps before."""
    mask = F.lit((1 << precision) - 1)
    zeros = 61 - f
    if fast_nd:
        field = _shift_right(mk, F.greatest(f - 5, F.lit(50))).bitwiseAND(mask).cast("int")
        found = F.when(mk < 0, mask).when(mk == 0, F.lit(7 << precision)).otherwise(F.shiftleft(F.least(F.greatest(zeros, F.lit(0)), F.lit(7)), precision).bitwiseOR(field))
    else:
        deep = F.lit(15 << precision).bitwiseOR(F.shiftright(mk, 47 - precision).bitwiseAND(mask).cast("int"))
        usual = F.shiftleft(zeros, precision).bitwiseOR(_shift_right(mk, f - precision).bitwiseAND(mask).cast("int"))
        found = F.when(mk == 0, F.lit(15 << precision)).when(zeros >= 15, deep).otherwise(usual)
    width = precision + (3 if fast_nd else 4)
    return (found.cast("int") + F.when(bits < 0, 2 << width).otherwise(0) + F.when(e < 0, 1 << width).otherwise(0)).cast("int")


def encode_numpy(x: np.ndarray, precision: int) -> np.ndarray:
    """The same for finite numbers other than zero, in layouts but the n-D Fast ones; for tests and small arrays."""
    bits = np.asarray(x, np.float64).view(np.int64)
    e = ((bits >> 52) & 0x7FF) - 1023
    mk = np.where(e < 0, -e - 1, e) << 52 | bits & MANTISSA
    f = np.array([int(v).bit_length() - 1 for v in mk.tolist()], np.int64)
    zeros = np.where(mk == 0, 15, np.minimum(61 - f, 15))
    field = np.where(zeros == 15, mk >> (47 - precision), mk >> np.maximum(f - precision, 0)) & (1 << precision) - 1
    return (bits < 0).astype(np.int64) << precision + 5 | (e < 0).astype(np.int64) << precision + 4 | zeros << precision | field


def start_values(codes: np.ndarray, bits: int) -> np.ndarray:
    """The value at which each code's bin starts (ends, for a negative one)."""
    codes = np.asarray(codes, np.int64)
    p = bits - 6
    zeros, field, small = codes >> p & 15, codes & (1 << p) - 1, codes >> p + 4 & 1
    lead = (zeros != 15).astype(np.int64)
    stream, length = lead << p | field, 1 + zeros + lead + p
    # the stream's first 11 bits are the folded exponent, the rest leads the mantissa
    rest = length - 11
    exponent = np.where(rest >= 0, stream >> np.maximum(rest, 0), stream << np.maximum(-rest, 0))
    mantissa = np.where(rest > 0, (stream & (1 << np.maximum(rest, 0)) - 1) << 52 - np.maximum(rest, 0), 0)
    biased = np.clip(np.where(small == 1, 1023 - exponent - 1, 1023 + exponent), 0, 2046)
    raw = (codes >> bits - 1 & 1).astype(np.uint64) << np.uint64(63) | biased.astype(np.uint64) << np.uint64(52) | mantissa.astype(np.uint64)
    return raw.view(np.float64)


class BinTable:
    """All bins of a width in ascending order; equal values (sub-normal numbers) in the order of their codes."""

    def __init__(self, bits: int) -> None:
        values = start_values(np.arange(1 << bits), bits)
        self.code_at = np.lexsort((np.arange(len(values)), values))
        self.values = values[self.code_at]
        self.position = np.empty(len(values), np.int64)
        self.position[self.code_at] = np.arange(len(values))
        self.next = np.append(self.values[1:], np.inf)
        self.prev = np.insert(self.values[:-1], 0, -np.inf)
        #: The native interval: [value, next) for 0 and above, (prev, value] below.
        negative = self.values < 0
        self.lower = np.where(negative, self.prev, self.values)
        self.upper = np.where(negative, self.values, self.next)

    def __len__(self) -> int:
        return len(self.values)

    def index(self, x: float) -> int:
        """The first position whose value isn't below x; the last one if there is none."""
        return min(int(np.searchsorted(self.values, x, "left")), len(self) - 1)


@lru_cache(maxsize=4)
def bin_table(bits: int) -> BinTable:
    """Made once in each process."""
    return BinTable(bits)
