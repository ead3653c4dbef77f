"""Checked 64-bit sums and NULL order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = 0xFFFFFFFF


def overflow(name: str) -> Column:
    return F.raise_error(F.lit(f"{name} overflowed int64")).cast("bigint")


def halves(v: Column) -> tuple[Column, Column]:
    """The low and high 32 bits of an integer: v = high * 2**32 + low."""
    return v.bitwiseAND(F.lit(_LOW).cast("bigint")), F.shiftright(v, 32).cast("bigint")


def whole(low: Column, high: Column, name: str) -> Column:
    """The integer of summed halves; NULL for NULL halves, an error if it isn't a 64-bit integer."""
    top = high + F.shiftright(low, 32)
    total = F.shiftleft(top, 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW).cast("bigint")))
    return F.when((top >= F.lit(-(2**31)).cast("bigint")) & (top < F.lit(2**31).cast("bigint")), total).when(top.isNotNull(), overflow(name))


def checked_sum(v: Column, name: str, over=None) -> Column:
    """SUM of 64-bit integers: NULL without values, an error if the exact total is no 64-bit integer.

    The halves of each value are summed apart, so no step overflows and the outcome does not depend
    on the order of the rows; all of it is long arithmetic.
    """
    low, high = (F.sum(x) if over is None else F.sum(x).over(over) for x in halves(v))
    return whole(low, high, name)


def ordered(c: Column, descending: bool) -> Column:
    """NULL is the largest value."""
    return c.desc_nulls_first() if descending else c.asc_nulls_last()
