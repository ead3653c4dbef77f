"""Ranks and running aggregates over all rows, without one task for all of them.

Rows are dealt to buckets by the first order key: bucket numbers rise with the key and depend on approximate quantiles
of all keys, so that buckets are of like size whatever the keys are, and rows of equal keys share one. Each bucket is
worked out apart; what the buckets before it hold (one row for each bucket, counted from the rows that came in, so that
no other window is worked out again for it) is added. A string counts by its first bytes. Where there is no order at
all, any order will do: rows are then dealt by a hash of their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exact import halves, whole
from .frame import fresh

BUCKETS = 512  # a power of two
_PREFIX = 7  # bytes of a string that its number takes in


def number_of(key: Column, is_string: bool) -> Column:
    """A bigint that rises with the key, equal for equal keys."""
    if not is_string:
        return key
    return F.conv(F.rpad(F.hex(F.substring(F.encode(key, "UTF-8"), 1, _PREFIX)), 2 * _PREFIX, "0"), 16, 10).cast("bigint")


def any_order(df: DataFrame) -> Column:
    """A bigint by which rows are dealt where no order is asked for."""
    return F.xxhash64(*df.columns)


def bucketed(df: DataFrame, source: DataFrame, key: Column, name: str) -> DataFrame:
    """df with a bucket number that rises with key, NULL being the largest. source has the same keys."""
    bounds = fresh()
    cuts = source.agg(F.percentile_approx(key, [i / BUCKETS for i in range(1, BUCKETS)], 20 * BUCKETS).alias(bounds))  # one row
    steps = [1 << i for i in reversed(range(BUCKETS.bit_length() - 1))]
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(F.col(bounds), at + step - 1) < key, at + step).otherwise(at))  # binary search
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, F.when(key.isNull(), F.lit(BUCKETS)).otherwise(F.coalesce(below, F.lit(0)))).drop(bounds)  # never NULL: a join needn't test it, which would search twice


def running(df: DataFrame, source: DataFrame, windows: list[tuple], key: Column) -> DataFrame:
    """df with the values of windows that all have key as their first order key, in either direction.

    windows: (window, column for its values, all its order keys, its argument, the order keys' columns); source: the same
    rows before other windows were added, from which buckets and what they hold are counted. Taking these from df would
    work out each window before this one twice, and so double the work with each further order.
    """
    bucket, own = fresh(), fresh()
    dealt = bucketed(df, source, key, bucket)
    # buckets that come earlier; there are BUCKETS + 1 at most
    earlier = {down: Window.orderBy(F.desc(own) if down else F.asc(own)).rowsBetween(Window.unboundedPreceding, -1) for down in (False, True)}
    steps: dict[str, tuple] = {}  # column: (what a bucket adds to those behind it, those before it put together)
    used: list[list[str]] = []
    for w, _, order, v, by in windows:
        over = Window.partitionBy(bucket).orderBy(*(order or [F.lit(1)]))
        frame = (over.rowsBetween if w.frame == "ROWS" else over.rangeBetween)(Window.unboundedPreceding, Window.currentRow)
        counted = F.lit(1) if v is None else v
        if w.function in ("ROW_NUMBER", "RANK", "DENSE_RANK"):
            call = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}[w.function]
            local = fresh()
            own_steps = {local: (call().over(over).cast("bigint"), F.count_distinct(F.struct(*by)) if w.function == "DENSE_RANK" else F.count(F.lit(1)), F.sum)}
        elif w.function == "COUNT":
            own_steps = {fresh(): (F.count(counted).over(frame), F.count(counted), F.sum)}
        elif w.function == "SUM":
            own_steps = {fresh(): (F.sum(x).over(frame), F.sum(x), F.sum) for x in halves(v)}
        else:
            extreme = F.min if w.function == "MIN" else F.max
            own_steps = {fresh(): (extreme(v).over(frame), extreme(v), extreme)}
        for column, (value, held, together) in own_steps.items():
            dealt = dealt.withColumn(column, value)
            steps[column] = held, together(column).over(earlier[bool(w.order) and w.order[0][1]])
        used.append(list(own_steps))
    sizes = bucketed(source, source, key, own).groupBy(own).agg(*(held.alias(column) for column, (held, _) in steps.items()))
    before = {column: fresh() for column in steps}
    offsets = sizes.select(own, *(sofar.alias(before[column]) for column, (_, sofar) in steps.items()))
    joined = dealt.join(F.broadcast(offsets), F.col(bucket) == F.col(own))
    for (w, name, *_), columns in zip(windows, used):
        here, there = [F.col(c) for c in columns], [F.col(before[c]) for c in columns]
        if w.function == "SUM":
            out = whole(*(_plus(a, b) for a, b in zip(here, there)), w.name)
        elif w.function in ("MIN", "MAX"):
            out = (F.least if w.function == "MIN" else F.greatest)(here[0], there[0])  # both skip NULL
        else:
            out = here[0] + F.coalesce(there[0], F.lit(0).cast("bigint"))
        joined = joined.withColumn(name, out)
    return joined.drop(bucket, own, *steps, *before.values())


def _plus(a: Column, b: Column) -> Column:
    """A sum in which NULL stands for no values."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
