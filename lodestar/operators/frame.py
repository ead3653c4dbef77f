"""A DataFrame whose columns are known by identity."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.algebra import INT64, Const, Ref

_ids = count()


def fresh() -> str:
    """A column name that no other column has, so that joins never make a name ambiguous."""
    return f"c{next(_ids)}"


@dataclass(frozen=True)
class Frame:
    """cols: by (depth, binding, column); outputs: of a projection, by name.

    keys: the columns of the outer rows a subquery is worked out for (empty outside of subqueries).
    ords: the ordinals that put rows in the order of the tables (empty unless order is asked for).
    sort: what an ORDER BY asks for.
    """

    df: DataFrame
    cols: dict[tuple[int, str, str], str]
    keys: tuple[str, ...] = ()
    ords: tuple[str, ...] = ()
    outputs: dict[str, str] = field(default_factory=dict)
    sort: tuple[Column, ...] = ()

    def physical(self, r: Ref) -> str:
        if not r.binding and r.column in self.outputs:
            return self.outputs[r.column]
        return self.cols[r.key]

    def value(self, e) -> Column:
        if isinstance(e, Const):
            kind = "bigint" if e.type == INT64 else "string"
            return F.lit(e.value).cast(kind)
        return F.col(self.physical(e))

    def with_df(self, df: DataFrame) -> Frame:
        return replace(self, df=df)

    def renamed(self) -> Frame:
        """The same rows under new column names, for a second use of a DataFrame."""
        new = {name: fresh() for name in dict.fromkeys([*self.cols.values(), *self.keys])}
        df = self.df.select(*(F.col(a).alias(b) for a, b in new.items()))
        return Frame(df, {k: new[v] for k, v in self.cols.items()}, tuple(new[k] for k in self.keys))


def same(left: str | Column, right: str | Column) -> Column:
    """Null-safe equality, which Spark joins by hash."""
    return (F.col(left) if isinstance(left, str) else left).eqNullSafe(F.col(right) if isinstance(right, str) else right)


def all_of(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return F.lit(True) if out is None else out
