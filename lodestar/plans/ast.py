"""The parsed query, and the canonical names of its expressions."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Column:
    qualifier: str | None
    name: str
    position: int


@dataclass(frozen=True)
class Literal:
    value: int | str | None
    position: int


@dataclass(frozen=True)
class Subquery:
    query: Select
    position: int


@dataclass(frozen=True)
class Aggregate:
    function: str
    argument: Column | Aggregate | None  # None: COUNT(*)
    position: int


@dataclass(frozen=True)
class WindowCall:
    function: str
    argument: Column | Aggregate | None
    star: bool
    partition: tuple
    order: tuple  # (expression, descending)
    frame: str | None  # ROWS, RANGE or None
    position: int


@dataclass(frozen=True)
class Compare:
    left: object
    op: str
    right: object
    position: int


@dataclass(frozen=True)
class NullTest:
    value: object
    negated: bool
    position: int


@dataclass(frozen=True)
class Membership:
    value: object
    query: Select
    negated: bool
    position: int


@dataclass(frozen=True)
class Exists:
    query: Select
    negated: bool
    position: int


@dataclass(frozen=True)
class Logic:
    op: str  # AND or OR
    left: object
    right: object
    position: int


@dataclass(frozen=True)
class Item:
    expression: object
    alias: str | None
    position: int  # of the alias, if there is one


@dataclass(frozen=True)
class TableRef:
    name: str
    position: int
    alias: str | None
    alias_position: int

    @property
    def binding(self) -> str:
        return self.name if self.alias is None else self.alias


@dataclass(frozen=True)
class JoinClause:
    kind: str  # INNER, LEFT or RIGHT
    table: TableRef
    on: tuple


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: TableRef
    joins: tuple[JoinClause, ...] = ()
    where: tuple = ()
    group_by: tuple[Column, ...] = ()
    having: tuple | None = None
    order_by: tuple = field(default=())  # (expression, descending)
    limit: int | None = None
    distinct: bool = False
    explain: bool = False


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def label(e) -> str:
    """The canonical text of an expression: the name of an output without alias."""
    if isinstance(e, Column):
        return e.name if e.qualifier is None else f"{e.qualifier}.{e.name}"
    if isinstance(e, Literal):
        return "NULL" if e.value is None else quoted(e.value) if isinstance(e.value, str) else str(e.value)
    if isinstance(e, Aggregate):
        return f"{e.function}({'*' if e.argument is None else label(e.argument)})"
    if isinstance(e, WindowCall):
        parts = []
        if e.partition:
            parts.append("PARTITION BY " + ", ".join(map(label, e.partition)))
        if e.order:
            parts.append("ORDER BY " + ", ".join(f"{label(k)} {'DESC' if down else 'ASC'}" for k, down in e.order))
        if e.frame:
            parts.append(f"{e.frame} BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
        argument = "*" if e.star else "" if e.argument is None else label(e.argument)
        return f"{e.function}({argument}) OVER ({' '.join(parts)})"
    return "(subquery)"
