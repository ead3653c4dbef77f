"""Errors of the dialect. Positions are byte offsets into the query text."""

from __future__ import annotations


class QueryError(Exception):
    """Any error that a query itself causes."""


class _Positioned(QueryError):
    kind = ""

    def __init__(self, position: int, message: str):
        super().__init__(f"{self.kind} error at position {position}: {message}")
        self.position, self.message = position, message


class ParseError(_Positioned):
    kind = "parse"


class BindError(_Positioned):
    kind = "bind"


class ExecutionError(QueryError):
    """An error found while rows are computed, such as an overflow."""
