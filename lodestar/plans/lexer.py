"""Tokens of the dialect, made one at a time so that errors come in reading order."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..errors import ParseError

# The dialect's reserved words. Window words are not reserved.
RESERVED = frozenset(
    "SELECT FROM WHERE AND OR AS JOIN INNER ON LEFT RIGHT OUTER ORDER BY ASC DESC GROUP COUNT SUM MIN MAX "
    "HAVING DISTINCT LIMIT NULL IS NOT IN EXISTS EXPLAIN".split()
)

_SPACE = re.compile(r"[ \t\n\v\f\r]*")
_TOKEN = re.compile(r"(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<int>-?[0-9]+)|(?P<str>'(?:[^']|'')*')|(?P<op><=|<>|>=|[,.()*;=<>])")


class Token(NamedTuple):
    kind: str  # name, int, str, op or end
    text: str
    position: int
    end: int

    def is_word(self, word: str) -> bool:
        return self.kind == "name" and self.text.upper() == word

    @property
    def is_identifier(self) -> bool:
        return self.kind == "name" and self.text.upper() not in RESERVED


def as_bytes(text: str) -> str:
    """One character for each byte of the text, so that offsets count bytes."""
    return text.encode("utf-8").decode("latin-1")


def scan(source: str, offset: int) -> Token:
    """The token at or behind offset of a source made by as_bytes."""
    at = _SPACE.match(source, offset).end()
    if at == len(source):
        return Token("end", "", at, at)
    found = _TOKEN.match(source, at)
    if not found:
        if source[at] == "'":
            raise ParseError(at, "unterminated string literal")
        raise ParseError(at, f"unexpected character '{source[at]}'")
    kind, text = found.lastgroup, found.group()
    if kind == "str":
        text = text[1:-1].replace("''", "'").encode("latin-1").decode("utf-8")
    return Token(kind, text, at, found.end())
