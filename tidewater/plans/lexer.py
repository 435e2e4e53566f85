"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import ParseError

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*)
      | (?P<float>(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+|\.)f(?![A-Za-z0-9_]))
      | (?P<double>[0-9]+\.[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+)
      | (?P<long>[0-9]+L(?![A-Za-z0-9_]))
      | (?P<int>[0-9]+)
      | (?P<string>'(?:[^'\n]|'')*')
      | (?P<quoted>"[^"\n]+")
      | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<sign><>|!=|<=|>=|==|[=<>+*/%().,;-])""",
    re.X,
)

#: Words that can't be names without quotes.
RESERVED = frozenset(
    "ALL AND AS ASC BY CREATE CROSS DESC DISTINCT DROP FALSE FROM FULL GROUP HAVING INNER INSERT INTO IS JOIN LEFT LIMIT "
    "NATURAL NOT NULL OFFSET ON OR ORDER OUTER RIGHT SELECT SHOW TRUE USING VALUES WHERE".split()
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int

    @property
    def word(self) -> str:
        """The keyword that an unquoted word may be, else empty."""
        return self.text.upper() if self.kind == "word" else ""


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ParseError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return [*out, Token("end", "", at)]
