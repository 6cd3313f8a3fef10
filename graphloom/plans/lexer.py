"""Tokens of a request."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .errors import SyntaxFault

_TOKEN = re.compile(
    r"""(?P<space>\s+|\(:.*?:\))
      | (?P<string>"(?:[^"\\]|\\.)*")
      | (?P<mark><-|->|\|\||!=|~=|<=|>=|[(){}<>=|+])
      | (?P<var>\$[A-Za-z_][A-Za-z0-9_]*)
      | (?P<atom>[A-Za-z0-9_.:/;@*]+(?:-(?!>)[A-Za-z0-9_.:/;@*]+)*)
      | (?P<minus>-)""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = {"\\": "\\", '"': '"', "n": "\n"}


@dataclass(frozen=True)
class Token:
    kind: str  # string, mark, var, atom, end
    text: str
    at: int


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxFault(f"unexpected character {text[at]!r} at {at}")
        kind, found = m.lastgroup, m.group()
        if kind == "string":
            body = re.sub(r"\\(.)", lambda e: _ESCAPE.get(e[1], e[0]), found[1:-1], flags=re.DOTALL)
            out.append(Token("string", body, at))
        elif kind != "space":
            out.append(Token("mark" if kind == "minus" else kind, found, at))
        at = m.end()
    return [*out, Token("end", "", len(text))]
