"""Replies as text, for sessions and tests."""

from __future__ import annotations

import time

from pyspark.sql import Row
from pyspark.sql import functions as F

from .compiler import compile_read, dateline
from .errors import NotFound, NotYet, RequestError, SemanticFault
from .parser import parse
from .semantic import bounds
from .tree import Constraint, Pattern, Request

_BARE = ("guid", "type", "datatype", "scope", "left", "right", "typeguid", "previous", "next", "meta", "timestamp", "live", "archival", "valuetype", "generation", "count", "estimate-count", "literal")


def _plain(value, name: str) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if name in _BARE and name != "type" or isinstance(value, int):
        return str(value)
    body = str(value).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    return f'"{body}"'


class Writer:
    """Nested values back to text, along the template they came from."""

    def __init__(self, root: Constraint):
        self.root = root

    def contents(self, c: Constraint, value) -> list[str]:
        if value is None:
            return []
        shown = [x for x in self.children(c) if not (x.result.kind == "list" and not x.result.items)]
        parts = [self.result(child, v) for child, v in zip(shown, value) if v is not None]
        return parts

    def children(self, c: Constraint) -> list[Constraint]:
        out = list(c.children)
        for head, tail in c.choices:
            out += self.children(head) + (self.children(tail) if tail else [])
        return out

    def result(self, c: Constraint, value) -> str:
        return self.whole(c, c.result, value)

    def whole(self, c: Constraint, p: Pattern, value) -> str:
        if p.kind == "list":
            parts: list[str] = []
            for x, v in zip(p.items, value):
                if x.kind == "list":
                    parts += [self.row(c, x, r) for r in v or ()]
                elif x.kind == "field" and x.name == "contents":
                    parts += self.contents(c, v)
                elif not (x.kind == "field" and x.name == "none"):
                    parts.append(self.leaf(c, x, v))
            return "(" + " ".join(parts) + ")"
        if p.kind == "field" and p.name == "contents":
            return " ".join(self.contents(c, value))
        return self.leaf(c, p, value)

    def row(self, c: Constraint, p: Pattern, value: Row) -> str:
        items = list(zip(p.items, value))
        if p.default:
            node = value[0] == "node"
            items = [(x, v) for x, v in items if not (node and x.name in ("meta", "right", "left"))]
        parts: list[str] = []
        for x, v in items:
            if x.kind == "field" and x.name == "contents":
                parts += self.contents(c, v)
            elif not (x.kind == "field" and x.name == "none"):
                parts.append(self.leaf(c, x, v))
        return "(" + " ".join(parts) + ")"

    def leaf(self, c: Constraint, p: Pattern, value) -> str:
        if isinstance(value, Row):
            return "(" + " ".join(self.leaf(c, p, v) for v in value) + ")"
        if isinstance(value, list):
            return " ".join(self.leaf(c, p, v) for v in value)
        if p.kind == "literal":
            return str(value)
        source = self.source(self.root, p.name) if p.kind == "var" else p.name
        return _plain(value, source)

    def source(self, c: Constraint, name: str) -> str:
        """The field that a variable stands for, which decides how it is quoted."""
        found = self.find(c, name)
        while found and found.kind == "var":
            found = self.find(c, found.name)
        return "value" if not found else "literal" if found.kind == "literal" else found.name if found.kind == "field" else (found.items[0].items[0].name if found.items and found.items[0].kind == "list" and found.items[0].items else "value")

    def find(self, c: Constraint | None, name: str) -> Pattern | None:
        if c is None:
            return None
        for n, p in c.variables:
            if n == name:
                return p
        for x in [*c.children, *(b for pair in c.choices for b in pair)]:
            if found := self.find(x, name):
                return found
        return None


def read(store, request: Request) -> str:
    compiler, root = compile_read(store, request)
    rows = compiler.reply(root).collect()
    n = rows[0]["n"] if rows else 0
    lo, hi = bounds(root.count, root.pages.get("start", 0) + 1, None)
    lo = 0 if root.optional else lo
    if n < lo or hi is not None and n > hi:
        raise NotFound("not found")
    if not rows:
        return "0" if root.result.kind == "field" and root.result.name == "count" else "()" if root.result.kind == "list" else "null"
    if root.pages.get("pagesize") == 0:
        return "()"
    return Writer(root).result(root, rows[0]["r"])


#: Cost abbreviations: time (real, user, system, end to end), pages, primitives, index, values, and the file marks.
COSTS = ("tr", "tu", "ts", "te", "pr", "pf", "dr", "dw", "ir", "iw", "in", "va", "fm", "mm", "ft", "mt")


def allowed(text: str) -> dict[str, int]:
    """A ``cost`` modifier: name=number pairs; times are milliseconds."""
    out = {}
    for word in text.split():
        name, _, n = word.partition("=")
        if name.lower() not in COSTS or not n.isdigit():
            raise SemanticFault(f"{word!r} is no cost")
        out[name.lower()] = int(n)
    return out


def checked(request: Request, horizon: int | None) -> None:
    """Raise unless the modifiers make sense; a ``dateline`` must not be beyond ``horizon`` (None: not known)."""
    allowed(request.modifiers.get("cost", ""))
    asked = request.modifiers.get("dateline", "")
    if asked and horizon is not None and dateline(asked) > horizon:
        raise NotYet(f"this store ends at {horizon}")


def marks(request: Request, horizon: int | None, began: float) -> str:
    """What stands between ``ok`` and the result: the request's id, the store's dateline and the time spent, as asked."""
    asked = request.modifiers
    parts = [f'id="{asked["id"]}"'] if "id" in asked else []
    if "dateline" in asked and horizon is not None:
        parts.append(f'dateline="db.{horizon}"')
    if "cost" in asked:
        parts.append(f'cost="te={round(1000 * (time.monotonic() - began))}"')
    return "".join(" " + p for p in parts)


def session(store, text: str) -> str:
    """The reply to one read request: ``ok`` and the result, or ``error`` and its code."""
    mark, began = "", time.monotonic()
    try:
        request = parse(text)
        mark = f' id="{request.modifiers["id"]}"' if "id" in request.modifiers else ""
        horizon = None
        if "dateline" in request.modifiers:
            horizon = (store.primitives.agg(F.max("id")).collect()[0][0] or -1) + 1
        checked(request, horizon)
        body = read(store, request)
        return f"ok{marks(request, horizon, began)} {body}"
    except RequestError as e:
        return f'error {e.code}{mark} "{e}"'
