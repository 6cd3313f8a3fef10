"""Checks and defaults of a parsed template."""

from __future__ import annotations

from .errors import SemanticFault
from .tree import LINKAGES, SET_FIELDS, Constraint, Pattern, fields, rows

PAGE, MOST = 1024, 65_536
#: What a branch of an OR must leave to its constraint.
_NOT_IN_OR = ("count", "cursor", "linkage", "arrow", "pages", "result", "sort", "comparators")
_UNSORTABLE = SET_FIELDS + ("none",)


def default_result() -> Pattern:
    names = ("meta", "guid", "type", "name", "datatype", "value", "scope", "live", "archival", "timestamp", "right", "left", "contents")
    p = rows(*names)
    p.items[0].default = True
    return p


def completed(c: Constraint, verb: str = "read", parent: Constraint | None = None, branch: bool = False) -> Constraint:
    """The tree with linkages resolved and defaults set; raises SemanticFault.

    A branch of an OR takes no defaults: its constraint has them.
    """
    if c.arrow:
        if c.linkage:
            raise SemanticFault("a constraint has two linkages")
        mine, other = ("left", "right") if c.arrow == "->" else ("right", "left")
        if parent is not None:
            c.linkage = ("from", mine)
        for child in c.children:
            if not child.linkage and not child.arrow:
                child.linkage = ("to", other)
    if parent is not None and not c.linkage and not branch:
        raise SemanticFault("a child says neither which of its links points here nor which link points to it")
    for head, tail in c.choices:
        for branch in (head, tail):
            if branch is None:
                continue
            for name in _NOT_IN_OR:
                if getattr(branch, name):
                    raise SemanticFault(f"{name} can't be used inside an OR")
            completed(branch, verb, None, branch=True)
    if verb == "write":
        if c.result and c.result.names("field") - {"guid", "contents", "none"}:
            raise SemanticFault("a write returns guid, contents, none or literals")
        for p in c.predicates:
            if p.op not in ("=", "~=") or p.op == "~=" and p.name != "guid":
                raise SemanticFault(f"{p.name} {p.op} is a comparison; a write states values with =")
            if len(p.values) > 1:
                raise SemanticFault(f"a write states one value for {p.name}")
        _check_links(c)
        if c.choices:
            raise SemanticFault("a write has no OR")
    elif c.key is not None or c.unique is not None or c.anchor is not None:
        raise SemanticFault("key, unique and anchor are for writes")
    if c.result is None and not branch:
        c.result = default_result() if verb == "read" else fields("guid", "contents")
    for p in c.sort or ():
        if p.kind in ("list", "literal") or p.name in _UNSORTABLE:
            raise SemanticFault(f"can't sort by {p.name or p.kind}")
    names = [n for n, _ in c.variables]
    if len(set(names)) < len(names):
        raise SemanticFault("a variable is assigned twice")
    if not branch:
        c.flags.setdefault("live", "true")
        c.flags.setdefault("archival", "dontcare")
        if not c.newest and not c.oldest:
            c.newest = [("=", 0)]
    for child in c.children:
        completed(child, verb, c)
    if parent is None and verb == "read" and not branch:
        _check_variables(c)
    return c


def _check_links(c: Constraint) -> None:
    """A write names each end of a primitive once: by its id, by its parent, or by one child."""
    given = [p.name for p in c.predicates]
    if "type" in given and "typeguid" in given:
        raise SemanticFault("a write states a type by its name or by its id")
    if "dateline" in given:
        raise SemanticFault("a write has no dateline")
    ends = [x for x in given if x in LINKAGES]
    if c.linkage and c.linkage[0] == "from":
        ends.append(c.linkage[1])
    ends += [(x.linkage or ("", ""))[1] for x in c.children if x.linkage and x.linkage[0] == "to"]
    if twice := {x for x in ends if ends.count(x) > 1}:
        raise SemanticFault(f"{', '.join(sorted(twice))} is stated twice in a write")


def _set_below(c: Constraint) -> set[str]:
    """Variables that the children and branches of ``c`` set, and those ``c`` itself sets."""
    own = {n for n, _ in c.variables}
    for child in c.children:
        own |= _set_below(child)
    for head, tail in c.choices:
        own |= _set_below(head) | (_set_below(tail) if tail else set())
    return own


def used(c: Constraint) -> set[str]:
    out = c.result.names("var") if c.result else set()
    for _, p in c.variables:
        out |= p.names("var")
    for p in c.sort or ():
        out |= p.names("var")
    return out


def _check_variables(c: Constraint) -> None:
    below = set()
    for child in c.children:
        found = _set_below(child)
        if twice := below & found:
            raise SemanticFault(f"{', '.join(sorted(twice))} is assigned in two places")
        below |= found
        _check_variables(child)
    for head, tail in c.choices:
        below |= _set_below(head) | (_set_below(tail) if tail else set())
    if missing := used(c) - below - {n for n, _ in c.variables}:
        raise SemanticFault(f"{', '.join(sorted(missing))} is used but not set below")


def bounds(pairs: list[tuple[str, int]], low: int, high: int | None) -> tuple[int, int | None]:
    """The interval that all of the comparisons leave; none given: the defaults."""
    lo, hi = (low, high) if not pairs else (0, None)
    for op, n in pairs:
        if op in ("=", ">=", ">"):
            lo = max(lo, n + (op == ">"))
        if op in ("=", "<=", "<"):
            m = n - (op == "<")
            hi = m if hi is None else min(hi, m)
    return lo, hi


def page(c: Constraint, default: int | None = PAGE) -> tuple[int, int | None, int | None]:
    """start, results, and what the count is cut to (None: no limit)."""
    start = c.pages.get("start", 0)
    size = c.pages.get("resultpagesize", c.pages.get("pagesize"))
    limit = c.pages.get("countlimit")
    if limit is None and "pagesize" in c.pages:
        limit = start + min(c.pages["pagesize"], MOST)
    return start, min(size, MOST) if size is not None else default, limit
