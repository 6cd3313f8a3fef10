"""Syntax tree of a request, shared by the parser and the Python builder."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Fields of a primitive that a pattern or a sort may name, and names of values of a whole set.
ROW_FIELDS = ("guid", "type", "typeguid", "name", "value", "datatype", "valuetype", "scope", "left", "right", "live", "archival", "timestamp", "generation", "previous", "next", "meta", "contents", "none")
SET_FIELDS = ("count", "cursor", "estimate", "estimate-count", "iterator", "timeout")
LINKAGES = ("typeguid", "right", "left", "scope")


@dataclass
class Pattern:
    """kind: field, var, literal or list."""

    kind: str
    name: str = ""
    items: list[Pattern] = field(default_factory=list)
    descending: bool = False
    default: bool = False  # the pattern of a read without result=

    def names(self, kind: str) -> set[str]:
        own = {self.name} if self.kind == kind else set()
        return own.union(*(i.names(kind) for i in self.items)) if self.items else own

    def depth(self) -> int:
        return 1 + max((i.depth() for i in self.items), default=0) if self.kind == "list" else 0


@dataclass
class Predicate:
    name: str
    op: str
    values: list[str | None]


@dataclass
class Constraint:
    linkage: tuple[str, str] | None = None  # ("from", "left"): it points to its parent; ("to", "left"): the parent points to it
    arrow: str | None = None
    predicates: list[Predicate] = field(default_factory=list)
    flags: dict[str, str] = field(default_factory=dict)  # live, archival
    newest: list[tuple[str, int]] = field(default_factory=list)
    oldest: list[tuple[str, int]] = field(default_factory=list)
    count: list[tuple[str, int]] = field(default_factory=list)
    optional: bool = False
    false: bool = False
    pages: dict[str, int] = field(default_factory=dict)  # start, pagesize, resultpagesize, countlimit
    cursor: str | None = None
    sort: list[Pattern] | None = None
    comparators: dict[str, list[str]] = field(default_factory=dict)  # comparator, value-comparator, sort-comparator
    result: Pattern | None = None
    variables: list[tuple[str, Pattern]] = field(default_factory=list)
    children: list[Constraint] = field(default_factory=list)
    choices: list[tuple[Constraint, Constraint | None]] = field(default_factory=list)
    key: list[str] | None = None
    unique: list[str] | None = None
    anchor: str | None = None


@dataclass
class Request:
    verb: str
    root: Constraint | None = None
    modifiers: dict[str, str] = field(default_factory=dict)
    arguments: list = field(default_factory=list)


def fields(*names: str) -> Pattern:
    return Pattern("list", items=[Pattern("field", n) for n in names])


def rows(*names: str) -> Pattern:
    """One list a match."""
    return Pattern("list", items=[fields(*names)])
