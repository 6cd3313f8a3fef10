"""Templates in Python: the same tree that the parser makes of text.

    find("customer").count_of(link("right", "orders.o_custkey"), at_least=3).returning("guid", "name")
"""

from __future__ import annotations

from copy import deepcopy

from pyspark.sql import DataFrame

from .plans.compiler import Compiler
from .plans.semantic import completed
from .plans.tree import Constraint, Pattern, Predicate, rows


class Template:
    """A constraint; every method returns a new one."""

    def __init__(self, constraint: Constraint | None = None):
        self.constraint = constraint or Constraint()

    def _with(self, **lists) -> Template:
        c = deepcopy(self.constraint)
        for name, more in lists.items():
            old = getattr(c, name)
            if isinstance(old, list) and isinstance(more, list):
                old.extend(more)
            elif isinstance(old, dict):
                old.update(more)
            else:
                setattr(c, name, more)
        return Template(c)

    def where(self, field: str, op: str, *values: str | None) -> Template:
        return self._with(predicates=[Predicate(field, op, list(values))])

    def comparing(self, name: str) -> Template:
        return self._with(comparators={"value-comparator": [name]})

    def live(self, how: str) -> Template:
        return self._with(flags={"live": how})

    def child(self, child: Template, optional: bool = False) -> Template:
        c = deepcopy(child.constraint)
        c.optional |= optional
        return self._with(children=[c])

    def without(self, child: Template) -> Template:
        return self.count_of(child, at_most=0)

    def count_of(self, child: Template, at_least: int | None = None, at_most: int | None = None) -> Template:
        c = deepcopy(child.constraint)
        c.count += [(">=", at_least)] if at_least is not None else []
        c.count += [("<=", at_most)] if at_most is not None else []
        return self._with(children=[c])

    def either(self, head: Template, tail: Template) -> Template:
        return self._with(choices=[(deepcopy(head.constraint), deepcopy(tail.constraint))])

    def let(self, name: str, field: str) -> Template:
        return self._with(variables=[(f"${name}", _pattern(field))])

    def returning(self, *items: str) -> Template:
        p = rows()
        p.items[0].items = [_pattern(x) for x in items]
        return self._with(result=p)

    def sorted_by(self, *items: str, comparator: str | None = None) -> Template:
        keys = []
        for x in items:
            p = _pattern(x.lstrip("-"))
            p.descending = x.startswith("-")
            keys.append(p)
        out = self._with(sort=keys)
        return out._with(comparators={"sort-comparator": [comparator]}) if comparator else out

    def page(self, size: int, start: int = 0) -> Template:
        return self._with(pages={"pagesize": size, "start": start})

    def table(self, store, before: int | None = None) -> DataFrame:
        """The matches; without ``page`` all of them."""
        return Compiler(store, before, None).table(completed(deepcopy(self.constraint)))


def _pattern(x: str) -> Pattern:
    return Pattern("var", x) if x.startswith("$") else Pattern("field", x)


def find(*types: str) -> Template:
    return Template(Constraint(predicates=[Predicate("type", "=", list(types))] if types else []))


def link(end: str, *types: str) -> Template:
    """Primitives whose ``end`` (left, right, scope, typeguid) is the parent."""
    t = find(*types)
    t.constraint.linkage = ("from", end)
    return t


def end(name: str, *types: str) -> Template:
    """The primitive that the parent's linkage ``name`` points to."""
    t = find(*types)
    t.constraint.linkage = ("to", name)
    return t
