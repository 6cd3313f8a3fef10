"""Templates to DataFrame plans.

Every constraint is a filtered scan of primitives. A child is aggregated by the link that ties it to
its parent and joined once: inner if something of it is wanted, left if it may be missing, semi or
anti if only its existence counts. A child that is of its parent's own physical row is not joined
at all: it becomes columns of the parent's scan. Ordering within a parent is a window whose limit Spark pushes
below the sort; samples without an order are ``min_by`` over ids, which combine before the shuffle.
Compiling starts no job, but for an ``asof`` that is a timestamp (one id is looked up).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import collate, render
from ..sources.primitives import Store
from .errors import SemanticFault
from .semantic import PAGE, bounds, completed, page, used
from .tree import LINKAGES, SET_FIELDS, Constraint, Pattern, Request

_TEXTS = {"name", "value", "type"}


@dataclass
class Scope:
    """What a row of a constraint knows besides its own fields."""

    variables: dict[str, Column] = field(default_factory=dict)
    contents: list[str] = field(default_factory=list)  # columns with the children's results
    meta_back: bool = False  # the row is a link seen from its right end
    origin: str | None = None  # the physical table of the row, if its columns are there


def all_of(parts: list[Column]) -> Column:
    return reduce(Column.__and__, parts) if parts else F.lit(True)


class Compiler:
    def __init__(self, store: Store, before: int | None = None, default_page: int | None = PAGE):
        self.store, self.before, self.default_page = store, before, default_page
        self.serial = 0

    def fresh(self) -> int:
        self.serial += 1
        return self.serial

    # --- one constraint's rows

    def matches(self, c: Constraint, wanted: frozenset[str], contents: bool) -> tuple[DataFrame, Scope]:
        types = self.types(c)
        origin = self.store.origin(types)
        df = self.store.wide(types, self.before) if origin else self.store.scan(types, self.before)
        scope = Scope(meta_back=c.linkage == ("from", "right"), origin=origin)
        conditions = [*(self.implied(c, types) if origin else []), *self.intrinsic(c)]
        if conditions:
            df = df.filter(all_of(conditions))
        df = self.related(df, c)
        below = wanted | used(c)
        for child in c.children:
            df, _ = self.attach(df, scope, child, below, contents, required=True)
        for head, tail in c.choices:
            df, ok = self.choice(df, scope, head, tail, below, contents)
            df = df.filter(ok)
        for name, p in self.ordered(c):
            scope.variables[name] = self.row(p, scope)
        return df, scope

    @staticmethod
    def ordered(c: Constraint) -> list[tuple[str, Pattern]]:
        """Own variables, those first that others use."""
        left, done, out = list(c.variables), set(), []
        own = {n for n, _ in left}
        while left:
            ready = [(n, p) for n, p in left if not (p.names("var") & own - done)]
            if not ready:
                raise SemanticFault("variables are defined by one another")
            out += ready
            done |= {n for n, _ in ready}
            left = [x for x in left if x not in ready]
        return out

    def types(self, c: Constraint) -> frozenset[int] | None:
        """Type ids that a candidate can have, as far as the constraint says."""
        out: frozenset[int] | None = None
        for p in c.predicates:
            ids = None
            if p.name == "type" and p.op == "=" and None not in p.values:
                ids = frozenset(self.store.type_ids(v) for v in p.values)
            elif p.name == "typeguid" and p.op == "=" and None not in p.values:
                ids = frozenset(render.guid_number(v) for v in p.values)
            if ids is not None:
                out = ids if out is None else out & ids
        for head, tail in c.choices:
            both = [self.types(branch) if branch else frozenset() for branch in (head, tail)]
            if None not in both:  # each branch says its types
                ids = both[0] | both[1]
                out = ids if out is None else out & ids
        return out

    def intrinsic(self, c: Constraint) -> list[Column]:
        out: list[Column] = [F.lit(False)] if c.false else []
        default = collate.named((c.comparators.get("comparator") or ["default"])[0])
        comparator = collate.named((c.comparators.get("value-comparator") or [default])[0])
        sides: list[str] = []
        for p in c.predicates:
            if p.name in ("name", "value"):
                if p.op in ("<", "<=", ">", ">="):
                    sides.append(p.op[0])
                out.append(self.text(F.col(p.name), p.op, p.values, comparator if p.name == "value" else "default"))
            elif p.name == "type":
                ids = [self.store.type_ids(v) if v is not None else None for v in p.values]
                out.append(self.ids(F.col("typeguid"), p.op, ids))
            elif p.name in (*LINKAGES, "guid", "previous", "next") and p.op != "~=":
                column = {"guid": "id", "previous": "prev_id", "next": "next_id"}.get(p.name, p.name)
                out.append(self.ids(F.col(column), p.op, [None if v is None else render.guid_number(v) for v in p.values]))
            elif p.name == "timestamp":
                out.append(self.moment(p.op, p.values[0]))
            elif p.name == "dateline":
                n = dateline(p.values[0])
                out.append(F.col("id") < n if p.op == "<" else F.col("id") >= n)
            elif p.name == "valuetype":
                out.append(F.col("valuetype") == render.datatype_number(p.values[0]))
        if any(sides.count(s) > 1 for s in "<>"):
            raise SemanticFault("a constraint has one upper and one lower bound at most")
        for name in ("live", "archival"):
            if c.flags.get(name, "dontcare") != "dontcare":
                out.append(F.col(name) == (c.flags[name] == "true"))
        for name, column in (("newest", "from_latest"), ("oldest", "generation")):
            if pairs := getattr(c, name):
                lo, hi = bounds(pairs, 0, None)
                if hi is not None and lo > hi:
                    out.append(F.lit(False))
                elif not (self.store.single and lo == 0):  # a single version meets every bound that 0 meets
                    out.append(F.col(column) >= lo if hi is None else F.col(column).between(lo, hi))
        return out

    def implied(self, c: Constraint, types: frozenset[int]) -> list[Column]:
        """What the conditions on the value imply for the column it is made of."""
        default = collate.named((c.comparators.get("comparator") or ["default"])[0])
        comparator = collate.named((c.comparators.get("value-comparator") or [default])[0])
        known = [(p.op, p.values[0]) for p in c.predicates if p.name == "value" and len(p.values) == 1 and p.values[0] is not None]
        return [x for op, text in known for x in self.store.implied(types, op, text, comparator)]

    @staticmethod
    def text(c: Column, op: str, values: list[str | None], comparator: str) -> Column:
        if op == "=":
            words = [v for v in values if v is not None]
            parts = [F.coalesce(collate.compared(c, "=", v, comparator), F.lit(False)) for v in words]
            if comparator == "octet" and words:
                parts = [F.coalesce(c.isin(*words), F.lit(False))]
            return reduce(Column.__or__, parts + [c.isNull()] * (None in values))
        if op == "!=":
            return all_of([c.isNotNull() if v is None else collate.compared(c, "!=", v, comparator) for v in values])
        if None in values:
            raise SemanticFault(f"null can't be compared by {op}")
        if op == "~=":
            return reduce(Column.__or__, [collate.compared(c, op, v, comparator) for v in values])
        return all_of([collate.compared(c, op, v, comparator) for v in values])  # of a set, the strictest bound

    @staticmethod
    def ids(c: Column, op: str, values: list[int | None]) -> Column:
        known = [v for v in values if v is not None]
        if op == "=":
            return reduce(Column.__or__, [c.isin(*known)] * bool(known) + [c.isNull()] * (None in values))
        return all_of([F.coalesce(~c.isin(*known), F.lit(True))] * bool(known) + [c.isNotNull()] * (None in values))

    @staticmethod
    def moment(op: str, text: str) -> Column:
        low, high = render.timestamp_number(text), render.timestamp_number(text, last="." not in text)
        c = F.col("ts_raw")
        return {"<": c < low, "<=": c <= high, "=": c.between(low, high), "!=": ~c.between(low, high), ">": c > high, ">=": c >= low}[op]

    def related(self, df: DataFrame, c: Constraint) -> DataFrame:
        """``~=`` of ids: any version of the ids named (their number is the query's)."""
        for p in c.predicates:
            if p.op == "~=" and p.name not in ("name", "value"):
                ids = [render.guid_number(v) for v in p.values if v is not None]
                every = self.store.scan(None, self.before)
                lineages = every.filter(F.col("id").isin(*ids)).select("lineage")
                if p.name == "guid":
                    df = df.join(lineages.distinct(), "lineage", "left_semi")
                else:
                    versions = every.join(lineages.distinct(), "lineage", "left_semi").select(F.col("id").alias("_version"))
                    df = df.join(versions, F.col(p.name) == F.col("_version"), "left_semi")
        return df

    # --- children

    def attach(self, df: DataFrame, scope: Scope, child: Constraint, wanted: frozenset[str] | set[str], contents: bool, required: bool) -> tuple[DataFrame, Column]:
        """Join a child; ``required``: rows that its count excludes go, else the second value tells."""
        way, linkage = child.linkage
        near, far = ("id", linkage) if way == "from" else (linkage, "id")
        start = child.pages.get("start", 0)
        lo, hi = bounds(child.count, start + 1, None)
        lo = 0 if child.optional else lo
        exported = frozenset(wanted) & self.exports(child)
        result = contents and not (child.result.kind == "list" and not child.result.items)
        if scope.origin and not start and not any(p.op == "~=" and p.name not in ("name", "value") for p in child.predicates):
            name = self.store.same_row(scope.origin, self.types(child), child.linkage)
            if name:
                return self.fused(df, scope, child, name, wanted, exported, contents, result, required, lo, hi)
        n = self.fresh()
        k = f"k{n}"
        joined = F.col(near) == F.col(k)
        if required and not exported and not result and (lo, hi) in ((1, None), (0, 0)):
            inner, _ = self.matches(child, frozenset(), False)
            keys = inner.select(F.col(far).alias(k)).filter(F.col(k).isNotNull())
            return df.join(keys, joined, "left_semi" if lo else "left_anti"), F.lit(True)
        inner, below = self.matches(child, frozenset(exported), contents and "contents" in self.names(child))
        if way == "to" and not start:
            small = self.single(inner, below, child, n, exported, result)
        else:
            small = self.grouped(inner, below, child, far, n, exported, result, counted=(lo, hi) not in ((1, None), (0, None)))
        df = df.join(small, joined, "inner" if required and lo > 0 else "left").drop(k)
        for name in exported:
            scope.variables[name] = F.col(f"x{n}_{name[1:]}")
        if result:
            scope.contents.append(f"r{n}")
        count = F.coalesce(F.col(f"n{n}"), F.lit(0))
        ok = (count >= lo) if hi is None else count.between(lo, hi)
        if required:
            return (df.filter(ok) if hi is not None or lo > 1 else df), F.lit(True)
        return df, ok

    def fused(self, df: DataFrame, scope: Scope, child: Constraint, name: str, wanted, exported, contents: bool, result: bool, required: bool, lo: int, hi: int | None) -> tuple[DataFrame, Column]:
        """``attach`` of a child that is of its parent's own row: its columns take the parent's place while it is worked out."""
        n = self.fresh()
        there, cells = self.store.lifted(name)
        parent = list(cells)
        df = df.withColumnsRenamed({x: f"p{n}_{x}" for x in parent}).withColumns(cells)
        own = Scope(meta_back=child.linkage == ("from", "right"), origin=scope.origin)
        conditions = [there, *self.intrinsic(child)]
        if self.before is not None:
            conditions.append(F.col("id") < self.before)
        must = required and lo == 1 and (hi is None or hi >= 1)
        if must:
            df = df.filter(all_of([*self.implied(child, self.types(child)), *conditions]))
        ok = F.lit(True) if must else all_of(conditions)
        below = set(wanted) | used(child)
        for x in child.children:
            df, part = self.attach(df, own, x, below, contents and "contents" in self.names(child), required=must)
            ok = ok & part
        for head, tail in child.choices:
            df, part = self.choice(df, own, head, tail, below, contents)
            if must:
                df = df.filter(part)
            ok = ok & part
        df = df.withColumn(f"n{n}", F.when(F.coalesce(ok, F.lit(False)), F.lit(1).cast("long")))
        for x, p in self.ordered(child):
            own.variables[x] = self.row(p, own)
        made = self.alone(own, child, n, exported, result)
        df = df.withColumns({x: F.when(F.col(f"n{n}").isNotNull(), c) for x, c in made.items()})
        df = df.drop(*parent).withColumnsRenamed({f"p{n}_{x}": x for x in parent})
        for x in exported:
            scope.variables[x] = F.col(f"x{n}_{x[1:]}")
        if result:
            scope.contents.append(f"r{n}")
        count = F.coalesce(F.col(f"n{n}"), F.lit(0))
        ok = (count >= lo) if hi is None else count.between(lo, hi)
        return (df if must else df.filter(ok), F.lit(True)) if required else (df, ok)

    @staticmethod
    def names(c: Constraint) -> set[str]:
        out = c.result.names("field") if c.result else set()
        return out.union(*(p.names("field") for _, p in c.variables), *(p.names("field") for p in c.sort or ()))

    def exports(self, c: Constraint) -> set[str]:
        out = {n for n, _ in c.variables}
        return out.union(*(self.exports(x) for x in c.children), *(self.exports(h) | (self.exports(t) if t else set()) for h, t in c.choices))

    def choice(self, df, scope: Scope, head: Constraint, tail: Constraint | None, wanted, contents: bool) -> tuple[DataFrame, Column]:
        """The first branch that holds counts; variables of the others stay null."""
        found = []
        for branch in (head, tail):
            own = Scope(meta_back=scope.meta_back, origin=scope.origin)
            if branch is None:
                found.append((F.lit(False), own))
                continue
            ok = all_of(self.intrinsic(branch))
            for child in branch.children:
                df, part = self.attach(df, own, child, set(wanted) | used(branch), contents, required=False)
                ok = ok & part
            for h, t in branch.choices:
                df, part = self.choice(df, own, h, t, wanted, contents)
                ok = ok & part
            own.contents = [*own.contents]
            n = self.fresh()
            df = df.withColumn(f"b{n}", F.coalesce(ok, F.lit(False)))
            for name, p in self.ordered(branch):
                own.variables[name] = self.row(p, own)
            found.append((F.col(f"b{n}"), own))
        (first, a), (second, b) = found
        for name in [*a.variables, *(x for x in b.variables if x not in a.variables)]:
            value = F.when(first, a.variables[name]) if name in a.variables else None
            other = F.when(~first & second, b.variables[name]) if name in b.variables else None
            both = F.coalesce(value, other) if value is not None and other is not None else value if value is not None else other
            n = self.fresh()
            df = df.withColumn(f"v{n}", both)
            scope.variables[name] = F.col(f"v{n}")
        for ok, own in ((first, a), (~first & second, b)):
            for c in own.contents:
                df = df.withColumn(c, F.when(ok, F.col(c)))
                scope.contents.append(c)
        return df, first | second

    # --- values

    def row(self, p: Pattern, scope: Scope) -> Column:
        """A pattern's value for one match."""
        if p.kind == "list":
            return F.struct(*(self.row(x, scope).alias(f"f{i}") for i, x in enumerate(p.items))) if p.items else F.struct(F.lit(None).cast("string").alias("f0"))
        if p.kind == "literal":
            return F.lit(p.name)
        if p.kind == "var":
            return scope.variables.get(p.name, F.lit(None).cast("string"))
        return self.field(p.name, scope)

    def field(self, name: str, scope: Scope) -> Column:
        if name in ("guid", *LINKAGES):
            return render.guid(F.col("id" if name == "guid" else name))
        if name in ("previous", "next"):
            return render.guid(F.col("prev_id" if name == "previous" else "next_id"))
        if name in ("name", "value", "live", "archival", "valuetype"):
            return F.col(name)
        if name == "generation":
            return F.col("generation").cast("long")
        if name == "timestamp":
            return render.timestamp(F.col("ts_raw"))
        if name == "datatype":
            return render.datatype(F.col("valuetype"))
        if name == "type":
            names = [x for n, i in self.store.types.items() for x in (F.lit(i), F.lit(n))]
            return F.element_at(F.create_map(*names), F.col("typeguid")) if names else F.lit(None).cast("string")
        if name == "meta":
            link = F.lit("<-" if scope.meta_back else "->")
            return F.when(F.col("left").isNull() & F.col("right").isNull(), F.lit("node")).otherwise(link)
        if name == "contents":
            if not scope.contents:
                return F.lit(None).cast("string")
            return F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(scope.contents)))
        return F.lit(None).cast("string")  # none, and values of a set in a row's place

    def order(self, c: Constraint, scope: Scope) -> list[tuple[Column, bool]]:
        """(key, descending) of a constraint's sort, made total by the id."""
        names = c.comparators.get("sort-comparator") or c.comparators.get("comparator") or ["default"]
        out = []
        for i, p in enumerate(c.sort or ()):
            comparator = collate.KEYS[collate.named(names[min(i, len(names) - 1)])]
            if p.kind == "field" and p.name in ("guid", *LINKAGES):
                key = F.col("id" if p.name == "guid" else p.name)
            elif p.kind == "field" and p.name in ("previous", "next"):
                key = F.col("prev_id" if p.name == "previous" else "next_id")
            elif p.kind == "field" and p.name == "timestamp":
                key = F.col("ts_raw")
            elif p.kind == "field" and p.name in ("live", "archival"):
                key = ~F.col(p.name)  # true first
            elif p.kind == "field" and p.name in ("datatype", "valuetype", "generation"):
                key = F.col("generation" if p.name == "generation" else "valuetype")
            elif p.kind == "var" or p.name in _TEXTS or p.name == "meta":
                key = comparator(self.row(p, scope).cast("string"))
            else:
                key = self.row(p, scope)
            out.append((key, p.descending))
            if p.kind == "field" and p.name == "guid":
                return out
        return [*out, (F.col("id"), False)]

    @staticmethod
    def sorted_by(keys: list[tuple[Column, bool]]) -> list[Column]:
        return [k.desc_nulls_first() if down else k.asc_nulls_last() for k, down in keys]

    def alone(self, scope: Scope, c: Constraint, n: int, exported: frozenset[str], result: bool) -> dict[str, Column]:
        """r and x_<variable> of a child with a single match."""
        limit = page(c, self.default_page)[2]

        def built(p: Pattern, depth: int) -> Column:
            if p.kind == "list" and depth == 0:
                return F.struct(*(built(x, 1).alias(f"f{i}") for i, x in enumerate(p.items))) if p.items else F.struct(F.lit(None).cast("string").alias("f0"))
            if p.kind == "list":
                return F.array(self.row(p, scope))
            if p.kind == "field" and p.name in ("count", "estimate-count"):
                return F.lit(1 if limit is None else min(1, limit)).cast("long")
            if p.kind == "field" and p.name == "cursor":
                return F.lit("null:")
            return self.row(p, scope)

        own = {name: p for name, p in c.variables}
        cells = {f"r{n}": built(c.result, 0)} if result else {}
        for name in sorted(exported):
            p = own.get(name)
            cells[f"x{n}_{name[1:]}"] = built(p, 0) if p is not None and p.depth() == 2 else scope.variables[name]
        return cells

    def single(self, df: DataFrame, scope: Scope, c: Constraint, n: int, exported: frozenset[str], result: bool) -> DataFrame:
        """What ``grouped`` makes, for a child that the parent points to: ids are unique, so nothing is aggregated."""
        cells = self.alone(scope, c, n, exported, result)
        return df.select(F.col("id").alias(f"k{n}"), F.lit(1).cast("long").alias(f"n{n}"), *(x.alias(name) for name, x in cells.items()))

    def grouped(self, df: DataFrame, scope: Scope, c: Constraint, key: str | None, n: int, exported: frozenset[str], result: bool, counted: bool) -> DataFrame:
        """k, n, r and x_<variable> columns of a constraint's matches, one row for each value of ``key``."""
        start, size, limit = page(c, self.default_page)
        samples: list[Column] = []
        lists: list[Column] = []
        k = f"k{n}"

        def whole(p: Pattern, depth: int) -> tuple:
            """How to put a pattern together once the group is aggregated."""
            if p.kind == "list" and depth == 0:
                return ("struct", [whole(x, 1) for x in p.items])
            if p.kind == "list":
                lists.append(self.row(p, scope))
                return ("list", len(lists) - 1)
            if p.kind == "field" and p.name in SET_FIELDS:
                return ("set", p.name)
            samples.append(self.row(p, scope))
            return ("sample", len(samples) - 1)

        own = {name: p for name, p in c.variables}
        plan = {"r": whole(c.result, 0)} if result else {}
        for name in sorted(exported):
            p = own.get(name)
            if p is not None and p.depth() == 2:
                plan[name] = whole(p, 0)
            else:
                samples.append(scope.variables[name])
                plan[name] = ("sample", len(samples) - 1)
        marked = "'cursor'" in str(plan)
        uses_count = counted or marked or any("'count'" in str(x) or "estimate-count" in str(x) for x in plan.values())
        placed = bool(c.sort or start or lists or marked)
        base = df.filter(F.col(key).isNotNull()).withColumn(k, F.col(key)) if key else df.withColumn(k, F.lit(0))
        cells = [x.alias(f"s{i}") for i, x in enumerate(samples)] + [x.alias(f"l{i}") for i, x in enumerate(lists)]
        # counts are aggregated apart from a page, so that a page never needs all rows of a key in one task
        counts = base.groupBy(k).agg(F.count("*").alias("_all")) if placed and uses_count and size is not None else None
        if placed:
            keys = self.sorted_by(self.order(c, scope))
            alone = len(samples) == 1 and not (lists or start or uses_count)
            if alone:  # of one sample the first that there is will do
                keys = [samples[0].isNull(), *keys]
            if key is None and size is not None:
                base = base.orderBy(*keys).limit(start + max(size, 1))
            w = Window.partitionBy(k).orderBy(*keys)
            base = base.select(k, F.row_number().over(w).alias("rn"), *cells, *([F.col("id").alias("_last")] if marked else []))
            if alone:
                base = base.filter("rn = 1")
            elif size is not None:
                base = base.filter(F.col("rn") <= start + max(size, 1))
            rank = F.when(F.col("rn") > start, F.col("rn"))
        else:
            base = base.select(k, F.col("id").alias("rn"), *cells)
            rank = F.col("rn")
        shown = F.col("rn") > start
        if size is not None:
            shown = shown & (F.col("rn") <= start + size)
        parts = [F.count("*").alias(f"n{n}")]
        parts += [F.min_by(f"s{i}", F.when(F.col(f"s{i}").isNotNull(), rank)).alias(f"s{i}") for i in range(len(samples))]
        parts += [F.transform(F.array_sort(F.collect_list(F.when(shown, F.struct("rn", F.col(f"l{i}").alias("x"))))), lambda e: e["x"]).alias(f"l{i}") for i in range(len(lists))]
        if marked:
            parts.append(F.max_by("_last", F.when(shown, F.col("rn"))).alias("_last"))
        out = base.groupBy(k).agg(*parts)
        if counts is not None and key is None:
            out = out.withColumn(f"n{n}", counts.select("_all").scalar())
        elif counts is not None:
            out = out.drop(f"n{n}").join(counts.withColumnRenamed("_all", f"n{n}"), k)
        cut = F.least(F.col(f"n{n}"), F.lit(limit).cast("long")) if limit is not None else F.col(f"n{n}")

        def built(how) -> Column:
            kind, x = how
            if kind == "struct":
                return F.struct(*(built(y).alias(f"f{i}") for i, y in enumerate(x))) if x else F.struct(F.lit(None).cast("string").alias("f0"))
            if kind == "set" and x == "cursor":  # where the next page goes on, or that there is none
                more = F.lit(False) if size is None else F.col(f"n{n}") > start + size
                return F.when(more, F.concat(F.lit('{"after": '), F.col("_last").cast("string"), F.lit("}"))).otherwise("null:")
            if kind == "set":
                return cut if x in ("count", "estimate-count") else F.lit(None).cast("string")
            return F.col(f"{'s' if kind == 'sample' else 'l'}{x}")

        return out.select(k, f"n{n}", *(built(how).alias(f"r{n}" if name == "r" else f"x{n}_{name[1:]}") for name, how in plan.items()))

    # --- the root

    def reply(self, root: Constraint) -> DataFrame:
        """One row (n, r): the number of matches and the result as nested values; no row: no match."""
        df, scope = self.matches(root, frozenset(), "contents" in self.names(root))
        df = self.resumed(df, scope, root)
        out = self.grouped(df, scope, root, None, 0, frozenset(), True, counted=False)
        return out.select(F.col("n0").alias("n"), F.col("r0").alias("r"))

    def table(self, root: Constraint) -> DataFrame:
        """The matches as a flat table, one column an item of the result; ordered and paged.

        A result that is not one list a match gives a single row.
        """
        p = root.result
        if p.kind == "list" and len(p.items) == 1 and p.items[0].kind == "list":
            df, scope = self.matches(root, frozenset(), "contents" in self.names(root))
            df = self.resumed(df, scope, root)
            start, size, _ = page(root, self.default_page)
            cells = self.labelled(p.items[0], scope)
            if root.sort or start or size is not None:
                df = df.orderBy(*self.sorted_by(self.order(root, scope)))
                df = df.offset(start) if start else df
                df = df.limit(size) if size is not None else df
            return df.select(*cells)
        out = self.reply(root)
        items = p.items if p.kind == "list" else [p]
        names = self.labels(items)
        return out.select(*(F.col(f"r.f{i}" if p.kind == "list" else "r").alias(x) for i, x in enumerate(names)))

    @staticmethod
    def labels(items: list[Pattern]) -> list[str]:
        seen: dict[str, int] = {}
        out = []
        for x in items:
            name = (x.name or x.kind).lstrip("$").replace("-", "_") if x.kind != "literal" else "literal"
            seen[name] = seen.get(name, 0) + 1
            out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
        return out

    def labelled(self, p: Pattern, scope: Scope) -> list[Column]:
        return [self.row(x, scope).alias(name) for x, name in zip(p.items, self.labels(p.items))]

    def resumed(self, df: DataFrame, scope: Scope, root: Constraint) -> DataFrame:
        """Rows after the one that a cursor names, in the order of the sort (one row is looked up)."""
        if root.cursor is None:
            return df
        if root.cursor == "null:":
            return df.limit(0)
        try:
            last = int(json.loads(root.cursor)["after"])
        except (ValueError, KeyError, TypeError) as e:
            raise SemanticFault(f"{root.cursor!r} is no cursor") from e
        keys = self.order(root, scope)
        named = df.withColumns({f"_o{i}": k for i, (k, _) in enumerate(keys)})
        mark = named.filter(F.col("id") == last).select(F.struct(*(F.col(f"_o{i}") for i in range(len(keys))))).limit(1).scalar()
        after, tied = F.lit(False), F.lit(True)
        for i, (_, down) in enumerate(keys):
            a, b = F.col(f"_o{i}"), mark[f"_o{i}"]
            greater = F.coalesce(a > b, a.isNull() & b.isNotNull())
            less = F.coalesce(a < b, b.isNull() & a.isNotNull())
            after = after | (tied & (less if down else greater))
            tied = tied & a.eqNullSafe(b)
        return named.filter(mark.isNotNull() & after).drop(*(f"_o{i}" for i in range(len(keys))))


def dateline(text: str) -> int:
    """The number of primitives that a dateline admits: ``database.n`` or a guid (that id excluded)."""
    name, dot, n = text.rpartition(".")
    if dot and n.isdigit():
        return int(n)
    return render.guid_number(text)


def before(store: Store, request: Request) -> int | None:
    """The first id that an ``asof`` hides. A timestamp or a guid includes its primitive, a dateline excludes it."""
    text = request.modifiers.get("asof")
    if text is None:
        return None
    if "." in text and "T" not in text.upper() and "-" not in text:
        return dateline(text)
    if "-" in text or len(text) == 4:
        moment = render.timestamp_number(text, last="." not in text)
        found = store.primitives.filter(F.col("ts_raw") <= moment).agg(F.max("id")).collect()[0][0]
        return 0 if found is None else found + 1
    return render.guid_number(text) + 1


def compile_read(store: Store, request: Request, default_page: int | None = PAGE) -> tuple[Compiler, Constraint]:
    root = completed(request.root, "read")
    return Compiler(store, before(store, request), default_page), root
