"""Relational Parquet tables seen as primitives.

A row is a node; a column is a link from it (``left``) with the column's text as value; a foreign key
is a link without a value that points to the other row's node (``right``). Nothing is unpivoted: each
attribute is a frame of its own, and a template that names types reads only their columns. A template
that asks a row for its attributes gets them from the same scan (``wide`` and ``lifted``), without a join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .primitives import Store

#: Ids: the table's or attribute's number from bit 40 on, the row's key below.
SHIFT = 40
_ATTRIBUTES = 64


@dataclass(frozen=True)
class Attribute:
    column: str
    kind: str  # text, number (two decimals), whole, date, or the table that a foreign key names


@dataclass(frozen=True)
class Table:
    key: str | None  # None: rows are numbered by their place in the files
    name: str | None
    attributes: tuple[Attribute, ...]


def _a(**kinds: str) -> tuple[Attribute, ...]:
    return tuple(Attribute(c, k) for c, k in kinds.items())


TABLES: dict[str, Table] = {
    "region": Table("r_regionkey", "r_name", _a(r_name="text")),
    "nation": Table("n_nationkey", "n_name", _a(n_name="text", n_regionkey="region")),
    "customer": Table("c_custkey", "c_name", _a(c_name="text", c_nationkey="nation", c_acctbal="number", c_mktsegment="text")),
    "supplier": Table("s_suppkey", "s_name", _a(s_name="text", s_nationkey="nation", s_acctbal="number")),
    "part": Table("p_partkey", "p_name", _a(p_name="text", p_brand="text", p_type="text", p_size="whole", p_retailprice="number")),
    "orders": Table("o_orderkey", None, _a(o_custkey="customer", o_orderstatus="text", o_totalprice="number", o_orderdate="date", o_orderpriority="text")),
    "lineitem": Table(None, None, _a(l_orderkey="orders", l_partkey="part", l_suppkey="supplier", l_linenumber="whole", l_quantity="number", l_extendedprice="number", l_returnflag="text", l_linestatus="text", l_shipdate="date")),
    "documents": Table("doc_id", "source", _a(text="text", lang="text")),
}
#: Events are versions: those of one user and type are a lineage, in the order of their ids.
EVENTS = "event"
_NUMBERS = {name: n for n, name in enumerate([*TABLES, EVENTS], 1)}
_LINKS = {f"{t}.{a.column}": n for n, (t, a) in enumerate(((t, a) for t, x in TABLES.items() for a in x.attributes), _ATTRIBUTES)}
TYPES = _NUMBERS | _LINKS
_NAMES = {n: x for x, n in TYPES.items()}
#: Rows of a table without a key are numbered through its files, in the order of their names.
_RAW, _KEY = "_raw_", "_raw_key"
_DECIMAL = re.compile(r"[+-]?\d+(\.\d+)?")


def node_id(table: str, key: Column) -> Column:
    return key.cast("long") + (_NUMBERS[table] << SHIFT)


def node_number(table: str, key: int) -> int:
    return (_NUMBERS[table] << SHIFT) + key


COLUMNS = ["id", "typeguid", "right", "left", "scope", "prev", "name", "value", "valuetype", "live", "archival", "txstart", "ts_raw", "lineage", "generation", "from_latest", "prev_id", "next_id"]


class TableStore(Store):
    """A store whose primitives are derived from ``sf_dir/<table>.parquet`` when they are scanned."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.types, self.single = spark, sf_dir, TYPES, True

    @property
    def primitives(self) -> DataFrame:
        return self.scan(None)

    def check_keys(self) -> None:
        """Raise if a key is negative or has no room below the type's number: ids would collide."""
        for name, t in TABLES.items():
            if t.key:
                lo, hi = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").agg(F.min(t.key), F.max(t.key)).collect()[0]  # from the footers
                if lo is not None and (lo < 0 or hi >= 1 << SHIFT):
                    raise ValueError(f"{name}.{t.key}: {lo} to {hi} has no room in an id")

    def scan(self, types: frozenset[int] | None, before: int | None = None) -> DataFrame:
        names = [n for n, i in TYPES.items() if (types is None or i in types) and n != EVENTS] or ["region"]
        out = reduce(DataFrame.unionByName, [self.link(n) if n in _LINKS else self.node(n) for n in names])
        if types is not None and not types & set(TYPES.values()):
            out = out.filter(F.lit(False))
        return out.filter(F.col("id") < before) if before is not None else out

    # --- a row and its attributes as columns of one scan

    def origin(self, types: frozenset[int] | None) -> str | None:
        """The table, if all candidates are its nodes or all are one of its attributes."""
        name = _NAMES.get(next(iter(types))) if types is not None and len(types) == 1 else None
        return name.partition(".")[0] if name and name != EVENTS else None

    def wide(self, types: frozenset[int], before: int | None = None) -> DataFrame:
        """``scan`` with the columns of the table beside the primitives' own."""
        name = _NAMES[next(iter(types))]
        table = name.partition(".")[0]
        df, key = self.rows(table)
        columns = dict.fromkeys([a.column for a in TABLES[table].attributes] + [TABLES[table].name] * bool(TABLES[table].name))
        raw = df.select(key.alias(_KEY), *(F.col(c).alias(_RAW + c) for c in columns))
        there, cells = self.lifted(name)
        out = raw.filter(there).select("*", *(c.alias(n) for n, c in cells.items()))
        return out.filter(F.col("id") < before) if before is not None else out

    def same_row(self, table: str, types: frozenset[int] | None, linkage: tuple[str, str]) -> str | None:
        """The attribute (or node) that a child of these types is, if it is of its parent's own row."""
        name = _NAMES.get(next(iter(types)), "") if types is not None and len(types) == 1 else ""
        return name if linkage == ("from" if "." in name else "to", "left") and name.partition(".")[0] == table else None

    def lifted(self, name: str) -> tuple[Column, dict[str, Column]]:
        """Whether a row of ``wide`` has the node or attribute, and its primitive's columns."""
        table, _, column = name.partition(".")
        key = F.col(_KEY)
        if not column:
            label = TABLES[table].name
            return F.lit(True), self.cells(_NUMBERS[table], key, **({"name": F.col(_RAW + label)} if label else {}))
        attribute = next(a for a in TABLES[table].attributes if a.column == column)
        c, left = F.col(_RAW + column), node_id(table, key)
        if attribute.kind in TABLES:
            return c.isNotNull(), self.cells(_LINKS[name], key, left=left, right=node_id(attribute.kind, c))
        text = {"number": c.cast("decimal(18,2)"), "date": F.date_format(c, "yyyy-MM-dd")}.get(attribute.kind, c)
        return F.lit(True), self.cells(_LINKS[name], key, left=left, value=text)

    def implied(self, types: frozenset[int] | None, op: str, text: str, comparator: str) -> list[Column]:
        """Plain comparisons of the column of ``wide`` that ``value op text`` implies; they reach the Parquet scan."""
        name = _NAMES.get(next(iter(types)), "") if types is not None and len(types) == 1 else ""
        table, _, column = name.partition(".")
        kind = next((a.kind for a in TABLES[table].attributes if a.column == column), "") if column else ""
        c = F.col(_RAW + column)
        low, high = op in (">", ">=", "="), op in ("<", "<=", "=")
        if kind in ("number", "whole") and comparator in ("number", "default") and _DECIMAL.fullmatch(text):
            bound = float(text)
            slack = 0.01 + abs(bound) * 1e-12  # values are rounded to two decimals
            return [c >= bound - slack] * low + [c <= bound + slack] * high
        if kind == "date" and comparator == "datetime" and re.fullmatch(r"\d{4}(-\d\d){0,2}", text):
            day = F.lit((text + "-01-01")[:10]).cast("date")
            return [c >= day.cast("timestamp_ntz")] * low + [c < F.add_months(day, 13).cast("timestamp_ntz")] * high
        return []

    def rows(self, table: str) -> tuple[DataFrame, Column]:
        df = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
        if TABLES[table].key:
            return df, F.col(TABLES[table].key)
        df = df.withColumns({"_row": F.col("_metadata.row_index"), "_file": F.col("_metadata.file_path")})
        if len(df.inputFiles()) == 1:
            return df, F.col("_row")
        return df.join(self.starts(table), "_file"), F.col("_start") + F.col("_row")

    def starts(self, table: str) -> DataFrame:
        """(_file, _start): rows in the files before each one, from counts that read no column; worked out once."""
        held = self.__dict__.setdefault("_starts", {})
        if table not in held:
            df = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
            sizes = df.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count("*").alias("n")).collect()  # a row a file
            total, found = 0, []
            for r in sorted(sizes):
                found.append((r[0], total))
                total += r[1]
            if total >= 1 << SHIFT:
                raise ValueError(f"{table} has more rows than ids have room for")
            held[table] = self.spark.createDataFrame(found, "_file string, _start long")
        return held[table]

    @staticmethod
    def cells(number: int, key: Column, **fields: Column) -> dict[str, Column]:
        """The columns of a primitive."""
        none = F.lit(None)
        link = lambda n: fields.get(n, none).cast("long")
        value = fields.get("value", none).cast("string")
        ident = key.cast("long") + (number << SHIFT)
        return {
            "id": ident, "typeguid": F.lit(number).cast("long"), "right": link("right"), "left": link("left"), "scope": link("scope"), "prev": none.cast("long"),
            "name": fields.get("name", none).cast("string"), "value": value, "valuetype": F.when(value.isNull(), 1).otherwise(2).cast("short"),
            "live": F.lit(True), "archival": F.lit(True), "txstart": F.lit(True), "ts_raw": ident, "lineage": ident,
            "generation": F.lit(0), "from_latest": F.lit(0), "prev_id": none.cast("long"), "next_id": none.cast("long"),
        }

    def node(self, table: str) -> DataFrame:
        return self.wide(frozenset([_NUMBERS[table]])).select(*COLUMNS)

    def link(self, name: str) -> DataFrame:
        return self.wide(frozenset([_LINKS[name]])).select(*COLUMNS)


class EventStore(Store):
    """Events as versions; an event of value over 40 is a tombstone. Its scope is the user's customer."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.types, self.single = spark, sf_dir, {EVENTS: _NUMBERS[EVENTS]}, False

    @property
    def primitives(self) -> DataFrame:
        return self.scan(None)

    def scan(self, types: frozenset[int] | None, before: int | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
        ident = node_id(EVENTS, F.col("event_id"))
        df = df.withColumn("id", ident)
        df = df.filter(F.col("id") < before) if before is not None else df
        group = Window.partitionBy("user_id", "event_type")
        w = group.orderBy("id")
        n = F.row_number().over(w)
        none = F.lit(None)
        kind = F.lit(_NUMBERS[EVENTS]).cast("long")
        out = df.select(
            "id", kind.alias("typeguid"), none.cast("long").alias("right"), none.cast("long").alias("left"), node_id("customer", F.col("user_id")).alias("scope"), F.lag("id").over(w).alias("prev"),
            F.col("event_type").alias("name"), F.col("value").cast("decimal(18,2)").cast("string").alias("value"), F.lit(2).cast("short").alias("valuetype"), (F.col("value") <= 40).alias("live"),
            F.lit(True).alias("archival"), F.lit(True).alias("txstart"), F.col("id").alias("ts_raw"), F.min("id").over(group).alias("lineage"),
            (n - 1).cast("int").alias("generation"), (F.count("*").over(group) - n).cast("int").alias("from_latest"), F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id"),
        )
        return out if types is None or _NUMBERS[EVENTS] in types else out.filter(F.lit(False))
