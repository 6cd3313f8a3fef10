"""The table of primitives: schema, derived columns, the dump format."""

from __future__ import annotations

import atexit
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.render import DATATYPES, guid, guid_number, timestamp, timestamp_number
from ..plans.errors import SemanticFault

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("typeguid", T.LongType()), T.StructField("right", T.LongType()),
    T.StructField("left", T.LongType()), T.StructField("scope", T.LongType()), T.StructField("prev", T.LongType()),
    T.StructField("name", T.StringType()), T.StructField("value", T.StringType()), T.StructField("valuetype", T.ShortType()),
    T.StructField("live", T.BooleanType()), T.StructField("archival", T.BooleanType()), T.StructField("txstart", T.BooleanType()),
    T.StructField("ts_raw", T.LongType()), T.StructField("lineage", T.LongType()),
])


def versioned(raw: DataFrame) -> DataFrame:
    """``raw`` with generation (from 0), is_latest and the neighbours' ids, by lineage and id."""
    all_ = Window.partitionBy("lineage")
    w = all_.orderBy("id")
    return raw.withColumns({
        "generation": (F.row_number().over(w) - 1).cast("int"),
        "from_latest": (F.count("*").over(all_) - F.row_number().over(w)).cast("int"),
        "prev_id": F.lag("id").over(w), "next_id": F.lead("id").over(w),
    })


def unversioned(raw: DataFrame) -> DataFrame:
    """The same columns where every primitive is alone in its lineage: no window, no shuffle."""
    none = F.lit(None).cast("long")
    return raw.withColumns({"generation": F.lit(0), "from_latest": F.lit(0), "prev_id": none, "next_id": none})


@dataclass
class Store:
    """Primitives and the names of their types (schema-sized, so kept on the driver).

    single: no primitive has a second version, so generations need no window.
    """

    primitives: DataFrame
    types: dict[str, int] = field(default_factory=dict)
    single: bool = False

    def scan(self, types: frozenset[int] | None, before: int | None = None) -> DataFrame:
        """Candidates of the given types (None: all), with versions as of id ``before`` (exclusive)."""
        raw = self.primitives
        if before is not None:
            raw = raw.filter(F.col("id") < before)
        if self.single:
            return unversioned(raw.filter(F.col("typeguid").isin(*types)) if types is not None else raw)
        # versions of one lineage may differ in type: generations come before the type
        out = versioned(raw)
        return out.filter(F.col("typeguid").isin(*types)) if types is not None else out

    def origin(self, types: frozenset[int] | None) -> str | None:
        """The physical table that candidates of these types are rows of, if a child may be of the same row."""
        return None

    def type_ids(self, name: str) -> int:
        """The id of a type name; -1, which no primitive has, for an unknown one."""
        return self.types.get(name, -1)


def frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Primitives from dictionaries, with the defaults of the format."""
    full = []
    for r in rows:
        r = dict(r)
        r.setdefault("live", True)
        r.setdefault("archival", True)
        r.setdefault("txstart", True)
        r.setdefault("ts_raw", r["id"])
        r.setdefault("lineage", r["id"])
        r.setdefault("valuetype", 2 if r.get("value") is not None else 1)
        full.append(tuple(r.get(f.name) for f in SCHEMA))
    return spark.createDataFrame(full, SCHEMA)


# --- dump format 6: one parenthesised record a line -------------------------------------------------


def _quoted(name: str):
    c = F.col(name)
    body = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def dump(primitives: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """One text column ``record`` for ids in [start, end), the fields in the format's order."""
    if end is not None and start > end:
        raise SemanticFault(f"start {start} exceeds end {end}")
    rows = primitives.filter(F.col("id") >= start)
    rows = rows.filter(F.col("id") < end) if end is not None else rows
    link = lambda n: F.coalesce(guid(F.col(n)), F.lit("null"))
    flag = lambda n: F.col(n).cast("string")
    kinds = F.coalesce(*[F.when(F.col("valuetype") == n, F.lit(x)) for n, x in enumerate(DATATYPES, 1)], F.col("valuetype").cast("string"))
    parts = [guid(F.col("id")), link("typeguid"), _quoted("name"), kinds, _quoted("value"), link("scope"), flag("live"), flag("archival"), flag("txstart"), timestamp(F.col("ts_raw")), link("left"), link("right"), link("prev")]
    return rows.select("id", F.concat(F.lit("("), F.concat_ws(" ", *parts), F.lit(")")).alias("record"))


_TEXT = r'(?:null|"(?:[^"\\]++|\\.)*+")'  # possessive, so that long texts take no stack
_FIELD = r'(?s)"(?:[^"\\]++|\\.)*+"|[^ ]+'
#: Of each format, whether the type stands as its name and whether there is a first-of-write flag.
FORMATS = {"1": (True, False), "2": (False, False), "5": (False, False), "6": (False, True)}


def _pattern(version: str | None) -> str:
    """What whole records of a format match (None: those of 5 and 6, of which no record fits both)."""
    by_name, first = FORMATS[version or "6"]
    flag = r" \w+" if version and first else "" if version else r"(?: \w+)?"
    head = " ".join([r"\w+", _TEXT if by_name else r"\w+", _TEXT, r"\w+", _TEXT, r"\w+", r"\w+", r"\w+"])
    return r"(?s)^\(" + head + flag + r" \d\S+Z? \w+ \w+ \w+\)$"


def unescaped(c: Column) -> Column:
    """What a quoted text stands for: each escape is taken as it is met, from left to right."""
    bits = F.regexp_extract_all(c, F.lit(r"(?s)\\.|[^\\]+"), F.lit(0))
    return F.array_join(F.transform(bits, lambda b: F.when(b == "\\n", "\n").when(b.startswith("\\"), F.substring(b, 2, 1)).otherwise(b)), "")


def restore(lines: DataFrame, record: str = "record", version: str | None = None) -> DataFrame:
    """Primitives from dump records of a format (None: 5 or 6, each record by its fields).

    A record that does not parse stops the job. Without a first-of-write flag a record is the first
    of its write. A type given by name is the first record without a type that has this name (null if
    there is none). Lineages follow ``prev``: chains are
    followed by doubling, each turn from a written table, so the plan never grows.
    """
    whole = F.col(record)
    body, usual = F.substring(whole, F.lit(2), F.length(whole)), version or "6"
    # a record with no more spaces than its format has is split at them; one with spaces in its texts field by field
    spaces = F.length(whole) - F.length(F.replace(whole, F.lit(" "), F.lit("")))
    plain = (spaces == (12 if FORMATS[usual][1] else 11)) & whole.rlike(_pattern(usual))
    blank = F.coalesce(F.trim(whole), F.lit("")) == ""
    found = F.when(plain, F.split(body, " ")).when(whole.rlike(_pattern(version)), F.regexp_extract_all(body, F.lit(_FIELD), F.lit(0)))
    found = found.when(blank, F.lit(None)).otherwise(F.raise_error(F.lit("not a dump record")))
    f = F.col("_fields")
    part = {n: f[i] for i, n in enumerate(("id", "typeguid", "name", "kind", "value", "scope", "live", "archival"))}
    part |= {n: F.element_at(f, i) for i, n in ((-4, "stamp"), (-3, "left"), (-2, "right"))}
    part["prev"] = F.rtrim(F.element_at(f, -1), F.lit(")\n\r\u0085\u2028\u2029"))  # the pattern's end lets a line's end pass

    def number(n: str) -> Column:
        return F.when(part[n] != "null", F.conv(F.right(part[n], F.lit(15)), 16, 10).cast("long"))

    def text(n: str) -> Column:
        inner = F.substring(part[n], F.lit(2), F.length(part[n]) - 2)
        return F.when(part[n] != "null", F.when(part[n].contains("\\"), unescaped(inner)).otherwise(inner))

    kind = F.coalesce(*[F.when(part["kind"] == x, F.lit(n)) for n, x in enumerate(DATATYPES, 1)], part["kind"].try_cast("int"))
    stamp = F.shiftleft(F.unix_timestamp(F.to_timestamp(F.substring(part["stamp"], 1, 19), "yyyy-MM-dd'T'HH:mm:ss")), 16) + F.regexp_extract(part["stamp"], r"\.(\d+)Z?$", 1).cast("long")
    made = lines.select(found.alias("_fields")).select(
        number("id").alias("id"), (text if version and FORMATS[version][0] else number)("typeguid").alias("typeguid"), number("right").alias("right"), number("left").alias("left"), number("scope").alias("scope"), number("prev").alias("prev"), text("name").alias("name"), text("value").alias("value"),
        kind.cast("short").alias("valuetype"), (part["live"] == "true").alias("live"), (part["archival"] == "true").alias("archival"), F.when(F.size(f) == 13, f[8] == "true").otherwise(True).alias("txstart"), stamp.alias("ts_raw"),
    )
    spark = lines.sparkSession
    rows = written(made).filter("id is not null")  # blank lines go here: before, the records would be made again for it
    if version and FORMATS[version][0]:
        types = rows.filter("typeguid is null and name is not null").groupBy(F.col("name").alias("typeguid")).agg(F.min("id").alias("_type"))
        rows = rows.join(types, "typeguid", "left").drop("typeguid").withColumnRenamed("_type", "typeguid")
    alone = rows.filter("prev is null").withColumn("lineage", F.col("id"))
    chains = written(rows.filter("prev is not null").select("id", F.col("prev").alias("root")))
    while True:
        up = chains.select(F.col("id").alias("root"), F.col("root").alias("up"))
        after = written(chains.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        discard(spark, chains)
        chains = after
        if not after.filter("moved").limit(1).count():
            break
    later = rows.filter("prev is not null").join(chains.select("id", F.col("root").alias("lineage")), "id")
    return alone.unionByName(later).select(*[c.name for c in SCHEMA])


def shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, where that is unset, one under /tmp/checkpoints."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return found


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, cut off from its plan; it goes at exit or by ``discard``."""
    spark = df.sparkSession
    path = f"{shared(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Remove a ``written`` table that nothing reads any more."""
    _remove(spark, df._path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the context may be gone at exit; the folder is then the cluster's to clear
        pass


__all__ = ["SCHEMA", "Store", "dump", "frame", "guid_number", "restore", "timestamp_number", "unversioned", "versioned"]
