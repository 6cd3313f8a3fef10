"""Primitives at rest: Parquet in folders by type, with the version columns worked out once.

A template that names types reads their folders alone; row groups sorted by id serve datelines and
timestamps by their statistics. Only ``asof`` works the versions out anew, over what was there then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .primitives import SCHEMA, Store, unversioned, versioned


def save(primitives: DataFrame, path: str, single: bool = False, rows_per_file: int = 5_000_000) -> None:
    """Write ``primitives``; a type of very many rows becomes many files, dealt by ranges of ids."""
    derived = (unversioned if single else versioned)(primitives.select(*[f.name for f in SCHEMA]))
    derived = derived.withColumn("kind", F.coalesce("typeguid", F.lit(-1)))
    dealt = derived.repartitionByRange("kind", "id").sortWithinPartitions("kind", "id")
    dealt.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).partitionBy("kind").parquet(path)


def save_more(rows: DataFrame, path: str, saved: Saved) -> None:
    """Append a batch of numbered primitives to the store at ``path``.

    Only lineages that the batch goes on with have their version columns worked out anew: their old
    rows are written again as corrections, and a reader takes the row of the latest batch. Batches are
    folders of their own, so a write that fails leaves the store as it was.
    """
    touched = saved.rows.join(rows.select("lineage").distinct(), "lineage", "left_semi").select(*[f.name for f in SCHEMA])
    batch = saved.batch + 1
    every = versioned(touched.unionByName(rows)).withColumn("kind", F.coalesce("typeguid", F.lit(-1)))
    every.repartitionByRange("kind", "id").sortWithinPartitions("kind", "id").write.mode("errorifexists").partitionBy("kind").parquet(f"{path.rstrip('/')}-batches/batch={batch}")


class Saved(Store):
    """The store under ``path``."""

    def __init__(self, spark: SparkSession, path: str, types: dict[str, int], single: bool = False):
        self.rows, self.types, self.single, self.batch = spark.read.parquet(path), types, single, 0
        found = _batches(spark, f"{path.rstrip('/')}-batches")
        if found:
            self.single, self.batch = False, max(found)
            folder = f"{path.rstrip('/')}-batches"
            more = spark.read.option("basePath", folder).parquet(*(f"{folder}/batch={n}" for n in found))
            # of a row that batches have corrected the last counts; rows that none has touched need no shuffle
            last = more.groupBy("id").agg(F.max_by(F.struct(*[c for c in more.columns if c != "id"]), "batch").alias("r"))
            untouched = self.rows.join(last.select("id"), "id", "left_anti")
            self.rows = untouched.unionByName(last.select("id", "r.*").select(*self.rows.columns))

    @property
    def primitives(self) -> DataFrame:
        return self.rows.select(*[f.name for f in SCHEMA])

    def scan(self, types: frozenset[int] | None, before: int | None = None) -> DataFrame:
        if before is not None and not self.single:
            out = versioned(self.primitives.filter(F.col("id") < before))
            return out.filter(F.col("typeguid").isin(*types)) if types is not None else out
        out = self.rows.filter(F.col("kind").isin(*types)) if types is not None else self.rows
        out = out.filter(F.col("id") < before) if before is not None else out
        return out.drop("kind")


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete batches under ``path``."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath() for s in files.listStatus(folder)]
    return sorted(int(p.getName().partition("=")[2]) for p in names if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
