"""Set algebra on ids, and the two semi-joins along a linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ids(rows: DataFrame, column: str = "id") -> DataFrame:
    return rows.select(F.col(column).alias("id")).filter(F.col("id").isNotNull())


def union(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out.distinct()


def intersection(*sets: DataFrame) -> DataFrame:
    """Ids of all of the sets; each further set only filters the first."""
    out = sets[0].distinct()
    for s in sets[1:]:
        out = out.join(s, "id", "left_semi")
    return out


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b, "id", "left_anti")


def isa(rows: DataFrame, linkage: str) -> DataFrame:
    """The distinct ids that ``rows`` point to by ``linkage``."""
    return ids(rows, linkage).distinct()


def linksto(rows: DataFrame, linkage: str, targets: DataFrame) -> DataFrame:
    """The ``rows`` whose ``linkage`` points into ``targets``."""
    return rows.join(targets.select(F.col("id").alias(linkage)), linkage, "left_semi")
