"""Integrity of a store: what a link names must be there and older, lineages must be whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tree import LINKAGES


def dangling(links: DataFrame, targets: DataFrame, *linkages: str) -> DataFrame:
    """id, linkage, target of links that point to no row of ``targets``."""
    known = targets.select(F.col("id").alias("target"))
    parts = [links.filter(F.col(x).isNotNull()).select("id", F.lit(x).alias("linkage"), F.col(x).alias("target")).join(known, "target", "left_anti") for x in linkages or LINKAGES]
    return reduce(DataFrame.unionByName, parts).select("id", "linkage", "target")


def forward(links: DataFrame, *linkages: str) -> DataFrame:
    """id, linkage, target of links to a primitive that is not older than they are."""
    parts = [links.filter(F.col(x) >= F.col("id")).select("id", F.lit(x).alias("linkage"), F.col(x).alias("target")) for x in linkages or LINKAGES]
    return reduce(DataFrame.unionByName, parts)


def repeated(primitives: DataFrame) -> DataFrame:
    """Ids that several primitives bear."""
    return primitives.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def broken_lineages(primitives: DataFrame) -> DataFrame:
    """Ids of versions whose predecessor is missing or of another lineage."""
    old = primitives.select(F.col("id").alias("prev"), F.col("lineage").alias("old"))
    return primitives.filter("prev is not null").join(old, "prev", "left").filter("old is null or old != lineage").select("id", "prev")


def verify(primitives: DataFrame) -> DataFrame:
    """All faults as (fault, id, target)."""
    parts = [
        dangling(primitives, primitives).select(F.concat(F.lit("dangling "), "linkage").alias("fault"), "id", "target"),
        forward(primitives).select(F.concat(F.lit("forward "), "linkage").alias("fault"), "id", "target"),
        repeated(primitives).select(F.lit("repeated").alias("fault"), "id", F.lit(None).cast("long").alias("target")),
        broken_lineages(primitives).select(F.lit("lineage").alias("fault"), "id", F.col("prev").alias("target")),
    ]
    return reduce(DataFrame.unionByName, parts)


def counts(primitives: DataFrame) -> DataFrame:
    """The ``status database`` numbers: primitives, live ones, links, nodes, and the next id."""
    link = F.col("left").isNotNull() | F.col("right").isNotNull()
    return primitives.agg(
        F.count("*").alias("primitives"), F.count_if("live").alias("live"), F.count_if(link).alias("links"),
        F.count_if(~link).alias("nodes"), (F.max("id") + 1).alias("next_id"),
    )
