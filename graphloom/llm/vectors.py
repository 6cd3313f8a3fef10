"""Vectors from Arrow batches, blocks of queries, and running top-k lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Queries that are searched at once; more are searched block by block.
BLOCK = 4096


def vectors(batch: pa.RecordBatch, zero: bool = True) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> ids and rows of the batch's (id, vector) columns, as doubles.

    Left out: null ids, null or empty vectors, null or non-finite components and, without
    ``zero``, vectors of zeros.
    """
    ids, column = batch.column(0), batch.column(1)
    keep = np.flatnonzero(np.asarray(ids.is_valid()) & np.asarray(column.is_valid()))
    if not len(keep):
        return {}
    column = column.take(pa.array(keep))
    ids = np.asarray(ids.take(pa.array(keep)), dtype=np.int64)
    flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan))
    lengths = np.asarray(column.value_lengths(), dtype=np.int64)
    start = np.cumsum(lengths) - lengths
    out = {}
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        m = flat[start[rows, None] + np.arange(dim)]
        ok = np.isfinite(m).all(axis=1) & (zero | (m != 0).any(axis=1))
        if ok.any():
            out[dim] = ids[rows[ok]], m[ok]
    return out


def pieces(batches, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def query_blocks(rows: DataFrame, divisor: int, zero: bool) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Blocks of about BLOCK queries: the rows whose id is divisible by ``divisor``, by dimension."""
    chosen = rows.filter(F.col("vec_id") % divisor == 0)
    n = max(1, -(-chosen.count() // BLOCK))
    for k in range(n):
        part = chosen.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == k).toArrow()
        joined: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in part.to_batches():
            for dim, (ids, m) in vectors(b, zero).items():
                old = joined.get(dim)
                joined[dim] = (np.concatenate((old[0], ids)), np.vstack((old[1], m))) if old else (ids, m)
        if joined:
            yield {d: (i[np.lexsort((i,))], m[np.lexsort((i,))]) for d, (i, m) in joined.items()}


class Blocks:
    """Results of query blocks, each written as it is done, so that plan, broadcasts and driver don't grow with their number."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def add(self, part: DataFrame, *sent) -> None:
        self.tables.append(table(part))
        for x in sent:
            x.unpersist()

    def all(self) -> DataFrame | None:
        """One scan of all of them; None if there was no block."""
        if not self.tables:
            return None
        first = self.tables[0]
        return first.sparkSession.read.schema(first.schema).parquet(*(t._graphloom_path for t in self.tables))


class Best:
    """The k smallest (key, id) of each query so far; memory follows queries times k."""

    def __init__(self, k: int):
        self.k, self.held, self.size = k, [], 0

    def add(self, query: np.ndarray, key: np.ndarray, ids: np.ndarray) -> None:
        if len(query):
            self.held.append((query, key, ids))
            self.size += len(query)
            if self.size > 400_000:
                self.held = [self.rows()]
                self.size = len(self.held[0][0])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        q, key, ids = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, key, q))
        q, key, ids = q[order], key[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return q[rank < self.k], key[rank < self.k], ids[rank < self.k]


def ranked(rows: DataFrame, k: int, key: str, value: Callable) -> DataFrame:
    """query_id, rank, vec_id, score of the k first of each query by (key, vec_id)."""
    w = Window.partitionBy("query_id", "copy").orderBy(F.col(key), F.col("vec_id"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", value(F.col(key)).alias("score"))
