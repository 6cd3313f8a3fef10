"""Exact top-k search by distributed histogram selection.

Everything is scored in every round. A round sends one histogram a task and query over that
query's interval of scores; their sums show which bin holds the k-th best score, and that bin is
the next round's interval, until few scores (or a single score) are left in it. A last pass keeps
what reaches the interval, and ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship
from .vectors import Best, Blocks, pieces, query_blocks, ranked, vectors

BINS = 64
_EXACT = 2.0**53
_LONG = (-(2**63), 2**63 - 1)


def grid(m: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole doubles."""
    return np.floor(m * scale)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of whole doubles as int64; those beyond 64 bits become its ends."""
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1] < _EXACT:
        return (q @ v.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in q], dtype=object) @ np.array([[int(x) for x in r] for r in v], dtype=object).T
    return np.clip(whole, *_LONG).astype(np.int64)


def _count(rows: DataFrame, queries, low, width, offset, scale: int):
    """Per query: candidates below its interval excluded; counts of its bins, and above them."""
    sc = rows.sparkSession.sparkContext
    sent = sc.broadcast((queries, low, width, offset))

    def run(batches):
        q, lo, wide, base = sent.value
        total = np.zeros((sum(len(i) for i, _ in q.values()), BINS + 1), dtype=np.int64)
        for b in pieces(batches):
            for dim, (ids, m) in vectors(b).items():
                if dim not in q:
                    continue
                at = slice(base[dim], base[dim] + len(q[dim][0]))
                s = products(grid(q[dim][1], scale), grid(m, scale))
                bins = np.minimum((s.astype(object) - lo[at, None]) // wide[at, None], BINS).astype(np.int64) if wide.dtype == object else np.minimum((s - lo[at, None]) // wide[at, None], BINS)
                ok = (bins >= 0) & (q[dim][0][:, None] != ids[None, :])
                row, col = np.nonzero(ok)
                total[at] += np.bincount(row * (BINS + 1) + bins[row, col], minlength=len(q[dim][0]) * (BINS + 1)).reshape(-1, BINS + 1)
        i, j = np.nonzero(total)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["q", "bin", "n"])

    found = rows.mapInArrow(lean(run), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(low), BINS + 1), dtype=np.int64)  # one row a query of this block
    out[np.asarray(found["q"]), np.asarray(found["bin"])] = np.asarray(found["n"])
    sent.unpersist()
    return out


def search(table: DataFrame, k: int = 10, divisor: int = 100, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k highest integer inner products of every query against all other rows.

    Queries are the rows whose id is divisible by ``divisor``, taken in blocks. A row is no
    candidate of a query with its own id; vectors of different lengths are never compared. Rows
    with a null id, a null or empty vector, or a null or non-finite component take no part. A
    query id that several rows bear gives one list a row. Fewer than k candidates: all of them;
    no query: an empty result. Scores beyond 64 bits are held at its ends.
    """
    spark = table.sparkSession
    ship(spark)
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    out = Blocks()
    for queries in query_blocks(rows, divisor, zero=True):
        queries = {d: (i, m) for d, (i, m) in queries.items()}
        sizes = {d: len(i) for d, (i, _) in queries.items()}
        offset = dict(zip(sizes, np.cumsum([0, *sizes.values()])[:-1].tolist()))
        n = sum(sizes.values())
        bound = _bound(rows, queries, scale)
        kind = object if bound >= 2**61 else np.int64
        low, high = np.full(n, -bound, dtype=kind), np.full(n, bound, dtype=kind)
        need = np.full(n, k)
        busy = np.ones(n, dtype=bool)
        while busy.any():
            width = np.maximum(1, -(-(high - low + 1) // BINS))
            count = _count(rows, queries, low, width, offset, scale)
            above = np.cumsum(count[:, ::-1], axis=1)[:, ::-1]  # of a bin and all higher ones
            full = above[:, 0] >= k  # a query of fewer candidates keeps them all
            reach = np.maximum(0, (above >= np.where(full, need, 0)[:, None]).sum(axis=1) - 1)
            reach = np.minimum(reach, BINS - 1)
            for i in np.flatnonzero(busy):
                if full[i]:
                    low[i] = low[i] + reach[i] * width[i]
                    high[i] = low[i] + width[i] - 1
                else:
                    high[i] = low[i]
            busy &= (width > 1) & full & (above[np.arange(n), reach] > 4 * k)
            high = np.where(busy, high, low + BINS - 1)
        out.add(*_filtered(rows, queries, low, offset, scale, k))
    found = out.all()
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return ranked(found, k, "key", lambda c: (-c).cast("long"))


def _bound(rows: DataFrame, queries, scale: int) -> int:
    """A bound on any score's size: the longest query times the longest row (Cauchy-Schwarz)."""

    def run(batches):
        most = 0.0
        for b in pieces(batches):
            for _, m in vectors(b).values():
                most = max(most, float(np.sqrt((grid(m, scale) ** 2).sum(axis=1)).max()))
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["most"])

    most = rows.mapInArrow(lean(run), "most double").agg(F.max("most")).collect()[0][0] or 0.0
    longest = max(float(np.sqrt((grid(m, scale) ** 2).sum(axis=1)).max()) for _, m in queries.values())
    return int(min(most * longest * 1.0001 + 2, float(_LONG[1])))


def _filtered(rows: DataFrame, queries, low, offset, scale: int, k: int):
    """What reaches each query's threshold, and the broadcast it needs; of ties a task sends the k smallest ids."""
    sent = rows.sparkSession.sparkContext.broadcast((queries, low, offset))

    def run(batches):
        q, lo, base = sent.value
        names = np.zeros(len(lo), dtype=np.int64)
        for dim, (ids, _) in q.items():
            names[base[dim] : base[dim] + len(ids)] = ids
        best = Best(k)
        for b in pieces(batches):
            for dim, (ids, m) in vectors(b).items():
                if dim not in q:
                    continue
                s = products(grid(q[dim][1], scale), grid(m, scale))
                row, col = np.nonzero((s >= lo[base[dim] : base[dim] + len(s), None]) & (q[dim][0][:, None] != ids[None, :]))
                best.add(row + base[dim], ~s[row, col], ids[col])  # ~s falls as s rises and can't overflow
        at, key, ids = best.rows()
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(at), pa.array(-1 - key.astype(np.int64)), pa.array(ids)], ["query_id", "copy", "s", "vec_id"])

    return rows.mapInArrow(lean(run), "query_id long, copy long, s long, vec_id long").select("query_id", "copy", (-F.col("s").cast("decimal(20,0)")).alias("key"), "vec_id"), sent
