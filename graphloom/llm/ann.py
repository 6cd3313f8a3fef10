"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is put in its leaf. A query goes through the
tree best bin first: a priority queue of nodes by the distance of their centres gives the order
in which it visits leaves. How many leaves are visited is widened, doubling, until the visits of
some queries hold the wanted share of their true nearest rows, which a pass over all rows finds.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, sampled, ship
from .vectors import Best, Blocks, pieces, query_blocks, ranked, vectors

#: Fitted on this many rows at most, into at most this many leaves.
SAMPLE, LEAVES, BRANCH = 20_000, 16_384, 16


def _kmeans(m: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = m[rng.choice(len(m), min(k, len(m)), replace=False)]
    for _ in range(rounds):
        near = _nearest(m, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, m)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def _nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * (m @ centres.T), axis=1)


class Tree:
    """Nodes as (centres of children, ids of children); a child below 0 is leaf ``~child``."""

    def __init__(self, m: np.ndarray, per_leaf: int, branch: int = BRANCH):
        rng = np.random.default_rng(0)
        self.nodes: list[tuple[np.ndarray, list[int]]] = []
        self.leaves = 0
        self._grow(m, per_leaf, branch, rng)

    def _grow(self, m, per_leaf, branch, rng) -> int:
        centres = _kmeans(m, branch, rng) if len(m) > per_leaf else m[:1]
        if len(centres) == 1 and self.nodes:
            self.leaves += 1
            return ~(self.leaves - 1)
        at = len(self.nodes)
        children: list[int] = []
        self.nodes.append((centres, children))
        near = _nearest(m, centres)
        for c in range(len(centres)):
            own = m[near == c]
            if len(own) > per_leaf and len(own) < len(m):
                children.append(self._grow(own, per_leaf, branch, rng))
            else:
                self.leaves += 1
                children.append(~(self.leaves - 1))
        return at

    def leaf(self, m: np.ndarray) -> np.ndarray:
        """The leaf of every row, by greedy descent."""
        out = np.zeros(len(m), dtype=np.int64)
        todo = [(0, np.arange(len(m)))]
        while todo:
            node, rows = todo.pop()
            centres, children = self.nodes[node]
            near = _nearest(m[rows], centres)
            for c in np.unique(near).tolist():
                own = rows[near == c]
                if children[c] < 0:
                    out[own] = ~children[c]
                else:
                    todo.append((children[c], own))
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        out: list[int] = []
        queue = [(0.0, 0)]
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(~node)
                continue
            centres, children = self.nodes[node]
            for d, child in zip(((centres - q) ** 2).sum(axis=1).tolist(), children):
                heapq.heappush(queue, (d, child))
        return out


class Nearest:
    """The k nearest rows of every query of one dimension, seen group by group."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, k: int):
        self.ids, self.m, self.k = ids, m, k
        self.size = (m**2).sum(axis=1)
        self.top = np.full((len(ids), k), np.inf)  # squared distances, up to rounding
        self.best = Best(k)

    def add(self, asked: np.ndarray, names: np.ndarray, rows: np.ndarray) -> None:
        """Hold ``rows`` against the ``asked`` queries; what may be among the k (all ties) is worked out exactly."""
        size = (rows**2).sum(axis=1)
        rough = np.maximum(self.size[asked, None] - 2 * (self.m[asked] @ rows.T) + size[None, :], 0)
        rough[self.ids[asked][:, None] == names[None, :]] = np.inf
        least = np.partition(rough, self.k - 1, axis=1)[:, : self.k] if rough.shape[1] > self.k else rough
        top = np.partition(np.concatenate((self.top[asked], least), axis=1), self.k - 1, axis=1)[:, : self.k]
        self.top[asked] = top
        slack = 1e-9 * (1 + self.size[asked] + size.max(initial=0))
        q, r = np.nonzero((rough <= (top.max(axis=1) + slack)[:, None]) & np.isfinite(rough))
        for at in range(0, len(q), 50_000):
            i, j = asked[q[at : at + 50_000]], r[at : at + 50_000]
            self.best.add(i, np.sqrt(((rows[j] - self.m[i]) ** 2).sum(axis=1)), names[j])


def _walked(rows: DataFrame, trees, queries, wide: dict[int, int]) -> dict[int, list[np.ndarray]]:
    """The leaves that each query of a block visits, walked on the executors."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((trees, {d: m for d, (_, m) in queries.items()}, wide))
    places = [(d, i) for d, (ids, _) in queries.items() for i in range(len(ids))]

    def run(batches):
        tree, vecs, most = sent.value
        for b in batches:
            dims, at = (c.to_pylist() for c in b.columns)
            found = [np.asarray(tree[d].visits(vecs[d][i], most[d]), dtype=np.int32) for d, i in zip(dims, at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int32()))], ["dim", "at", "leaves"])

    parts = max(1, min(spark.sparkContext.defaultParallelism, len(places) // 16))
    found = spark.createDataFrame(places, "dim long, at long").repartition(parts).mapInArrow(lean(run), "dim long, at long, leaves array<int>").toArrow()
    out: dict[int, list[np.ndarray]] = {d: [np.zeros(0, dtype=np.int64)] * len(ids) for d, (ids, _) in queries.items()}
    for d, i, leaves in zip(found["dim"].to_pylist(), found["at"].to_pylist(), found["leaves"]):
        out[d][i] = np.asarray(leaves.values, dtype=np.int64)
    sent.unpersist()
    return out


def _scan(rows: DataFrame, trees, queries, visits, k: int):
    """query_id, copy, key, vec_id of the k best of every task, and the broadcast it needs; visits None: all leaves."""
    sent = rows.sparkSession.sparkContext.broadcast((trees, queries, visits))

    def run(batches):
        tree, q, go = sent.value
        held = {dim: Nearest(*q[dim], k) for dim in q}
        wanted: dict[int, dict[int, np.ndarray]] = {}
        for dim in go or ():
            leaf = np.concatenate([np.asarray(x, dtype=np.int64) for x in go[dim]])
            query = np.repeat(np.arange(len(go[dim])), [len(x) for x in go[dim]])
            order = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[order])) + 1
            wanted[dim] = {int(leaf[g[0]]): query[g] for g in np.split(order, cuts) if len(g)}
        for b in pieces(batches, 8192 if go else 1024):
            for dim, (ids, m) in vectors(b, zero=False).items():
                if dim not in q:
                    continue
                if go is None:
                    held[dim].add(np.arange(len(q[dim][0])), ids, m)
                    continue
                leaf = tree[dim].leaf(m)
                order = np.argsort(leaf, kind="stable")
                for g in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
                    asked = wanted[dim].get(int(leaf[g[0]]))
                    for at in range(0, len(asked) if asked is not None else 0, 512):
                        for part in range(0, len(g), 2048):
                            held[dim].add(asked[at : at + 512], ids[g[part : part + 2048]], m[g[part : part + 2048]])
        for dim, near in held.items():
            at, key, ids = near.best.rows()
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(q[dim][0][at]), pa.array(at), pa.array([dim] * len(at), pa.int64()), pa.array(key), pa.array(ids)], ["query_id", "copy", "dim", "key", "vec_id"])

    return rows.mapInArrow(lean(run), "query_id long, copy long, dim long, key double, vec_id long"), sent


def _widened(rows: DataFrame, trees, queries, k: int, recall: float, probes: int) -> dict[int, int]:
    """Leaves to visit per dimension, by the true neighbours of at most ``probes`` queries."""
    some = {}
    for dim, (ids, m) in queries.items():
        pick = np.unique(np.linspace(0, len(ids) - 1, probes).astype(np.int64))
        some[dim] = ids[pick], m[pick]
    scanned, sent = _scan(rows, trees, some, None, k)
    truth = ranked(scanned.withColumn("copy", F.col("copy") * 100_000 + F.col("dim")), k, "key", lambda c: c)
    near = truth.select("query_id", "vec_id").toArrow()  # probes times k rows
    sent.unpersist()
    ids = sorted(set(near["vec_id"].to_pylist()))
    found = rows.filter(F.col("vec_id").isin(ids)).toArrow() if ids else None
    leaf_of: dict[int, dict[int, int]] = {}
    for b in found.to_batches() if found else ():
        for dim, (names, m) in vectors(b, zero=False).items():
            if dim in trees:
                leaf_of.setdefault(dim, {}).update(zip(names.tolist(), trees[dim].leaf(m).tolist()))
    true: dict[int, list[int]] = {}
    for x, y in zip(near["query_id"].to_pylist(), near["vec_id"].to_pylist()):
        true.setdefault(x, []).append(y)
    out = {}
    for dim, (names, m) in some.items():
        order = {int(i): {leaf: r for r, leaf in enumerate(trees[dim].visits(v, trees[dim].leaves))} for i, v in zip(names, m)}
        ranks = np.array([order[i][leaf_of[dim][n]] for i in order for n in true.get(i, ()) if n in leaf_of.get(dim, {})])
        visits = 1
        while len(ranks) and visits < trees[dim].leaves and (ranks < visits).mean() < recall:
            visits *= 2
        out[dim] = min(visits, trees[dim].leaves)
    return out


def search(table: DataFrame, k: int = 10, divisor: int = 100, recall: float = 0.97, probes: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest found of every query (rows whose id is divisible by ``divisor``).

    Every row is in the index; ``recall`` is what the visits are widened to on ``probes`` queries
    of each block. A row is no candidate of a query with its own id; vectors of different lengths
    are never compared. Rows with a null id, a null, empty or zero vector, or a null or non-finite
    component take no part. A query id that several rows bear gives one list a row. Fewer than k
    candidates in the visited leaves: those; no query: an empty result.
    """
    spark = table.sparkSession
    ship(spark)
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    total = rows.count()
    sample: dict[int, list[np.ndarray]] = {}
    for b in sampled(rows, SAMPLE, total, "vec_id").toArrow().to_batches():
        for dim, (_, m) in vectors(b, zero=False).items():
            sample.setdefault(dim, []).append(m)
    leaves = min(LEAVES, max(8, int(2 * np.sqrt(total))))
    fitted = {}
    for dim, parts in sample.items():
        m = np.vstack(parts)
        fitted[dim] = Tree(m, max(4, len(m) // leaves))
    out = Blocks()
    for queries in query_blocks(rows, divisor, zero=False):
        trees = {d: fitted.get(d) or Tree(m, max(4, len(m) // 8)) for d, (_, m) in queries.items()}
        wide = _widened(rows, trees, queries, k, recall, probes)
        out.add(*_scan(rows, trees, queries, _walked(rows, trees, queries, wide), k))
    found = out.all()
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return ranked(found.withColumn("copy", F.col("copy") * 100_000 + F.col("dim")), k, "key", lambda c: c)
