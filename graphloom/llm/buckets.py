"""Links among rows that share a key, without a list of all pairs of a key.

A node has rows (key, node, component, ...) for some keys; any two nodes that are to be linked share
one. Three steps, each linear in the rows, link all of them:

* ``contract``: the members of a key are held against one of them, its centre.
* ``opened``: only keys whose members still belong to several components go on.
* ``compared``: keys of at most BUCKET rows are compared whole, by which a row meets a bounded number
  of others; larger ones are refined into keys of more of what their members have in common, closed
  ones fall away again, and so on until none is large. Where nearness alone is no link, a key gives
  its near pairs only if they are no more than its rows, else the rows that have any (``gathered``),
  whose pairs are then decided where they meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, lean, table
from .graph import connect

#: Rows of a key that are compared whole.
BUCKET = 2048
#: Rows held against one another at once.
BLOCK = 1024

Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def contract(rows: DataFrame, names: list[str], near) -> DataFrame:
    """(a, b): members of a key that are near its least node, ``near`` being a Column of names and "c." names."""
    centre = rows.groupBy("key").agg(F.min(F.struct("node", *names)).alias("c"), F.max("node").alias("hi")).filter("c.node < hi").drop("hi")
    pairs = rows.join(centre, "key").filter("node != c.node").filter(near(str, "c.{}".format))
    return pairs.select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()


def components_of(nodes: DataFrame, edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The nodes with their component so far, and the (node, component) table of the linked ones."""
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    linked = connect(every)
    return table(nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))), linked


def opened(rows: DataFrame) -> DataFrame:
    """A table of the (key, component, ...) rows whose key has several components, with the rows of the key, n."""
    several = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("key", "n")
    return table(rows.join(several, "key"))


def _groups(batches, names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of a batch of rows sorted by key, each batch ending with a key."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        rows = [np.asarray(b.column(b.schema.get_field_index(x))) for x in names]
        if not len(rows[0]):
            continue
        if held and held[0][0][0] == rows[0][-1]:  # all of one key that goes on
            held.append(rows)
            continue
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        yield [np.concatenate(x) for x in zip(*held, [r[:last] for r in rows])]
        held = [[r[last:] for r in rows]]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _blocks(component: np.ndarray, f: np.ndarray, near: Near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the near pairs of different components, block by block."""
    for i in range(0, len(component), BLOCK):
        for j in range(i, len(component), BLOCK):
            hit = component[i : i + BLOCK, None] != component[None, j : j + BLOCK]
            if hit.any():
                a, b = np.nonzero(hit)
                if i == j:
                    a, b = a[a < b], b[a < b]
                ok = near(f[i + a], f[j + b])
                yield i + a[ok], j + b[ok]


def _pairs(component: np.ndarray, f: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the near pairs of different components."""
    found = list(_blocks(component, f, near))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2


def few_or_rows(node: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crowd, a, b) of the pairs whose indices ``blocks`` gives or, if they are more than the rows, of the rows in one."""
    some, found, n = np.zeros(len(node), dtype=bool), [(node[:0], node[:0])], 0
    for x, y in blocks:
        some[x] = some[y] = True
        n += len(x)
        if n <= len(some):
            found.append(_sides(node, x, y))
            continue
        found.clear()
        if some.all():
            break
    if not found:
        own = np.unique(node[some])
        return np.full(len(own), xxhash.xxh64_intdigest(own.tobytes()), dtype=np.uint64).view(np.int64), own, own
    a, b = (np.concatenate(x) for x in zip(*found))
    return np.zeros(len(a), dtype=np.int64), a, b


def _spanning(x: np.ndarray, y: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Which of the pairs suffice to connect what all of them connect."""
    parent: dict[int, int] = {}

    def find(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    keep = np.zeros(len(x), dtype=bool)
    for k, (a, b) in enumerate(zip(component[x].tolist(), component[y].tolist())):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep[k] = True
    return keep


def _compared(rows: DataFrame, names: list[str], key_rows, two_rows, schema: str) -> DataFrame:
    """What key_rows(node, component, words) gives for the rows of each key, less repeats; of keys of two rows, which most are, two_rows for all at once."""

    def run(batches):
        for key, node, component, *f in _groups(batches, ["key", "node", "component", *names]):
            words = np.stack([x.view(np.uint64) for x in f], axis=1)
            edge = np.flatnonzero(np.diff(key, prepend=key[:1] + 1, append=key[-1:] + 1)) if len(key) else np.zeros(0, dtype=np.int64)
            two = edge[:-1][np.diff(edge) == 2]
            out = [two_rows(node, component, words, two)]
            out += [key_rows(node[lo:hi], component[lo:hi], words[lo:hi]) for lo, hi in zip(edge, edge[1:]) if hi - lo > 2]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], [x.split()[0] for x in schema.split(", ")])

    sorted_ = rows.select("key", "node", "component", *names).repartition("key").sortWithinPartitions("key")
    return sorted_.mapInArrow(lean(run), schema).distinct()


def _sides(node: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(node[x], node[y]), np.maximum(node[x], node[y])


def compared(rows: DataFrame, names: list[str], near: Near) -> DataFrame:
    """(a, b): near pairs of different components under a key, less those that connect what others connect."""

    def key_rows(node, component, words):
        x, y = _pairs(component, words, near)
        keep = _spanning(x, y, component)
        return _sides(node, x[keep], y[keep])

    def two_rows(node, component, words, x):
        x = x[(component[x] != component[x + 1]) & near(words[x], words[x + 1])]
        return _sides(node, x, x + 1)

    return _compared(rows, names, key_rows, two_rows, "a long, b long")


def gathered(rows: DataFrame, names: list[str], near: Near) -> DataFrame:
    """(crowd, a, b), no more rows than a key has: its near pairs of different components, or all rows that are in one.

    Pairs have a < b and crowd 0. Where pairs are more than rows, each row in one is there as a = b;
    crowd is a hash of all of these, so that keys with the same give them once.
    """

    def key_rows(node, component, words):
        return few_or_rows(node, _blocks(component, words, near))

    def two_rows(node, component, words, x):
        x = x[(component[x] != component[x + 1]) & near(words[x], words[x + 1])]
        return np.zeros(len(x), dtype=np.int64), *_sides(node, x, x + 1)

    return _compared(rows, names, key_rows, two_rows, "crowd long, a long, b long")


def linked_within(nodes: DataFrame, first: DataFrame, rows_of: Callable[[DataFrame], DataFrame], names: list[str], column, near: Near, refine: Callable[[DataFrame], DataFrame | None], checked: Callable[[DataFrame], DataFrame] | None = None, within: Callable[[DataFrame], DataFrame] | None = None, bucket: int | None = None) -> DataFrame:
    """A table (node, component) of the nodes that are linked to any other, exactly.

    nodes: (node, names). first: rows whose keys' centres are worth a first contraction. rows_of:
    from nodes with components to the open rows of all keys, a table. refine: from a table of open
    rows of large keys to (key, node, component, names, ...) rows of finer keys, or None if there
    are none; large keys are then compared whole, too. If nearness alone is no link: checked: which of
    the (a, b) pairs hold, as a table; within: the (a, b) that, with the components, connect all linked
    ones of each of the crowds in a (crowd, node, component) table, as a table.
    """
    bucket = bucket or BUCKET
    sure, checked = checked is None, checked or table

    def links(rows: DataFrame) -> list[DataFrame]:
        if sure:
            return [table(compared(rows, names, near))]
        found = table(gathered(rows, names, near))
        out = [checked(found.filter("a < b").select("a", "b").distinct())]
        if found.filter("a = b").limit(1).count():
            out.append(within(found.filter("a = b").selectExpr("crowd", "a node").join(named.select("node", "component").distinct(), "node")))
        drop(found)
        return out

    edges = [checked(contract(first, names, column))]
    named, linked = components_of(nodes, edges)
    rows = rows_of(named)
    while True:
        large = rows.filter(F.col("n") > bucket)
        finer = refine(table(large)) if large.limit(1).count() else None
        if finer is None:
            edges += links(rows)
            drop(rows)
            break
        edges += links(rows.filter(F.col("n") <= bucket))
        drop(rows)
        finer = table(finer)
        edges.append(checked(contract(finer, names, column)))
        drop(named, linked)
        named, linked = components_of(nodes, edges)
        rows = opened(finer.drop("component", "n").join(named.select("node", "component").distinct(), "node"))
        drop(finer)
    drop(named, linked)
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    out = connect(every)
    drop(*edges)
    return out
