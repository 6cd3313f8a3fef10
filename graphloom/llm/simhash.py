"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are cut into segments on a ring. If two differ in at most t bits over m segments,
some segment starts a chain in which the first l segments differ in at most l*t/m bits, for every
l. With t < m that start is equal and its successor differs in one bit at most, so the start
together with the successor, each of its bits left out in turn, is a key that every such pair
shares. Candidates under one key pass the chain test before the full Hamming distance; ``buckets``
says how a key's members are linked without a list of all their pairs.

Similar sets of shingles are found the same way, with two differences. A majority fingerprint
promises nothing at a Jaccard similarity of 0.8, but one of parities does: each shingle that only one
text holds flips one bit, so the distance has a bound, to which chains and distance are held. And
keys are prefixes: with the shingles of all sets in one order, rare ones first, two sets of a
similarity s share one of their first n - ceil(s * n) + 1 (n the size of each). What passes is held
against the sets themselves, so no pair is left to chance.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import buckets
from .common import SOLID, Words, among, drop, lean, marked, marks, mixed, settle, ship, slices, table, texts

SEED = 42
#: Nodes whose keys one task makes.
NODES = 20_000
#: Documents about from which frequent shingles are learned, and how many of these are told to every task.
SAMPLE, FREQUENT = 10_000, 1 << 17
#: Sets that are held against one centre in one task.
CHUNK = 2000


def _shingles(text: bytes, size: int) -> list[bytes]:
    words = text.lower().split()
    return [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased (A-Z) words; of the whole text if it has fewer words."""
    h = xxhash.xxh64_intdigest
    return np.array([h(s, SEED) for s in _shingles(text, size)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """64 bits; one is 1 if over half of the hashes have it (no hashes: zero)."""
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        count += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and f0 of every whole text; null is the empty text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for b in slices(batches, "text"):
            f = np.array([fingerprint(shingle_hashes(t, size)) for t in texts(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], ["doc_id", "f0"])

    return rows.mapInArrow(lean(run), "doc_id long, f0 long")


def chained(parts: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """Whether differences (rows) of the ring's segments (columns) have a chain within proportional budgets.

    Some start must keep its first l segments within l * most / m, for l up to 3.
    """
    m = parts.shape[1]
    fits = np.ones(parts.shape, dtype=bool)
    total = np.zeros(parts.shape, dtype=np.int64)
    for n in range(1, min(3, m) + 1):
        total += np.roll(parts, 1 - n, axis=1)
        fits &= total * m <= n * np.asarray(most).reshape(-1, 1)
    return fits.any(axis=1)


class Ring:
    """Segments of 64-bit fingerprints that link at ``most`` or fewer differing bits."""

    names = ["f0"]

    def __init__(self, most: int, segments: int):
        if most >= segments:
            raise ValueError("chains of so large a distance have no keys")
        self.most = most
        cuts = [round(64 * i / segments) for i in range(segments + 1)]
        self.parts = list(zip(cuts, (b - a for a, b in zip(cuts, cuts[1:]))))
        self.masks = [np.uint64(((1 << size) - 1) << at) for at, size in self.parts]

    def successors(self) -> list[tuple[int, int, int]]:
        """Segment, its successor and a bit of that: what the keys of a fingerprint are named by."""
        m = len(self.parts)
        return [(i, (i + 1) % m, at + j) for i in range(m) for at, size in [self.parts[(i + 1) % m]] for j in range(size)]

    def keys(self, f: np.ndarray) -> np.ndarray:
        """The keys of each fingerprint: every start with its successor less one bit."""
        out = [mixed((f & (self.masks[i] | self.masks[k]) & ~np.uint64(1 << bit)) + mixed(np.uint64(i << 8 | bit) + np.zeros(1, dtype=np.uint64))) for i, k, bit in self.successors()]
        return np.stack(out, axis=1)

    def free(self) -> np.ndarray:
        """The bits that the members of each key may still differ in."""
        return np.array([~(self.masks[i] | self.masks[k]) | np.uint64(1 << bit) for i, k, bit in self.successors()], dtype=np.uint64)

    def whole(self) -> Column:
        """Array of keys of a segment and its whole successor, by which most near copies meet."""
        m = len(self.parts)
        return F.array(*(F.xxhash64(F.expr(f"f0 & {_signed(int(self.masks[i] | self.masks[(i + 1) % m]))}L"), F.lit(i)) for i in range(m)))

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Chain test, then the full distance, of rows of fingerprints."""
        x = a[:, 0] ^ b[:, 0]
        ok = chained(np.stack([np.bitwise_count(x & mask) for mask in self.masks], axis=1).astype(np.int64), self.most)
        ok[ok] = np.bitwise_count(x[ok]) <= self.most
        return ok

    def column(self, a: Callable[[str], str], b: Callable[[str], str]) -> Column:
        """The same of fingerprints named by ``a`` and ``b``."""
        xor, m = f"({a('f0')} ^ {b('f0')})", len(self.parts)
        part = [f"bit_count({xor} & {_signed(int(mask))}L)" for mask in self.masks]
        starts = [" and ".join(f"{' + '.join(part[(i + k) % m] for k in range(n))} <= {n * self.most // m}" for n in range(1, min(3, m) + 1)) for i in range(m)]
        return F.expr("(" + " or ".join(f"({s})" for s in starts) + f") and bit_count({xor}) <= {self.most}")

    def finer(self, free: np.ndarray) -> np.ndarray:
        """Masks (one row each) that cut the free bits into most + 1 parts, of which near members share one."""
        bits = [np.flatnonzero((int(x) >> np.arange(64, dtype=object)) & 1) for x in free.tolist()]
        return np.array([[sum(1 << int(b) for b in part) for part in np.array_split(own, self.most + 1)] for own in bits], dtype=np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class Sets:
    """Bounds on the similarity of sets, known by their sizes n and their parities f0, f1, ...

    Bit i of the parity tells whether an odd number of elements fall on i. Each element that only one
    of two sets holds flips one bit, so the bits that differ are no more than these elements, which at
    a similarity of ``least`` are at most (1 - least) / (1 + least) of both sizes. No such pair fails.
    """

    def __init__(self, words: int, least: float):
        self.words, self.least, self.share = words, least, (1 - least) / (1 + least)
        self.names = ["n_set", *(f"f{w}" for w in range(words))]

    def parity(self, hashes: np.ndarray) -> np.ndarray:
        bits = 64 * self.words
        odd = np.bincount((mixed(hashes) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)

    def wide(self, hashes: np.ndarray) -> bytes:
        """A parity of 2 to 4 bits an element (256 at least, a power of two), which tells large sets apart, too."""
        bits = max(256, 1 << max(0, 2 * len(hashes) - 1).bit_length())
        odd = np.bincount((mixed(hashes + np.uint64(1)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()

    def may(self, n: int, a: bytes, m: int, b: bytes) -> bool:
        """Whether sets of n and m elements with these wide parities can be similar; the larger parity is folded to the smaller."""
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        if len(x) < len(y):
            x, y = y, x
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
        return int(np.bitwise_count(x ^ y).sum()) <= self.share * (n + m) + 1e-6

    def all_may(self, n: np.ndarray, wide: list[bytes], component: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indices of all pairs of different components that can be similar by their sizes and as ``may`` says, a set at a time."""
        order = np.argsort(n, kind="stable")
        n, component = n[order], component[order]
        size = np.array([len(wide[i]) for i in order])  # grows with n
        cut = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(order)]
        held = [np.frombuffer(b"".join(wide[i] for i in order[lo:hi]), dtype=np.uint64).reshape(hi - lo, -1) for lo, hi in zip(cut, cut[1:]) if hi > lo]
        for k, own in enumerate(held):
            last = int(np.searchsorted(n, n[cut[k + 1] - 1] / self.least + 1e-6, side="right"))
            folded = [np.bitwise_xor.reduce(m[: max(0, last - lo)].reshape(-1, m.shape[1] // own.shape[1], own.shape[1]), axis=1) for m, lo in zip(held[k:], cut[k:])]
            rest = np.concatenate(folded)
            for i in range(len(own)):
                at = cut[k] + i
                to = int(np.searchsorted(n, n[at] / self.least + 1e-6, side="right"))
                j = at + 1 + np.flatnonzero(component[at + 1 : to] != component[at])
                j = j[np.bitwise_count(rest[j - cut[k]] ^ own[i]).sum(axis=1, dtype=np.int64) <= self.share * (n[at] + n[j]) + 1e-6]
                if len(j):
                    yield np.full(len(j), order[at]), order[j]

    def prefix(self, hashes: np.ndarray, frequent: np.ndarray, times: np.ndarray, more: int = 0) -> np.ndarray:
        """The first of the distinct ``hashes``, by their ``times`` (0 unless among the sorted ``frequent``), then by value.

        Similar sets share one of them; with ``more``, so many beside it.
        """
        n = len(hashes)
        rank = np.zeros(n, dtype=np.int64)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
            rank = np.where(frequent[at] == hashes, times[at], 0)
        return hashes[np.lexsort((hashes, rank))[: n - math.ceil(self.least * n - 1e-9) + 1 + more]]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes, then the chain test over the words of the parity, then the full distance, of rows of ``names``."""
        n, m = a[:, 0].astype(np.float64), b[:, 0].astype(np.float64)
        ok = np.minimum(n, m) >= self.least * np.maximum(n, m) - 1e-6
        at = np.flatnonzero(ok)
        most = np.floor(self.share * (n[at] + m[at]) + 1e-6).astype(np.int64)
        parts = np.bitwise_count(a[at, 1:] ^ b[at, 1:]).astype(np.int64)
        go = chained(parts, most)
        go[go] = parts[go].sum(axis=1) <= most[go]
        ok[at] = go
        return ok

    def column(self, a: Callable[[str], str], b: Callable[[str], str]) -> Column:
        """The same of columns; its chains are of the single words."""
        part = [f"bit_count({a(f'f{w}')} ^ {b(f'f{w}')})" for w in range(self.words)]
        n, m = a("n_set"), b("n_set")
        most = f"({self.share!r}D * ({n} + {m}) + 1e-6D)"
        return F.expr(f"least({n}, {m}) >= {self.least!r}D * greatest({n}, {m}) - 1e-6D and least({', '.join(part)}) * {self.words} <= {most} and {' + '.join(part)} <= {most}")


def _named(prints: DataFrame, nodes: DataFrame, linked: DataFrame, names: list[str]) -> DataFrame:
    """The prints with the component_id of their node."""
    found = nodes.join(linked, "node", "left").select(*names, F.coalesce("component", "node").alias("component_id"))
    return prints.join(found, names, "left")


def ring_components(nodes: DataFrame, ring: Ring, bucket: int | None = None) -> DataFrame:
    """node, component (its smallest node) for the (node, f0) nodes, of different f0, that link to any other."""
    parts = max(8, -(-nodes.count() // NODES))
    free = ring.free()

    def all_keys(wanted=None):
        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    node, component, f0 = (np.asarray(c) for c in b.slice(at, 4096).columns)
                    k = ring.keys(f0.view(np.uint64))
                    row, which = np.nonzero(marked(wanted.value, k)) if wanted else (np.repeat(np.arange(len(k)), k.shape[1]), None)
                    columns = [k[row, which] if wanted else k.ravel(), component[row]]
                    if wanted:
                        columns += [node[row], f0[row], free[which]]
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["key", "component", "node", "f0", "free"][: len(columns)])

        return run

    def rows_of(named: DataFrame) -> DataFrame:
        dealt = named.select("node", "component", "f0").repartition(parts, "node")
        counts = dealt.mapInArrow(lean(all_keys()), "key long, component long")
        several = table(counts.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("key", "n"))
        wanted = nodes.sparkSession.sparkContext.broadcast(marks(several, "key"))
        out = table(dealt.mapInArrow(lean(all_keys(wanted)), "key long, component long, node long, f0 long, free long").join(several, "key"))
        drop(several)
        return out

    def refine(rows: DataFrame) -> DataFrame:
        def run(batches):
            for b in batches:
                key, node, component, f0, left = (np.asarray(b.column(b.schema.get_field_index(x))) for x in ("key", "node", "component", "f0", "free"))
                kinds, which = np.unique(left.view(np.uint64), return_inverse=True)
                masks = ring.finer(kinds)[which]
                part = np.arange(masks.shape[1], dtype=np.uint64)
                k = mixed(mixed((f0.view(np.uint64)[:, None] & masks) + mixed(key.view(np.uint64))[:, None]) + part)
                row = np.repeat(np.arange(len(key)), masks.shape[1])
                columns = [k.ravel(), node[row], component[row], f0[row], (left.view(np.uint64)[:, None] & ~masks).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["key", "node", "component", "f0", "free"])

        return rows.mapInArrow(lean(run), "key long, node long, component long, f0 long, free long")

    first = nodes.select(F.explode(ring.whole()).alias("key"), "node", "f0")
    return buckets.linked_within(nodes.select("node", "f0"), first, rows_of, ring.names, ring.column, ring.near, refine, bucket=bucket)


def set_hash(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, given sorted, as two signed longs."""
    return struct.unpack("<qq", xxhash.xxh128_digest(hashes.tobytes(), SEED))


def shingle_sets(docs: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of lower-cased (A-Z) words; a shorter text is one shingle."""
    words = Words(docs, SOLID)
    h, count = words.hashes(), np.diff(words.first)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(docs)), n)
    at = words.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    run = h[at]
    for j in range(1, size):
        on = at + j < words.first[text + 1]
        run[on] = mixed(run[on] + h[at[on] + j])
    order = np.lexsort((run, text))
    text, run = text[order], run[order]
    new = np.ones(len(run), dtype=bool)
    new[1:] = (run[1:] != run[:-1]) | (text[1:] != text[:-1])
    return np.split(run[new], np.searchsorted(text[new], np.arange(1, len(docs))))


def _frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of shingles that several of a sample of documents hold, and how many do.

    They only order the shingles: what is found does not depend on them.
    """
    share = min(1.0, SAMPLE / max(1, docs.count()))
    part = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1).select(F.col("text").cast("string"))

    def run(batches):
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(texts(b.column(0)), size)).view(np.int64))], ["h"])

    found = part.mapInArrow(lean(run), "h long").groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(FREQUENT).toArrow()
    h, n = np.asarray(found["h"], dtype=np.int64).view(np.uint64), np.asarray(found["count"], dtype=np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def near_duplicates(docs: DataFrame, size: int = 4, most: int = 4, segments: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document; exact.

    Fingerprints link at ``most`` or fewer differing bits; component_id is the smallest doc_id
    reachable. Null and empty texts and texts without words have fingerprint zero, which links as
    any other. Rows with a null id get the component of their fingerprint (null if no row with an
    id is in it) and link nothing. Repeated rows are kept; an empty table gives an empty result.
    """
    prints = table(fingerprints(docs, size, doc_id, text))
    nodes = table(prints.filter("doc_id is not null").groupBy("f0").agg(F.min("doc_id").alias("node")))
    # an id that several texts bear is one node for each of them, so the nodes are numbered by their fingerprints
    linked = ring_components(nodes.select(F.col("f0").alias("node"), "f0"), Ring(most, segments))
    least = nodes.join(linked.withColumnRenamed("node", "f0"), "f0", "left").withColumn("component", F.coalesce("component", "f0"))
    least = table(least.groupBy("component").agg(F.min("node").alias("component_id")).join(least.select("f0", "component"), "component").select("f0", "component_id"))
    drop(nodes, linked)
    settle(docs.sparkSession)
    return prints.join(least, "f0", "left").select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def spanning(ids: np.ndarray, held: np.ndarray, lengths: np.ndarray, least: float) -> list[tuple[int, int]]:
    """(a, b) that connect all ids linked by a similarity of ``least`` of their sets, whose elements stand one after the other in ``held``."""
    kinds, held = np.unique(held, return_inverse=True)
    label = np.unique(ids, return_inverse=True)[1]  # of the texts of an id, one
    ends = np.cumsum(lengths)
    mark, out = np.zeros(len(kinds), dtype=bool), []
    for i in range(len(ids) - 1):
        if (label == label[0]).all():
            break
        own, at = held[ends[i] - lengths[i] : ends[i]], int(ends[i])
        mark[own] = True
        total = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(mark[held[at:]])))
        mark[own] = False
        shared = np.diff(total[ends[i:] - at])
        hit = i + 1 + np.flatnonzero((shared >= least * (lengths[i] + lengths[i + 1 :] - shared)) & (label[i + 1 :] != label[i]))
        if len(hit):
            met, first = np.unique(label[hit], return_index=True)
            out += [(min(x, ids[i]), max(x, ids[i])) for x in ids[hit[first]]]
            label[np.isin(label, met)] = label[i]
    return out


def _similar(docs: DataFrame, groups: DataFrame, size: int, sets_: Sets) -> tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """Two ways to a table of (a, b) pairs of ids whose texts' shingle sets have that similarity, exactly.

    ``exact`` takes pairs (a, b); ``crowds`` takes (crowd, node, component) and gives pairs that, with the
    components, connect what is linked in a crowd. Wide parities of ``groups`` (node, n_set, wide) leave few
    other pairs: of a crowd, its pairs that pass go on if they are no more than its rows, else the rows in one,
    whose sets are then brought to one task. The sets of the b of an a come to one task, CHUNK at a time, and
    pass by the set of a. An id that several texts bear is similar if one of them is.
    """

    least = sets_.least

    def possible(batches):
        for b in batches:
            ok = [sets_.may(*r) for r in zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 5)))]
            part = b.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays(part.columns[:2], ["a", "b"])

    def sets(batches):
        for b in slices(batches, "text"):
            held = shingle_sets(texts(b.column(1)), size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.view(np.int64) for x in held], pa.list_(pa.int64()))], ["id", "s"])

    def held_against(batches):
        place, own = None, []
        for b in batches:
            out: list[tuple[int, int]] = []
            at, s = b.column(4), b.column(4).values
            ends = np.asarray(at.offsets)
            for i, (a, salt, follows, name) in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)))):
                one = np.asarray(s[ends[i] : ends[i + 1]])
                if (a, salt) != place:
                    place, own = (a, salt), []
                if not follows:
                    own.append(one)
                    continue
                for x in own:
                    shared = len(np.intersect1d(x, one, assume_unique=True))
                    if shared >= least * (len(x) + len(one) - shared):
                        out.append((a, name))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    def exact(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(groups.selectExpr("node a", "n_set n", "wide wa"), "a").join(groups.selectExpr("node b", "n_set m", "wide wb"), "b")
        return confirmed(table(pairs.select("a", "b", "n", "wa", "m", "wb").mapInArrow(lean(possible), "a long, b long").distinct()))

    def confirmed(pairs: DataFrame) -> DataFrame:
        settle(docs.sparkSession)
        crowd = pairs.groupBy("a").agg(F.expr(f"count(*) div {CHUNK} + 1").alias("salts"))
        salted = pairs.join(crowd, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
        wanted = table(salted.select(F.col("a").alias("centre"), "salt", F.explode(F.expr("array(struct(0 follows, a id), struct(1 follows, b id))")).alias("x")).select("centre", "salt", "x.*").distinct())
        rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
        found = among(rows, wanted, "id").mapInArrow(lean(sets), "id long, s array<bigint>").join(wanted, "id")
        sorted_ = found.select("centre", "salt", "follows", "id", "s").repartition("centre", "salt").sortWithinPartitions("centre", "salt", "follows", "id")
        out = table(sorted_.mapInArrow(lean(held_against), "a long, b long").distinct())
        drop(pairs, wanted)
        settle(docs.sparkSession)
        return out

    def met(batches):
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # the rows of the crowd that may go on
        for b in batches:
            crowd, ids, s = np.asarray(b.column(0)), np.asarray(b.column(1)), b.column(2)
            if not len(crowd):
                continue
            ends, values = np.asarray(s.offsets), np.asarray(s.values)
            cut = np.flatnonzero(np.diff(crowd)) + 1
            out: list[tuple[int, int]] = []
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(crowd)]):
                if held and held[0][0] != crowd[lo]:
                    out += whole(held)
                    held = []
                held.append((crowd[lo], ids[lo:hi].copy(), np.diff(ends[lo : hi + 1]), values[ends[lo] : ends[hi]].copy()))
            yield edges_of(out)
        if held:
            yield edges_of(whole(held))

    def whole(held):
        ids, lengths, values = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
        return spanning(ids, values, lengths.astype(np.int64), least)

    def edges_of(out):
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    def apart(batches):
        for crowd in of_one(batches):
            n = crowd["n_set"].to_numpy().astype(np.float64)
            out = buckets.few_or_rows(crowd["node"].to_numpy(), sets_.all_may(n, crowd["wide"].to_pylist(), crowd["component"].to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["crowd", "a", "b"])

    def of_one(batches):
        """The rows of each crowd, of batches sorted by crowd."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            cut = np.flatnonzero(np.diff(np.asarray(b.column(0)))) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
                if held and hi > lo and held[0].column(0)[0].as_py() != b.column(0)[lo].as_py():
                    yield pa.Table.from_batches(held)
                    held = []
                if hi > lo:
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield pa.Table.from_batches(held)

    def crowds(members: DataFrame) -> DataFrame:
        told = members.distinct().join(groups.select("node", "n_set", "wide"), "node").select("crowd", "node", "component", "n_set", "wide")
        left = table(told.repartition("crowd").sortWithinPartitions("crowd").mapInArrow(lean(apart), "crowd long, a long, b long").distinct())
        out = confirmed(table(left.filter("a < b").select("a", "b").distinct()))
        if left.filter("a = b").limit(1).count():
            pairs, among_ = out, connected(left.filter("a = b").selectExpr("crowd", "a node"))
            out = table(pairs.unionByName(among_))
            drop(pairs, among_)
        drop(left)
        return out

    def connected(members: DataFrame) -> DataFrame:
        wanted = table(members.selectExpr("crowd", "node id").distinct())
        rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
        found = among(rows, wanted, "id").mapInArrow(lean(sets), "id long, s array<bigint>").join(wanted, "id")
        sorted_ = found.select("crowd", "id", "s").repartition("crowd").sortWithinPartitions("crowd", "id")
        out = table(sorted_.mapInArrow(lean(met), "a long, b long").distinct())
        drop(wanted)
        settle(docs.sparkSession)
        return out

    return exact, crowds


def similar_groups(docs: DataFrame, size: int = 5, least: float = 0.8, words: int = 4, bucket: int | None = None) -> DataFrame:
    """doc_id, component_id: documents linked at a Jaccard similarity of ``least`` of their shingle sets; exact.

    Only documents with equal sets are one node without a check. Pairs that share a shingle of their
    prefixes and pass the bounds of ``Sets`` (of ``words`` * 64 bits) are held against the sets
    themselves; neither prefixes nor bounds lose a pair. Null and empty texts have equal, empty sets.
    Rows of one id are one document, alike to what any of them is alike to; rows with a null id get
    the component of their set (null if no row with an id has it). An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    sets = Sets(words, least)
    order = spark.sparkContext.broadcast(_frequent(docs, size))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints_names = ["doc_id", "h0", "h1", *sets.names]

    def prints_of(batches):
        for b in slices(batches, "text"):
            held = shingle_sets(texts(b.column(1)), size)
            h = np.array([set_hash(x) for x in held])
            f = np.array([sets.parity(x) for x in held]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([len(x) for x in held], pa.int64()), *(pa.array(f[:, w]) for w in range(words)), pa.array([sets.wide(x) for x in held], pa.binary())], [*prints_names, "wide"])

    def keys_of(wanted=None, pairs: bool = False):
        """(key, owner) of the prefixes, the owner being the whole set; with ``wanted``, (key, doc_id) of those marked; of these and another one with ``pairs``."""

        def run(batches):
            for b in slices(batches, "text"):
                whole = shingle_sets(texts(b.column(1)), size)
                held = [sets.prefix(x, *order.value, int(pairs)) for x in whole]
                if not wanted:
                    h = np.array([set_hash(x)[0] for x in whole])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64)), pa.array(np.repeat(h, [len(x) for x in held]))], ["key", "owner"])
                    continue
                found = []
                for x in held:
                    hit = x[marked(wanted.value, x)]
                    if pairs:
                        both = [mixed(mixed(np.minimum(h, x)) + np.maximum(h, x))[x != h] for h in hit]
                        hit = np.unique(np.concatenate(both)) if both else hit
                    found.append(hit)
                ids = b.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), ids], ["key", "node"])

        return run

    def keyed(named: DataFrame, keys: DataFrame, pairs: bool) -> DataFrame:
        settle(spark)
        wanted = spark.sparkContext.broadcast(marks(keys, "key"))
        found = rows.filter("doc_id is not null").mapInArrow(lean(keys_of(wanted, pairs)), "key long, node long")
        return found.join(named, "node")

    prints = table(rows.mapInArrow(lean(prints_of), ", ".join(f"{x} long" for x in prints_names) + ", wide binary"))
    first = F.min(F.struct("doc_id", *sets.names, "wide")).alias("x")
    groups = table(prints.filter("doc_id is not null").groupBy("h0", "h1").agg(first).select("h0", "h1", F.col("x.doc_id").alias("node"), *(F.col(f"x.{n}").alias(n) for n in [*sets.names, "wide"])))
    nodes = groups.select("node", *sets.names)
    owners = rows.mapInArrow(lean(keys_of()), "key long, owner long").groupBy("key").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"))
    several = table(owners.filter("lo < hi").select("key"))
    all_rows = table(keyed(nodes, several, False))
    drop(several)
    finest = False

    def rows_of(named: DataFrame) -> DataFrame:
        return buckets.opened(all_rows.join(named.select("node", "component").distinct(), "node"))

    def refine(large: DataFrame) -> DataFrame | None:
        nonlocal finest
        if finest:
            return None
        finest = True
        members = large.select("node", "component", *sets.names).distinct()
        return keyed(members, large.select("key").distinct(), True)

    linked = buckets.linked_within(nodes, all_rows, rows_of, sets.names, sets.column, sets.near, refine, *_similar(docs, groups, size, sets), bucket=bucket)
    out = table(_named(prints.select("doc_id", "h0", "h1"), groups.select("node", "h0", "h1"), linked, ["h0", "h1"]).select("doc_id", "component_id"))
    drop(prints, groups, all_rows, linked)
    settle(spark)
    return out


def deduplicated(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """The documents, all columns, less all but the first (smallest id) of each group.

    Rows that repeat a kept id are all kept only if they are equal in id; rows with a null id stay.
    """
    groups = similar_groups(docs, size, least)
    gone = table(groups.filter("doc_id is not null and doc_id != component_id").select("doc_id").distinct())
    settle(docs.sparkSession)
    some = among(docs, gone, "doc_id").join(gone, "doc_id", "left_anti").select(*docs.columns)
    return some.unionByName(among(docs, gone, "doc_id", inside=False))
