"""Conflict-constrained best-fit packing of documents into bins.

Pieces are dealt to shards by a hash of themselves and of their number among equal ones, so that no
source, cluster or repeated row gathers in one task and the shards do not depend on how files are
split. Each shard is packed on its own: longest piece first, bins ordered by what is left in them. The
search starts at the least residual that holds the piece and goes on to the next larger until a bin
has neither the piece's source nor its duplicate cluster; if none has, a new bin is opened. Runs of
neighbouring bins keep the intersection of their bitmaps, so a run that conflicts as a whole is one step.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship, slices, table, texts

#: Words of a bin; words (in bins) and pieces dealt to one shard on average.
CAPACITY, SHARD_BINS, SHARD_PIECES = 2048, 256, 16_384
#: Bins of a run, about.
RUN = 128
#: Equal rows that one task numbers.
EQUAL = 100_000


class Bins:
    """Bins by (residual, number), in runs; a run knows which sources and clusters all of its bins hold."""

    def __init__(self) -> None:
        self.sources: list[int] = []  # bitmap of each bin
        self.clusters: list[int] = []
        self.runs: list[list[tuple[int, int]]] = []
        self.last: list[tuple[int, int]] = []  # of each run
        self.common: list[tuple[int, int]] = []

    def _renew(self, at: int) -> None:
        run = self.runs[at]
        if not run:
            del self.runs[at], self.last[at], self.common[at]
            return
        s = c = -1
        for _, b in run:
            s &= self.sources[b]
            c &= self.clusters[b]
            if not (s or c):
                break
        self.last[at], self.common[at] = run[-1], (s, c)

    def add(self, left: int, b: int) -> None:
        key = (left, b)
        at = min(bisect.bisect_left(self.last, key), len(self.runs) - 1)
        if at < 0:
            self.runs, self.last, self.common = [[key]], [key], [(self.sources[b], self.clusters[b])]
            return
        bisect.insort(self.runs[at], key)
        s, c = self.common[at]
        self.last[at], self.common[at] = self.runs[at][-1], (s & self.sources[b], c & self.clusters[b])
        if len(self.runs[at]) > 2 * RUN:
            self.runs.insert(at + 1, self.runs[at][RUN:])
            del self.runs[at][RUN:]
            self.last.insert(at + 1, key)
            self.common.insert(at + 1, (0, 0))
            self._renew(at + 1)
            self._renew(at)

    def take(self, n: int, source: int, cluster: int) -> tuple[int, int] | None:
        """Remove and return the tightest (residual, bin) that holds ``n`` words and neither bit."""
        first = at = bisect.bisect_left(self.last, (n, -1))
        while at < len(self.runs):
            s, c = self.common[at]
            if not (s & source or c & cluster):
                run = self.runs[at]
                for i in range(bisect.bisect_left(run, (n, -1)) if at == first else 0, len(run)):
                    b = run[i][1]
                    if not (self.sources[b] & source or self.clusters[b] & cluster):
                        found = run.pop(i)
                        self._renew(at)
                        return found
            at += 1
        return None


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each piece, in the order given. Negative source or cluster: no conflict."""
    bins = Bins()
    out = []
    for n, s, c in zip(lengths, sources, clusters):
        source, cluster = (1 << s if s >= 0 else 0), (1 << c if c >= 0 else 0)
        found = bins.take(n, source, cluster)
        if found is None:
            found = capacity, len(bins.sources)
            bins.sources.append(0)
            bins.clusters.append(0)
        left, b = found
        bins.sources[b] |= source
        bins.clusters[b] |= cluster
        if left > n:
            bins.add(left - n, b)
        out.append(b)
    return out


def _codes(values: pd.Series) -> list[int]:
    """Small numbers for the values that occur twice or more, -1 for the others: they conflict with none."""
    return pd.factorize(values.where(values.duplicated(keep=False) & values.notna()))[0].tolist()


def _packed(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "piece", "source", "cluster", "nth"], ascending=[False, True, True, True, True, True], ignore_index=True)
    pdf["bin"] = best_fit(pdf["length"].tolist(), _codes(pdf["source"]), _codes(pdf["cluster"]), capacity)
    pdf["slot"] = pdf.groupby("bin").cumcount()
    used = pdf.groupby("bin")["length"].transform("sum")
    pdf["bin_id"] = pdf["shard"] * (1 << 32) + pdf["bin"]
    pdf["free"] = capacity - used
    return pdf[["bin_id", "slot", "doc_id", "piece", "start", "length", "free"]]


def items(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, words, source and cluster (a hash of the lower-cased words) of every document."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(source).cast("string").alias("source"))

    def run(batches):
        for b in slices(batches, "text"):
            words = [t.lower().split() for t in texts(b.column(1))]
            cluster = [np.int64(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(w)))) for w in words]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int64()), b.column(2), pa.array(cluster, pa.int64())], ["doc_id", "words", "source", "cluster"])

    return rows.mapInArrow(lean(run), "doc_id long, words long, source string, cluster long")


def pack(rows: DataFrame, capacity: int = CAPACITY, shard_bins: int = SHARD_BINS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """bin_id, slot, doc_id, piece, start, length, free for (doc_id, words, source, cluster) rows.

    A document longer than ``capacity`` is cut into pieces of that many words. No bin holds two
    pieces of one source or one cluster; a null source or cluster never conflicts. A document
    without words gets one row with a null bin. Repeated rows are packed each; no input: no rows.
    """
    ship(rows.sparkSession)
    equal = table(rows.groupBy("doc_id", "words", "source", "cluster").agg(F.count("*").alias("n")))
    words, pieces = equal.agg(F.sum(F.expr("words * n")), F.sum(F.expr(f"(words + {capacity} - 1) div {capacity} * n"))).collect()[0]
    shards = max(1, -(-(words or 0) // (capacity * shard_bins)), -(-(pieces or 0) // shard_pieces))
    some = equal.withColumn("some", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {EQUAL}"))))
    if equal.filter(F.col("n") > EQUAL).limit(1).count():
        some = some.repartition("doc_id", "some")
    each = some.withColumn("nth", F.explode(F.sequence(F.expr(f"some * {EQUAL}L"), F.expr(f"least(n, (some + 1) * {EQUAL}L) - 1")))).drop("n", "some")
    dealt = each.filter(F.col("words") > 0).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(words - 1) div {capacity}"))))
    dealt = dealt.select(
        F.pmod(F.xxhash64("doc_id", "cluster", "source", "nth", "piece"), F.lit(shards)).alias("shard"), "doc_id", "source", "cluster", "piece", "nth",
        (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("piece") * capacity).alias("length"),
    )
    packed = dealt.groupBy("shard").applyInPandas(lambda pdf: _packed(pdf, capacity), "bin_id long, slot long, doc_id long, piece long, start long, length long, free long")
    empty = each.filter(F.coalesce("words", F.lit(0)) <= 0).selectExpr("cast(null as long) bin_id", "0L slot", "doc_id", "0L piece", "0L start", "0L length", "cast(null as long) free")
    return packed.unionByName(empty)
