"""Helpers that every operator of this folder shares."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A mapper works on slices of at most this many bytes of text at once (one row at least).
SLICE_BYTES = 500_000
#: Rows of an Arrow batch in the registered queries, which bounds what a worker and the JVM hold of long texts.
ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_graphloom_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom_llm.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in (top / "__init__.py", *sorted((top / "llm").glob("*.py"))):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(target))
    sc._graphloom_shipped = True


def settings(spark: SparkSession) -> SparkSession:
    """What the registered queries ask of a session: Arrow batches of ROWS texts, unless it has its own size."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, str(ROWS))
    return spark


def lean(mapper):
    """A mapper of Arrow batches that gives back at its end what its Python worker holds for no one.

    Workers are used again by later stages; what one stage leaves behind would count against the next.
    """

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from mapper(batches)
        finally:
            _powers.clear()
            gc.collect()
            _trim()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, where that is unset, one under /tmp/checkpoints.

    On a cluster an unset folder is an error: one machine's own folder would be lost with it.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"/tmp/checkpoints/{sc.applicationId}"
        sc.setCheckpointDir(found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the context may be gone at exit; the folder is then the cluster's to clear
        pass


def table(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again.

    The files outlive any executor. ``drop`` removes them early, otherwise they go at exit.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Remove tables written by ``table`` that nothing reads any more."""
    for df in frames:
        _remove(df.sparkSession, df._graphloom_path)


#: Bits of the map that ``marks`` makes for every task: 2 MB, whatever the number of values.
MAP_BITS = 1 << 24


def marks(values: DataFrame, name: str, bits: int = MAP_BITS) -> np.ndarray:
    """A bitmap of the low bits of the (hashed) longs in ``values``; it is of fixed size, and misses none."""
    place = F.expr(f"{name} & {bits - 1}L")
    words = values.select(place.alias("b")).groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("m")).toArrow()
    bitmap = np.zeros(bits // 64, dtype=np.uint64)
    bitmap[np.asarray(words["w"], dtype=np.int64)] = np.asarray(words["m"], dtype=np.int64).view(np.uint64)
    return bitmap


def marked(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be one of those that ``marks`` was given; false for no value that is."""
    at = values.astype(np.uint64) & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def among(rows: DataFrame, ids: DataFrame, name: str, inside: bool = True) -> DataFrame:
    """Rows whose ``name`` may be in the same column of ``ids``, or with ``inside=False`` the others, which are not.

    A bitmap of fixed size tells, so that a join moves few other rows. It never misses an id; the more
    ids there are, the more other rows it lets pass. ``ids`` should be a written table.
    """
    place = F.xxhash64(F.col(name).cast("long"))
    sent = rows.sparkSession.sparkContext.broadcast(marks(ids.select(place.alias("h")), "h"))

    def run(batches):
        for b in batches:
            part = b.filter(pa.array(marked(sent.value, np.asarray(b.column(b.num_columns - 1), dtype=np.int64).view(np.uint64)) == inside))
            yield pa.RecordBatch.from_arrays(part.columns[:-1], part.schema.names[:-1])

    return rows.select(F.struct("*").alias("row"), place.alias("place")).mapInArrow(lean(run), f"row {rows.select(F.struct('*').alias('row')).schema['row'].dataType.simpleString()}").select("row.*")


def settle(spark: SparkSession) -> None:
    """Let the driver give up what finished jobs left: shuffle files (Spark removes them when their plans are collected) and memory."""
    spark.sparkContext._jsc.emptyRDD().count()  # the listener bus holds its last event, and with it the plan of the last query
    gc.collect()
    _trim()
    spark.sparkContext._jvm.System.gc()


def _trim() -> None:
    """Give free memory of this process back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4


def sampled(df: DataFrame, limit: int, total: int, *by: str) -> DataFrame:
    """At most ``limit`` rows of ``df`` (of ``total``), chosen by a hash of ``by`` alone.

    About nine tenths of the limit pass the threshold, so the final sort is over few rows.
    """
    h = F.pmod(F.xxhash64(*by), F.lit(1 << 40))
    share = min(1.0, 0.9 * limit / max(1, total))
    return df.withColumn("_h", h).filter(F.col("_h") < int(share * (1 << 40)) + 1).orderBy("_h", *by).limit(limit).drop("_h")


def evenly(text: str, longest: int, parts: int = 10) -> Column:
    """A text, or of one beyond ``longest`` characters so many from ``parts`` places spread evenly over all of it."""
    size = longest // parts
    cut = F.concat_ws(" ", *(F.substring(F.col(text), (F.lit(i) * (F.length(text) - size) / (parts - 1)).cast("int") + 1, F.lit(size)) for i in range(parts)))
    return F.when(F.length(text) <= longest, F.col(text)).otherwise(cut)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def text_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A text column; that of ``row`` if the batch has whole rows."""
    at = batch.schema.get_field_index(column)
    return batch.column(at) if at >= 0 else pc.struct_field(batch.column(batch.schema.get_field_index("row")), column)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` holds at most ``limit`` bytes in each, or a single row."""
    for b in batches:
        c = text_of(b, column).cast(pa.large_string())
        if not len(c):
            continue
        ends = np.frombuffer(c.buffers()[1], dtype=np.int64)[c.offset : c.offset + len(c) + 1]
        at = 0
        while at < len(c):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield b.slice(at, to - at)
            at = to


# --- words of concatenated texts, hashed without a loop over words ---------------------------------

_MULT = 0x9E3779B97F4A7C15 | 1
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Words as white space (0x20, 0x09-0x0D) leaves them.
SOLID = np.ones(256, dtype=bool)
SOLID[[32, *range(9, 14)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64; those for long texts are not kept."""
    if len(_powers.get("up", ())) >= n:
        return _powers["up"][:n], _powers["down"][:n]
    size = max(1 << 16, n + n // 4) if n <= 2 * SLICE_BYTES else n
    made = []
    for m in (_MULT, pow(_MULT, -1, 1 << 64)):
        x = np.full(size, m, dtype=np.uint64)
        x[0] = 1
        made.append(np.multiply.accumulate(x))
    if n <= 2 * SLICE_BYTES:
        _powers.update(up=made[0], down=made[1])
    return made[0][:n], made[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Lower-cased words (runs of ASCII letters, digits and bytes from 128 on) of several texts.

    start, end: byte positions of each word in the concatenation. first: index of each text's
    first word, and the number of words at the end. origin: byte position of each text.
    """

    def __init__(self, docs: list[bytes], within: np.ndarray = _WORD):
        """within: of each byte, whether it is part of a word."""
        data = np.frombuffer(b" ".join(docs) + b" ", dtype=np.uint8)
        lengths = np.fromiter((len(d) + 1 for d in docs), dtype=np.int64, count=len(docs))
        self.origin = np.concatenate(([0], np.cumsum(lengths)))
        inside = within[data]
        step = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = step[0::2], step[1::2]
        self.first = np.searchsorted(self.start, self.origin)
        self.first[-1] = len(self.start)
        self._down = _power(len(data) + 1)[1]
        self._sum = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_LOWER[data].astype(np.uint64) * _power(len(data))[0], out=self._sum[1:])

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first ``longest`` bytes."""
        end = self.end if longest is None else np.minimum(self.end, self.start + longest)
        raw = (self._sum[end] - self._sum[self.start]) * self._down[self.start]
        return mixed(raw + (end - self.start).astype(np.uint64))


def long_id(row: np.ndarray) -> pa.Array:
    return pa.array(row, type=pa.int64())
