"""What the operators of this subpackage share: tables, scratch tables, hashes and text batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of text in one Arrow batch: bounds what a Python worker holds when documents are long.
TEXT_ROWS, TEXT_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Hand texts to Python workers in small batches; a text that is longer by itself is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names in spark.checkpoint.dir.

    Only where that is unset, as in tests on one machine, a temporary folder is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="alphaloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df is called so, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits of a row's id and text: the same wherever a row is read, shared by rows that repeat each other."""
    part = lambda c: F.coalesce(F.concat(F.lit("."), c.cast("string")), F.lit(""))
    return F.md5(F.concat_ws(":", F.length(part(doc_id)), part(doc_id), part(text)))


def reach_before(key: str, start: str = "start", end: str = "end") -> Column:
    """How far the intervals of a key reach that begin before one, or as early and end earlier; null for the first."""
    return F.max(end).over(Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))


def merged(intervals: DataFrame, key: str) -> DataFrame:
    """(key, start, end) half-open -> their union as separate intervals; those that touch are one."""
    apart = (F.col("start") > F.col("__reach")).cast("int")
    own = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    island = intervals.withColumn("__reach", reach_before(key)).withColumn("__island", F.sum(F.coalesce(apart, F.lit(1))).over(own))
    return island.groupBy(key, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column's rows as UTF-8 bytes, null rows as None."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return [None] * len(column)
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: Longer words are worked out each time they occur: what workers remember is bounded in bytes, not just in entries.
LONGEST_REMEMBERED = 64


class Memo(dict):
    """A bounded dict that computes what it lacks. Full, it becomes the old generation, whose used entries come back.

    Keys of more than LONGEST_REMEMBERED characters are not kept.
    """

    def __init__(self, compute, most: int = 250_000):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def make_room(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()

    def __missing__(self, key):
        if len(key) > LONGEST_REMEMBERED:
            return self.compute(key)
        self.make_room()
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


def fitting(sizes: list[int], most: int) -> list[int]:
    """The places of what fits into most in all, in order; what does not fit what is left is passed over."""
    out, left = [], most
    for i, size in enumerate(sizes):
        if size <= left:
            out.append(i)
            left -= size
    return out


_held: dict = {}


def held(make, *args):
    """make(*args), kept by a Python worker from task to task: one thing at a time, so that stages do not add up."""
    key = (make, *args)
    if key not in _held:
        release()
        _held[key] = make(*args)
    return _held[key]


def release() -> None:
    """Drop what an earlier stage left in this worker, and hand its memory back: workers outlive their stages."""
    if _held:
        _held.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Hand freed memory back to the system, which Arrow's pool and the allocator otherwise keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


#: Characters that a Cutter tells apart: all below NEAR, U+2581 as one of their own, the rest as one.
NEAR, MARK, FAR = 0x250, 0x250, 0x251


class Cutter:
    """Cuts a text wherever a table of character pairs says that nothing joins the two."""

    def __init__(self, joined: np.ndarray):
        """joined: (FAR + 1) x (FAR + 1) booleans; pairs with a far character count as joined."""
        self.cut = ~joined
        self.cut[FAR, :] = self.cut[:, FAR] = False
        self.cut[FAR, MARK] = not joined[FAR, MARK]

    def __call__(self, text: str) -> list[str]:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(code == 0x2581, MARK, np.where(code < NEAR, code, FAR))
        at = (np.flatnonzero(self.cut[code[:-1], code[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)]
