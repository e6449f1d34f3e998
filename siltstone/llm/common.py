"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches of texts: a few MB each, in the JVM and in Python, whatever the lengths.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

#: Stands for a null id inside an operator, so that joins on it need no null checks. A real id of this value (the least
#: long) counts as null there.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's place, if they share it, and bound what they get at once."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only where it is
    unset (local sessions, tests) a temporary folder of this machine serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/siltstone/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, keep: bool = False, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path, compression=codec)
    if not keep:
        atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete what :func:`materialise` wrote, once all that was made of it is written itself."""
    for df in frames:
        if (path := getattr(df, "shared_path", None)) is not None:
            remove(df.sparkSession, path)


def give_back() -> None:
    """Return freed memory to the system: the driver is small, and its tables come and go."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a long that no other row has, written once, so that retries and later reads agree on it."""
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), codec="zstd")


#: Bits of a membership filter (a fixed size: 2^23 bits are 262,144 rows of two longs).
FILTER_BITS = 1 << 23


def filter_of(ids: DataFrame, *key: str) -> DataFrame:
    """A filter of FILTER_BITS bits over the keys of ``ids``, as a small written table."""
    slot = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    bits = F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits")
    return materialise(ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("word")).agg(bits))


def may_hold(df: DataFrame, held: DataFrame, *key: str, name: str) -> DataFrame:
    """``df`` with ``name``: whether its key may be in the filter; false is certain. The filter's size bounds the broadcast."""
    slot = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    word, bits = fresh(df, "word"), fresh(df, "bits")
    marked = df.withColumn(word, F.shiftright(slot, 5)).join(F.broadcast(held.withColumnsRenamed({"word": word, "bits": bits})), word, "left")
    hit = F.getbit(F.coalesce(F.col(bits), F.lit(0).cast("long")), slot.bitwiseAND(F.lit(31)).cast("int")) == 1
    return marked.withColumn(name, hit).drop(word, bits)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended
        pass


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def safe_id(name: str = "doc_id"):
    """The id as a long that is never null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def real_id(name: str = "uid"):
    """The inverse of :func:`safe_id`."""
    return F.when(F.col(name) != NULL_ID, F.col(name))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, concatenated, and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``most`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class PrefixHash:
    """Polynomial hashes, modulo 2^64, of any slices of a byte string."""

    BASE = 0x9E3779B97F4A7C15 | 1
    _pow = np.ones(1, np.uint64)
    _inv = np.ones(1, np.uint64)

    @classmethod
    def _powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._pow) < n:
            n = 1 << (n - 1).bit_length()
            out = []
            for base in (cls.BASE, pow(cls.BASE, -1, 1 << 64)):
                p = np.full(n, base & (2**64 - 1), np.uint64)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            cls._pow, cls._inv = out
        return cls._pow[:n], cls._inv[:n]

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = self._powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def windows(self, width: int) -> np.ndarray:
        """The hash of every slice of ``width`` bytes."""
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)
