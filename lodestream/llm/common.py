"""Shared folder, lineage cuts and small column helpers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space and the letters that the contracts name.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    conf = spark.sparkContext.getConf()
    if folder := conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    master = conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(spark.sparkContext, "_lodestream_dir"):
        spark.sparkContext._lodestream_dir = "file://" + tempfile.mkdtemp(prefix="lodestream-")
    return spark.sparkContext._lodestream_dir


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Tables of one run in the shared folder. A written table cuts the lineage and outlives lost executors."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.tables = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []
        Scratch.made.append(self)

    def clear(self) -> None:
        """Deletes all tables of the run, when nothing reads them any more."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        Scratch.made.remove(self)

    def cut(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        with self._cleaning():
            writer = df.write.option("compression", "zstd")
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def cut_bucketed(self, df: DataFrame, key: str, sort: bool = False) -> DataFrame:
        """A table bucketed by key, in spark.sql.shuffle.partitions buckets and, if asked for, sorted: joins on the key with
        another one, or with what a shuffle on the key deals out, move none of its rows. df should be dealt by key already."""
        name, path = f"scratch_{uuid.uuid4().hex}", f"{self.base}/bucketed-{uuid.uuid4().hex[:8]}"
        with self._cleaning():
            writer = df.write.bucketBy(buckets(self.spark), key).option("path", path).option("compression", "zstd")
            (writer.sortBy(key) if sort else writer).saveAsTable(name, format="parquet")
        out = self.spark.table(name)
        out._scratch_path, out._scratch_table = path, name
        self.tables.append(name)
        return out

    def cut_sorted(self, df: DataFrame, key: str) -> DataFrame:
        return self.cut_bucketed(df.repartition(buckets(self.spark), key), key, sort=True)

    def plain(self, table: DataFrame) -> DataFrame:
        """A bucketed table's rows without its buckets, as unions need them: Spark 4.1 takes a union of bucketed scans for
        dealt by key, but scans them as they lie, so that a groupBy above does not bring a key's rows together."""
        return self.spark.read.schema(table.schema).parquet(table._scratch_path)

    @contextlib.contextmanager
    def _cleaning(self) -> Iterator[None]:
        """What is written needs its shuffle files no more: Spark deletes them when the write ends, not when the driver's
        heap fills up."""
        setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(setting, "false")
        self.spark.conf.set(setting, "true")
        try:
            yield
        finally:
            self.spark.conf.set(setting, before)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            if hasattr(t, "_scratch_table"):
                self.spark.sql(f"DROP TABLE IF EXISTS {t._scratch_table}")
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def bucket_of(ids: np.ndarray, n: int) -> np.ndarray:
    """The bucket of n that Spark puts each long id in: Murmur3 of 32 bits with seed 42, modulo n."""
    word = np.uint32
    turn = lambda x, r: (x << word(r)) | (x >> word(32 - r))
    ids = np.asarray(ids, np.int64).view(np.uint64)
    h = np.full(len(ids), 42, word)
    for half in ((ids & np.uint64(0xFFFFFFFF)).astype(word), (ids >> np.uint64(32)).astype(word)):
        h = turn(h ^ turn(half * word(0xCC9E2D51), 15) * word(0x1B873593), 13) * word(5) + word(0xE6546B64)
    h ^= word(8)
    h = (h ^ (h >> word(16))) * word(0x85EBCA6B)
    h = (h ^ (h >> word(13))) * word(0xC2B2AE35)
    return (h ^ (h >> word(16))).view(np.int32).astype(np.int64) % n


def release_memory() -> None:
    """Gives memory that a task or a fit has freed back to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ascii_lower(c: Column) -> Column:
    """A-Z only; the plain lower() is used where every character is ASCII."""
    return F.when(F.char_length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fold(c: Column, parts: int) -> Column:
    """crc32 of an id as text, modulo parts."""
    return F.crc32(c.cast("string").cast("binary")) % parts


def hex_sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
