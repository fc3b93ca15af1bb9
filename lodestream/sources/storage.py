"""Partitioned Parquet storage: routed writes, tiered reads, catalogue, retention, compaction."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import dedup

#: Which sinks a kind of data goes to.
ROUTES = {"tick": ("parquet", "table", "cache"), "orderbook": ("parquet", "table"), "features": ("parquet", "cache"), "models": ("parquet",), "backtest": ("parquet",)}


def time_filter(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Both bounds inclusive and optional; without a time column nothing is filtered."""
    if ts in df.columns:
        df = df.filter(F.col(ts) >= F.lit(start)) if start is not None else df
        df = df.filter(F.col(ts) <= F.lit(end)) if end is not None else df
    return df


def by_day(df: DataFrame, ts: str = "ts") -> DataFrame:
    """(ts_date, start, end, records) of each day."""
    return df.groupBy(F.to_date(ts).alias("ts_date")).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("records"))


class Store:
    """Tables under one root, partitioned by data type and day, so that time bounds prune folders."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.cache: dict[str, tuple[DataFrame, float]] = {}

    def write(self, df: DataFrame, data_type: str, ts: str = "ts") -> bool:
        """Appends; refuses an empty frame. Part files have unique names, so writes never overwrite each other."""
        if df.isEmpty():
            return False
        df.withColumn("ts_date", F.to_date(ts)).repartition("ts_date").write.mode("append").option("compression", "lz4_raw").partitionBy("ts_date").parquet(f"{self.root}/{data_type}")
        return True

    def store(self, df: DataFrame, data_type: str) -> bool:
        done = self.write(df, data_type)
        if done and "table" in ROUTES.get(data_type, ()) and self.spark.catalog.tableExists(data_type):
            self.spark.catalog.recoverPartitions(data_type)  # the table lies over the same files; it learns of new days
        if done and "cache" in ROUTES.get(data_type, ()):
            self.put(f"{data_type}:latest", df)
        return done

    def read(self, data_type: str, start=None, end=None) -> DataFrame:
        df = self.spark.read.option("ignoreCorruptFiles", "true").parquet(f"{self.root}/{data_type}")
        if start is not None:
            df = df.filter(F.col("ts_date") >= F.to_date(F.lit(start)))
        if end is not None:
            df = df.filter(F.col("ts_date") <= F.to_date(F.lit(end)))
        return time_filter(df, start, end).drop("ts_date")

    def retrieve(self, data_type: str, start=None, end=None) -> DataFrame:
        """The cached frame if no bounds are given, else stored rows, the last of each (symbol, ts)."""
        if start is None and end is None and (hit := self.cached(f"{data_type}:latest")) is not None:
            return hit
        df = self.read(data_type, start, end)
        return dedup(df, "last") if {"symbol", "ts", "sequence"} <= set(df.columns) else df

    def put(self, key: str, df: DataFrame, seconds: float = 3600) -> None:
        """Persists a frame under a key for so many seconds."""
        self.drop(key)
        self.cache[key] = df.persist(), time.monotonic() + seconds

    def cached(self, key: str) -> DataFrame | None:
        df, until = self.cache.get(key, (None, 0.0))
        if df is not None and time.monotonic() > until:
            self.drop(key)
            return None
        return df

    def drop(self, key: str) -> None:
        df, _ = self.cache.pop(key, (None, 0.0))
        if df is not None:
            df.unpersist()

    def clear(self) -> None:
        for key in list(self.cache):
            self.drop(key)

    def create_tables(self, schemas: dict[str, str]) -> None:
        """Registers empty tables partitioned by day: {name: columns}."""
        for name, columns in schemas.items():
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, ts_date DATE) USING parquet PARTITIONED BY (ts_date) LOCATION '{self.root}/{name}'")

    def partitions(self, data_type: str, ts: str = "ts") -> DataFrame:
        """(ts_date, start, end, records, files, bytes) over all files of each day."""
        df = self.spark.read.parquet(f"{self.root}/{data_type}").select("ts_date", ts, "_metadata.file_path", "_metadata.file_size")
        per_file = df.groupBy("ts_date", "file_path", "file_size").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("records"))
        return per_file.groupBy("ts_date").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("records").alias("records"), F.count("*").alias("files"), F.sum("file_size").alias("bytes"))

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def delete_before(self, data_type: str, older_than) -> int:
        """Drops the days whose last row is older."""
        old = [r["ts_date"] for r in self.partitions(data_type).filter(F.col("end") < F.lit(older_than)).select("ts_date").collect()]
        for d in old:
            fs, p = self._path(f"{self.root}/{data_type}/ts_date={d}")
            fs.delete(p, True)
        return len(old)

    def compact(self, data_type: str, files_per_day: int = 1) -> None:
        """Rewrites each day into few files sorted by symbol and time, beside the old ones. The old folder is renamed aside
        and deleted only when the new one stands in its place, so that a crash leaves one of the two whole."""
        df = self.spark.read.parquet(f"{self.root}/{data_type}")
        target = f"{self.root}/_{data_type}_compacted"
        df.repartition("ts_date", *([F.pmod(F.xxhash64("symbol"), F.lit(files_per_day))] if files_per_day > 1 else [])).sortWithinPartitions("ts_date", "symbol", "ts").write.mode("overwrite").option("compression", "lz4_raw").partitionBy("ts_date").parquet(target)
        fs, old = self._path(f"{self.root}/{data_type}")
        aside = self._path(f"{self.root}/_{data_type}_replaced")[1]
        fs.delete(aside, True)
        if not fs.rename(old, aside) or not fs.rename(self._path(target)[1], old):
            raise OSError(f"{data_type}: the compacted folder could not be renamed; the rows are in {aside} or {old}")
        fs.delete(aside, True)

    def dump_buffers(self, buffers: dict[str, DataFrame]) -> None:
        """Writes each buffer whole, in place of what was dumped before."""
        for name, df in buffers.items():
            df.write.mode("overwrite").option("compression", "lz4_raw").parquet(f"{self.root}/_buffers/{name}")

    def restore_buffers(self, names: list[str]) -> dict[str, DataFrame]:
        return {name: self.spark.read.parquet(f"{self.root}/_buffers/{name}") for name in names}

    def recent_features(self, feature_set: str, minutes: int, data_type: str = "features") -> DataFrame:
        """The newest minutes of one feature set."""
        from ..operators.reports import recent

        return recent(self.read(data_type).filter(F.col("feature_set") == feature_set), minutes)

    def stats(self, data_types: list[str]) -> DataFrame:
        each = [self.partitions(t).agg(F.lit(t).alias("data_type"), F.count("*").alias("partitions"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes")) for t in data_types]
        return reduce(DataFrame.unionByName, each).filter("records > 0")


def narrow(df: DataFrame, floats: bool = False) -> DataFrame:
    """Whole columns that fit become INT, doubles FLOAT where asked for: bounds come from one aggregation."""
    longs = [f.name for f in df.schema if f.dataType.simpleString() == "bigint"]
    doubles = [f.name for f in df.schema if f.dataType.simpleString() == "double"] if floats else []
    if longs:
        b = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in longs]).first()
        fit = [c for c in longs if b[c]["lo"] is not None and b[c]["lo"] >= -(1 << 31) and b[c]["hi"] < 1 << 31]
        df = df.withColumns({c: F.col(c).cast("int") for c in fit})
    return df.withColumns({c: F.col(c).cast("float") for c in doubles}) if doubles else df


def read_log(spark: SparkSession, path: str, schema: str, since=None) -> DataFrame:
    """JSON lines; malformed ones are skipped."""
    return time_filter(spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path), since, None, "timestamp")


def key_stats(keys: DataFrame) -> DataFrame:
    """(key, records, bytes) -> totals by the key's first token."""
    return keys.groupBy(F.substring_index("key", "_", 1).alias("data_type")).agg(F.count("*").alias("n"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))


def read_jdbc(spark: SparkSession, url: str, table: str, start=None, end=None, **options) -> DataFrame:
    """A database table; time bounds are pushed down to it."""
    return time_filter(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), start, end, "timestamp")


def write_jdbc(df: DataFrame, url: str, table: str, defaults: dict | None = None, **options) -> None:
    for c, v in (defaults or {}).items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v))
    df.write.format("jdbc").mode("append").options(url=url, dbtable=table, **options).save()
