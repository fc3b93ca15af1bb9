"""The test tables as ticks, books, news and logs, in Spark and, under *_SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resample


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("event_id") % 3 == 0, "buy").when(F.col("event_id") % 3 == 1, "sell").otherwise("unknown")
    return read(spark, sf_dir, "events").select(
        "ts", F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"), side.alias("side"), F.col("event_id").cast("string").alias("trade_id"), F.col("event_id").alias("sequence")
    )


TICKS_SQL = """ticks AS (
  SELECT ts, event_type AS symbol, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
         CASE event_id % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' ELSE 'unknown' END AS side, CAST(event_id AS VARCHAR) AS trade_id, event_id AS sequence
  FROM events)"""


def ticks_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many ticks at one instant: the order within a day is a sequence made from the keys."""
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), F.concat("l_returnflag", "l_linestatus").alias("symbol"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").cast("double").alias("volume"),
        F.lit("unknown").alias("side"), seq.alias("sequence"),
    )


BARS_1H_SQL = """bars AS (
  SELECT symbol, time_bucket(INTERVAL 1 hour, ts) AS ts, arg_min(price, sequence) AS open, max(price) AS high, min(price) AS low, arg_max(price, sequence) AS close,
         sum(volume) AS volume, count(*) FILTER (WHERE side = 'buy') - count(*) FILTER (WHERE side = 'sell') AS side_imbalance, count(*) AS ticks
  FROM ticks GROUP BY 1, 2)"""

BARS_1D_SQL = """bars AS (
  SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS TIMESTAMP) AS ts,
         arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS close, sum(l_quantity)::DOUBLE AS volume, count(*) AS ticks
  FROM lineitem GROUP BY 1, 2)"""


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.ohlcv(ticks(spark, sf_dir), "1 hour")


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.ohlcv(ticks_daily(spark, sf_dir), "1 day")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested five-level books; some short, crossed or with an empty level."""
    e, mid = F.col("event_id"), 100 + F.col("value")
    levels = F.sequence(F.lit(1), F.when(e % 50 == 0, 3).otherwise(5))
    size = lambda i, step, base: F.when((i == 2) & (e % 41 == 0), 0.0).otherwise((1 + (e * (i + step)) % base).cast("double"))
    bids = F.transform(levels, lambda i: F.struct((mid - 0.05 - 0.1 * (i - 1)).alias("price"), size(i, 0, 17).alias("size")))
    asks = F.transform(levels, lambda i: F.struct((mid + 0.05 + 0.1 * (i - 1)).alias("price"), size(i, 2, 13).alias("size")))
    crossed = e % 97 == 0
    return read(spark, sf_dir, "events").select("ts", F.col("event_type").alias("symbol"), F.when(crossed, asks).otherwise(bids).alias("bids"), F.when(crossed, bids).otherwise(asks).alias("asks"), e.alias("sequence"))


BOOKS_SQL = """levels AS (
  SELECT ts, event_type AS symbol, event_id AS sequence, i, 100 + value - 0.05 - 0.1 * (i - 1) AS p1, 100 + value + 0.05 + 0.1 * (i - 1) AS p2,
         CASE WHEN i = 2 AND event_id % 41 = 0 THEN 0.0 ELSE (1 + (event_id * i) % 17)::DOUBLE END AS s1,
         CASE WHEN i = 2 AND event_id % 41 = 0 THEN 0.0 ELSE (1 + (event_id * (i + 2)) % 13)::DOUBLE END AS s2
  FROM events, range(1, 6) t(i) WHERE NOT (event_id % 50 = 0 AND i > 3)
), books AS (
  SELECT ts, symbol, sequence, i, CASE WHEN sequence % 97 = 0 THEN p2 ELSE p1 END AS bid, CASE WHEN sequence % 97 = 0 THEN s2 ELSE s1 END AS bid_size,
         CASE WHEN sequence % 97 = 0 THEN p1 ELSE p2 END AS ask, CASE WHEN sequence % 97 = 0 THEN s1 ELSE s2 END AS ask_size
  FROM levels)"""


def cross_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, asset, close) of hourly bars of three event types."""
    names = F.when(F.col("symbol") == "click", "DXY").when(F.col("symbol") == "view", "SPY").when(F.col("symbol") == "signup", "TIPS")
    return bars_1h(spark, sf_dir).select("ts", names.alias("asset"), "close").filter("asset is not null")


def base_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_1h(spark, sf_dir).filter("symbol = 'purchase'")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    impact = F.when(e % 3 == 0, "high").when(e % 3 == 1, "medium").otherwise("low")
    return read(spark, sf_dir, "events").filter((F.col("event_type") == "error") & (e % 20 == 0)).select("ts", e.cast("string").alias("title"), impact.alias("impact"), F.lit("USD").alias("currency"))


NEWS_SQL = """news AS (
  SELECT ts, CAST(event_id AS VARCHAR) AS title, CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS impact, 'USD' AS currency
  FROM events WHERE event_type = 'error' AND event_id % 20 = 0)"""


def trade_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), k.alias("trade_id"), F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"), (F.col("o_totalprice") - 250000).alias("pnl"), (k % 80).cast("double").alias("latency_ms"), (k % 7 / 10).alias("slippage_pips")
    )


TRADE_LOG_SQL = """trade_log AS (
  SELECT CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderkey AS trade_id, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, o_totalprice - 250000 AS pnl,
         (o_orderkey % 80)::DOUBLE AS latency_ms, (o_orderkey % 7) / 10 AS slippage_pips FROM orders)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), ((F.col("doc_id") % 101) / 100.0).alias("p"))


PREDICTIONS_SQL = "predictions AS (SELECT doc_id AS id, quality AS y, (doc_id % 101) / 100.0 AS p FROM labels)"


def features_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(24)])


FEATURES_WIDE_SQL = "features_wide AS (SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(24)) + " FROM embeddings)"
