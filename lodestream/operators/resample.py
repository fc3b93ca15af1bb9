"""Ticks to OHLCV bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import micros

#: The bar lengths that are built by default.
FREQUENCIES = ["1 second", "5 seconds", "10 seconds", "30 seconds", "1 minute", "5 minutes", "15 minutes"]


def ohlcv(ticks: DataFrame, freq: str, order: str = "sequence") -> DataFrame:
    """ticks (ts, symbol, price, volume, side, <order>) -> one row per symbol and non-empty bucket [ts, ts + freq).
    One aggregation with map-side combine; open and close are the prices of least and greatest order."""
    seq, side = F.col(order), F.col("side")
    bars = ticks.groupBy("symbol", F.window("ts", freq).alias("_w")).agg(
        F.min_by("price", F.struct("ts", seq)).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("ts", seq)).alias("close"),
        F.sum("volume").alias("volume"), (F.count_if(side == "buy") - F.count_if(side == "sell")).alias("side_imbalance"), F.count("*").alias("ticks"),
    )
    return bars.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume", "side_imbalance", "ticks")


def derived(bars: DataFrame, literal: bool = False) -> DataFrame:
    """typical_price, price_range and volume per tick; literal: volume divided by one."""
    per_tick = F.col("volume") if literal else F.try_divide("volume", "ticks")
    return bars.withColumns({"typical_price": (F.col("high") + F.col("low") + F.col("close")) / 3, "price_range": F.col("high") - F.col("low"), "volume_per_tick": per_tick})


def rolled(bars: DataFrame, freq: str) -> DataFrame:
    """Bars of a longer length from bars whose length divides it."""
    out = bars.groupBy("symbol", F.window("ts", freq).alias("_w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.sum("side_imbalance").alias("side_imbalance"), F.sum("ticks").alias("ticks"),
    )
    return out.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume", "side_imbalance", "ticks")


def multi_frequency(ticks: DataFrame, freqs: list[str] = FREQUENCIES) -> DataFrame:
    """Bars of several lengths in one table, told apart by freq. Ticks make the bars of lengths that no shorter one
    divides; longer ones are rolled up from the shortest that does, so that every plan is two aggregations deep and the
    shuffle of ticks is reused."""
    made: dict[str, DataFrame] = {}
    for f in sorted(freqs, key=micros):
        shorter = [g for g in made if micros(f) % micros(g) == 0]
        made[f] = rolled(made[shorter[0]], f) if shorter else ohlcv(ticks, f)
    return reduce(DataFrame.unionByName, [derived(made[f]).withColumn("freq", F.lit(f)) for f in freqs])


def time_weighted(ticks: DataFrame, freq: str) -> DataFrame:
    """Mean price of a bucket weighted by the seconds for which each price held within it."""
    from pyspark.sql import Window

    bucket = F.window("ts", freq)
    x = ticks.select("symbol", "ts", "sequence", "price", bucket["start"].alias("bucket"), bucket["end"].alias("_end"))
    until = F.least(F.coalesce(F.lead("ts").over(Window.partitionBy("symbol", "bucket").orderBy("ts", "sequence")), F.col("_end")), F.col("_end"))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    x = x.withColumn("_s", (us(until) - us(F.col("ts"))) / 1e6)
    return x.groupBy("symbol", "bucket").agg(F.try_divide(F.sum(F.col("price") * F.col("_s")), F.sum("_s")).alias("twap"))
