"""Summaries of logs and quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .validate import quality_status


def trade_metrics(log: DataFrame) -> DataFrame:
    """log (pnl, latency_ms, slippage_pips): totals and means over all trades."""
    n = F.count("*")
    ratio = lambda a: F.coalesce(F.try_divide(a, n), F.lit(0.0))
    return log.agg(
        n.alias("total"), F.count_if(F.col("pnl") > 0).alias("wins"), F.count_if(F.col("pnl") < 0).alias("losses"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl"),
        ratio(F.sum("latency_ms")).alias("latency_ms"), ratio(F.sum("slippage_pips")).alias("slippage_pips"), ratio(F.count_if(F.col("pnl") > 0)).alias("win_rate"),
    )


def performance_metrics(log: DataFrame) -> DataFrame:
    """log (cpu_percent, memory_mb, latency_ms): means over all samples and the greatest latency."""
    mean = lambda c: F.coalesce(F.try_divide(F.sum(c), F.count("*")), F.lit(0.0)).alias(c)
    return log.agg(F.count("*").alias("samples"), mean("cpu_percent"), mean("memory_mb"), mean("latency_ms"), F.max("latency_ms").alias("max_latency_ms"))


def monitor_averages(log: DataFrame, minutes: int, ts: str = "timestamp") -> DataFrame:
    """The means and the greatest latency of the samples of the last minutes."""
    return performance_metrics(recent(log, minutes, ts=ts))


def recent(df: DataFrame, minutes: int, anchor=None, ts: str = "ts") -> DataFrame:
    """Rows of the last minutes before the anchor, by default the newest row."""
    if anchor is not None:
        return df.filter(F.col(ts) >= F.lit(anchor) - F.expr(f"interval {minutes} minutes"))
    newest = df.agg(F.max(ts).alias("_newest"))
    return df.join(F.broadcast(newest), F.col(ts) >= F.col("_newest") - F.expr(f"interval {minutes} minutes")).drop("_newest")


def latest(df: DataFrame, order: str = "sequence", by: str = "symbol") -> DataFrame:
    """The newest row of each symbol: an aggregation with map-side combine."""
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(by, "_row.*").select(*df.columns)


def quality_summary(metrics: DataFrame, hours: int | None = None) -> DataFrame:
    """metrics (ts, data_type, overall, anomalies, results array<struct<rule, passed>>) of the last hours by type."""
    x = recent(metrics, 60 * hours) if hours else metrics
    return x.groupBy("data_type").agg(F.count("*").alias("n"), F.avg("overall").alias("overall"), F.sum("anomalies").alias("anomalies"), F.sum(F.size(F.filter("results", lambda r: ~r["passed"]))).alias("failed"))


def current_status(metrics: DataFrame) -> DataFrame:
    """Mean of each type's newest score, and its grade."""
    newest = metrics.groupBy("data_type").agg(F.max_by("overall", "ts").alias("overall"))
    return newest.agg(F.avg("overall").alias("overall"), F.count("*").alias("types")).withColumn("status", quality_status(F.col("overall")))
