"""The batch operators on streams: watermarked bars, de-duplicated news, routed sinks, running indicator state."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def demo_ticks(spark: SparkSession, rate: int = 100) -> DataFrame:
    """A made-up tick stream: prices about 2000, exponential volumes, slightly more buys than sells."""
    r = spark.readStream.format("rate").option("rowsPerSecond", rate).load()
    return r.select(F.col("timestamp").alias("ts"), F.lit("XAUUSD").alias("symbol"), F.round(2000 + 0.5 * F.randn(), 2).alias("price"), (-F.ln(1 - F.rand())).alias("volume"), F.when(F.rand() < 0.51, "buy").otherwise("sell").alias("side"), F.col("value").alias("sequence"))


def demo_books(spark: SparkSession, rate: int = 10, levels: int = 5) -> DataFrame:
    r = spark.readStream.format("rate").option("rowsPerSecond", rate).load().withColumn("_half", 0.25 + 0.75 * F.rand())
    side = lambda sign: F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.struct((2000 + sign * (F.col("_half") + 0.1 * i)).alias("price"), (1 + 9 * F.col("_half")).alias("size")))
    return r.select(F.col("timestamp").alias("ts"), F.lit("XAUUSD").alias("symbol"), side(-1).alias("bids"), side(1).alias("asks"), F.col("value").alias("sequence"))


def file_ticks(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Ticks from files as they arrive; back-pressure by files per trigger. Times become TIMESTAMP, as watermarks need."""
    x = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return x.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_bars(ticks: DataFrame, freq: str = "1 minute", late: str = "10 seconds", slide: str | None = None) -> DataFrame:
    """Bars of ticks up to `late` behind; later ones are dropped and counted in the query's progress."""
    return ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", freq, slide) if slide else F.window("ts", freq)).agg(
        F.min_by("price", F.struct("ts", "sequence")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("ts", "sequence")).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("ticks"),
    ).select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "ticks")


def activity_sessions(ticks: DataFrame, gap: str = "5 minutes", late: str = "10 seconds") -> DataFrame:
    return ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("ticks"), F.sum("volume").alias("volume")).select("symbol", "w.start", "w.end", "ticks", "volume")


def dedup_news(news: DataFrame, keys: list[str], within: str = "24 hours") -> DataFrame:
    return news.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """For update mode: the newest price of each symbol."""
    return quotes.groupBy("symbol").agg(F.max_by("price", "ts").alias("price"), F.max("ts").alias("ts"))


def progress(query) -> dict[str, float]:
    """Counters of a running query over its recent batches: rows, rows a second, rows too late, batches and their mean duration."""
    p = query.recentProgress
    get = lambda x, *keys: next((x[k] for k in keys if k in x and x[k] is not None), 0)
    late = sum(get(s, "numRowsDroppedByWatermark") for x in p for s in x["stateOperators"])
    took = [get(x["durationMs"], "triggerExecution") for x in p]
    return {"batches": len(p), "rows": sum(x["numInputRows"] for x in p), "rows_per_second": max([get(x, "processedRowsPerSecond") for x in p], default=0), "late": late, "batch_ms": sum(took) / len(took) if took else 0.0}


STATE = "n long, ema double, atr double, close double"
OUT = "symbol string, ts timestamp, close double, ema_20 double, atr_14 double"


def running_indicators(bars: DataFrame) -> DataFrame:
    """Exponential mean and range of each symbol, carried across micro-batches in keyed state."""

    def step(key: tuple, frames, state: GroupState):
        n, ema, atr, last = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        for f in frames:
            rows = []
            for r in f.sort_values("ts").itertuples():
                tr = r.high - r.low if n == 0 else max(r.high - r.low, abs(r.high - last), abs(r.low - last))
                ema = r.close if n == 0 else ema + (r.close - ema) * 2 / 21
                atr = tr if n == 0 else atr + (tr - atr) * 2 / 15
                n, last = n + 1, r.close
                rows.append((key[0], r.ts, r.close, ema, atr))
            yield pd.DataFrame(rows, columns=["symbol", "ts", "close", "ema_20", "atr_14"])
        state.update((n, ema, atr, last))

    return bars.groupBy("symbol").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def fan_out(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Each micro-batch is persisted once and handed to every sink; the checkpoint makes replays safe for idempotent sinks."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for s in sinks:
                s(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
