"""Tick cleaning: duplicates, invalid prices, outliers, and what was removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import Rolling
from .ordered import quantiles


def dedup(ticks: DataFrame, keep: str = "first", keys: tuple[str, ...] = ("symbol", "ts"), order: str = "sequence") -> DataFrame:
    """One row per key: of least or greatest order; without keys every row. An aggregation with map-side combine, not a window."""
    if not keys:
        return ticks
    rest = [c for c in ticks.columns if c not in keys]
    pick = (F.min_by if keep == "first" else F.max_by)(F.struct(*rest), F.col(order)).alias("_row")
    return ticks.groupBy(*keys).agg(pick).select(*keys, "_row.*").select(*ticks.columns)


def invalid() -> Column:
    """True for a tick without price or volume, with a price that is not positive or a negative volume."""
    return F.coalesce((F.col("price") <= 0) | (F.col("volume") < 0), F.lit(True)) | F.col("price").isNull() | F.col("volume").isNull()


def by_time() -> Rolling:
    """A symbol's ticks in time order, those without a time last."""
    return Rolling(order=(F.asc_nulls_last("ts"), F.asc_nulls_last("sequence")))


def returns_within(ticks: DataFrame, z: float = 5.0, least: int = 10) -> DataFrame:
    """Drops ticks whose return lies more than z population deviations from its symbol's mean return, in symbols of
    more than `least` ticks; a null return stays. Statistics are aggregated and joined back: no symbol in one task but for the lag."""
    x = ticks.withColumn("_r", by_time().pct("price"))
    stats = x.groupBy("symbol").agg(F.avg("_r").alias("_m"), F.stddev_pop("_r").alias("_s"), F.count("*").alias("_n"))
    far = (F.col("_n") > least) & (F.abs(F.try_divide(F.col("_r") - F.col("_m"), F.col("_s"))) > z)
    return x.join(stats, "symbol").filter(~F.coalesce(far, F.lit(False))).select(*ticks.columns)


def volume_within(ticks: DataFrame, k: float = 3.0) -> DataFrame:
    """Drops volumes outside k interquartile ranges of their symbol's quartiles."""
    q = quantiles(ticks, "volume", [0.25, 0.75], ["symbol"], "_q")
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    return ticks.join(q, "symbol").filter(F.col("volume").between(lo - k * (hi - lo), hi + k * (hi - lo))).select(*ticks.columns)


def clean(ticks: DataFrame, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """The whole chain: first of duplicates by the keys (without keys no tick is one), valid prices, returns, volumes."""
    return volume_within(returns_within(dedup(ticks, keys=keys).filter(~invalid())))


def clean_stats(ticks: DataFrame, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Per symbol: rows before, duplicates by the keys, invalid, outliers, rows left and the quality score. A null symbol
    has a row, too; none of its ticks is left."""
    total = ticks.groupBy("symbol").agg(F.count("*").alias("total"))
    first = dedup(ticks, keys=keys).groupBy(F.col("symbol").alias("_of")).agg(F.count("*").alias("_d"), F.count_if(~invalid()).alias("_v"))
    out = total.join(first, F.col("symbol").eqNullSafe(F.col("_of"))).join(quality(clean(ticks, keys)), "symbol", "left")
    kept = F.coalesce("kept", F.lit(0))
    score = F.least(F.lit(1.0), kept * 7 / 10 / F.col("total") + 0.3 * F.coalesce("consistency", F.lit(0.5)))
    return out.select("symbol", "total", (F.col("total") - F.col("_d")).alias("duplicates"), (F.col("_d") - F.col("_v")).alias("invalid"), (F.col("_v") - kept).alias("outliers"), kept.alias("kept"), score.alias("quality"))


def gap_seconds(r: Rolling) -> Column:
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return (us(F.col("ts")) - us(r.lag("ts"))) / 1e6


def quality(ticks: DataFrame) -> DataFrame:
    """(symbol, kept, consistency): rows; one minus the deviation of the gaps in minutes, within 0 and 1, 0.5 for a single row."""
    g = ticks.select("symbol", gap_seconds(by_time()).alias("g"))
    s = F.coalesce(F.stddev_samp("g"), F.lit(0.0))
    return g.groupBy("symbol").agg(F.count("*").alias("kept"), F.when(F.count("*") <= 1, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - s / 60))).alias("consistency"))


def fill_calendar(bars: DataFrame, freq: str, limit: int = 3, weekends: bool = False) -> DataFrame:
    """Every bucket between a symbol's first and last bar, closes filled over at most `limit` empty ones."""
    span = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select("symbol", F.explode(F.sequence("a", "b", F.expr(f"interval {freq}"))).alias("ts"))
    if not weekends:
        grid = grid.filter(~F.dayofweek("ts").isin(1, 7))
    x = grid.join(bars.select("symbol", "ts", "close", "volume"), ["symbol", "ts"], "left")
    return x.select("symbol", "ts", Rolling().ffill_limited("close", limit).alias("close"), F.coalesce("volume", F.lit(0.0)).alias("volume"))


def interpolate(df: DataFrame, column: str, order: str = "ts", by: str = "symbol") -> Column:
    """Nulls between two known values on the straight line between them, by time; others stay null."""
    at = F.unix_micros(F.col(order).cast("timestamp"))
    known = F.when(F.col(column).isNotNull(), F.struct(at.alias("t"), F.col(column).alias("v")))
    back = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy(by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    a, b = F.last(known, True).over(back), F.first(known, True).over(on)
    return F.coalesce(F.col(column), a["v"] + (b["v"] - a["v"]) * F.try_divide(at - a["t"], b["t"] - a["t"]))


def robust_scale(df: DataFrame, columns: list[str], by: str = "symbol", clip: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """(x - median) / interquartile range, after clipping at two percentiles of the symbol."""
    x = df
    for c in columns:
        x = x.join(quantiles(df, c, [0.25, 0.5, 0.75, *clip], [by], f"_q_{c}"), by, "left")
    scaled = {c: F.try_divide(F.least(F.greatest(F.col(c), F.col(f"_q_{c}")[3]), F.col(f"_q_{c}")[4]) - F.col(f"_q_{c}")[1], F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0]) for c in columns}
    return x.withColumns(scaled).select(*df.columns)


def last_n(ticks: DataFrame, n: int) -> DataFrame:
    """The newest n rows of each symbol, as a bounded buffer holds them."""
    w = Window.partitionBy("symbol").orderBy(F.desc("sequence"))
    return ticks.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")
