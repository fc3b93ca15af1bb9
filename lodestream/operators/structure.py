"""Volume profiles and price structure: liquidity sweeps, order blocks, gaps, swings, premium and discount."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import market_session
from ..functions.windows import Rolling

R = Rolling()
PIP = 0.01


def profile(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray, bins: int = 50, share: float = 0.7) -> tuple[float, float, float, float]:
    """(point of control, value area high, value area low, volume) of one window: a bar's volume is dealt equally to the
    bins it touches; the value area grows from the fullest bin to its heavier neighbour, the lower one on ties."""
    lo, hi = low.min(), high.max()
    if not hi > lo:
        return close[-1], close[-1], close[-1], 0.0
    step = (hi - lo) / bins
    a, b = (np.clip(((x - lo) / step).astype(int), 0, bins - 1) for x in (low, high))
    edge = np.zeros(bins + 1)
    per_bin = volume / (b - a + 1)
    np.add.at(edge, a, per_bin)
    np.subtract.at(edge, b + 1, per_bin)
    held = np.cumsum(edge[:-1])
    held[held < 1e-12 * max(volume.sum(), 1e-300)] = 0.0
    top = int(held.argmax())
    i = j = top
    got, need = held[top], share * held.sum()
    while got < need and (i > 0 or j < bins - 1):
        below, above = held[i - 1] if i > 0 else -1.0, held[j + 1] if j < bins - 1 else -1.0
        if above > below:
            j += 1
            got += above
        else:
            i -= 1
            got += below
    return lo + (top + 0.5) * step, lo + (j + 1) * step, lo + i * step, float(held.sum())


def rolling_profile(bars: DataFrame, lookback: int = 100, bins: int = 50, share: float = 0.7, prefix: str = "vpvr") -> DataFrame:
    """The profile of the last `lookback` bars at each bar, null until half of them stand. The window travels as an
    array of lookback structs, so that a task never holds a whole symbol."""
    w = F.collect_list(F.struct("high", "low", "close", "volume")).over(R.rows(lookback))
    x = bars.withColumn("_w", F.when(R.n >= lookback // 2, w))
    kind = "struct<poc: double, vah: double, val: double, held: double>"

    @F.pandas_udf(kind)
    def compute(col: pd.Series) -> pd.DataFrame:
        rows = []
        for cell in col:
            if cell is None:
                rows.append((None,) * 4)
            else:
                m = np.array([(r["high"], r["low"], r["close"], r["volume"]) for r in cell], float).T
                rows.append(profile(*m, bins, share))
        return pd.DataFrame(rows, columns=["poc", "vah", "val", "held"], dtype=float)

    x = x.withColumn("_p", compute("_w")).drop("_w")
    part = lambda n: F.when(~F.isnan(F.col(f"_p.{n}")), F.col(f"_p.{n}"))
    return x.withColumns({f"{prefix}_poc_{lookback}": part("poc"), f"{prefix}_vah_{lookback}": part("vah"), f"{prefix}_val_{lookback}": part("val")}).drop("_p")


def breakout(close: Column, vah: Column, val: Column, widths: float = 2.0) -> Column:
    d = widths * (vah - val)
    return F.coalesce(F.when(close >= vah + d, 1).when(close <= val - d, -1).otherwise(0), F.lit(0))


def poc_distance(close: Column, poc: Column) -> dict[str, Column]:
    near = lambda pips: F.coalesce((F.abs(close - poc) <= pips * PIP).cast("int"), F.lit(0))
    return {"poc_distance": (close - poc) / PIP, "near_poc_05": near(0.5), "near_poc_1": near(1), "near_poc_2": near(2)}


def volume_distribution(bars: DataFrame, lookback: int = 50) -> DataFrame:
    """Rolling skew, excess kurtosis and the number of volumes above their own 75th percentile."""
    w = R.rows(lookback)
    ok = (R.n >= lookback // 2) & (R.n > 10)
    p75 = F.expr("percentile(volume, 0.75)").over(w)
    x = bars.withColumns({"_p": p75, "_w": F.collect_list("volume").over(w)})
    return x.withColumns({
        "volume_skew": F.when(ok, F.skewness("volume").over(w)), "volume_kurtosis": F.when(ok, F.kurtosis("volume").over(w)),
        "volume_high_count": F.when(ok, F.size(F.filter("_w", lambda v: v > F.col("_p")))),
    }).drop("_p", "_w")


def poc_by_bins(bars: DataFrame, by: list[str], bins: int = 50) -> DataFrame:
    """Point of control of each group, in plain aggregations: bars are dealt to bins and the fullest bin wins, the lower
    one on ties. No group meets in one task."""
    span = bars.groupBy(*by).agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"))
    x = bars.join(span, by).withColumn("_step", (F.col("_hi") - F.col("_lo")) / bins).filter("_step > 0")
    at = lambda c: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(c) - F.col("_lo")) / F.col("_step")).cast("int")))
    x = x.withColumns({"_a": at("low"), "_b": at("high")}).withColumn("_bin", F.explode(F.sequence("_a", "_b")))
    held = x.groupBy(*by, "_bin").agg(F.sum(F.col("volume") / (F.col("_b") - F.col("_a") + 1)).alias("_v"), F.first("_lo").alias("_lo"), F.first("_step").alias("_step"))
    return held.groupBy(*by).agg(F.max_by(F.struct("_bin", "_lo", "_step"), F.struct(F.round("_v", 6), -F.col("_bin"))).alias("_t"), F.sum("_v").alias("held")).select(*by, (F.col("_t._lo") + (F.col("_t._bin") + 0.5) * F.col("_t._step")).alias("poc"), "held")


def sessions(bars: DataFrame) -> DataFrame:
    """session and segment, the number of a symbol's contiguous stretch of one session."""
    x = bars.withColumn("session", market_session(F.col("ts")))
    changed = F.when(R.lag("session").isNull() | (R.lag("session") != F.col("session")), 1).otherwise(0)
    return x.withColumn("_new", changed).withColumn("segment", F.sum("_new").over(R.cum)).drop("_new")


def session_profile(bars: DataFrame, bins: int = 30, least: int = 10) -> DataFrame:
    """Per contiguous session of more than `least` bars: its point of control, and the one of the symbol's session before."""
    x = sessions(bars)
    size = x.groupBy("symbol", "segment").agg(F.first("session").alias("session"), F.count("*").alias("bars"), F.min("ts").alias("start"), F.sum("volume").alias("volume"))
    out = size.join(poc_by_bins(x, ["symbol", "segment"], bins), ["symbol", "segment"], "left").filter(F.col("bars") > least).drop("held")
    return out.withColumn("prev_session_poc", F.lag("poc").over(Window.partitionBy("symbol").orderBy("segment")))


def liquidity(bars: DataFrame, lookback: int = 5, tol: float = 3 * PIP, include_current: bool = False) -> DataFrame:
    """Sweeps and grabs of recent highs and lows; include_current compares a bar with a window that holds it, where a
    sweep can never be seen."""
    w = R.rows(lookback) if include_current else R.prior(lookback)
    hi, lo = F.max("high").over(w), F.min("low").over(w)
    ready = R.n > 10
    w10 = R.rows(10)
    x = bars.withColumns({"_h10": F.max("high").over(w10), "_l10": F.min("low").over(w10), "_hs": F.collect_list("high").over(w10), "_ls": F.collect_list("low").over(w10), "_ready": ready})
    flag = lambda c: F.when(F.col("_ready") & F.coalesce(c, F.lit(False)), 1).otherwise(0)
    x = x.withColumns({
        "sweep_high": flag((F.col("high") > hi + tol) & (F.col("low") < hi)), "sweep_low": flag((F.col("low") < lo - tol) & (F.col("high") > lo)),
        "equal_highs": flag(F.size(F.filter("_hs", lambda v: F.abs(v - F.col("_h10")) <= tol)) >= 2), "equal_lows": flag(F.size(F.filter("_ls", lambda v: F.abs(v - F.col("_l10")) <= tol)) >= 2),
    })
    return x.withColumn("liquidity_grab", F.greatest("sweep_high", "sweep_low", "equal_highs", "equal_lows")).drop("_h10", "_l10", "_hs", "_ls", "_ready")


def order_blocks(bars: DataFrame, lookback: int = 20, move: float = 0.005) -> DataFrame:
    """The first bar of the window whose return exceeds the move: its low (up) or high (down), strength and distance."""
    x = bars.withColumns({"_rn": R.n, "_ret": R.pct("close")})
    w, wide = R.rows(lookback), R.rows(lookback + 1)
    ready = F.count("*").over(wide) >= 5
    up, down = F.when(F.col("_ret") > move, F.col("_rn")), F.when(F.col("_ret") < -move, F.col("_rn"))
    pick = lambda v, k: F.min_by(v, k).over(w)
    x = x.withColumns({"order_block_bull": F.when(ready, pick("low", up)), "order_block_bear": F.when(ready, pick("high", down)), "_mv": F.avg("volume").over(wide), "_bv": pick("volume", up), "_sv": pick("volume", down)})
    x = x.withColumns({"order_block_bull_strength": F.when(ready, F.try_divide("_bv", "_mv")), "order_block_bear_strength": F.when(ready, F.try_divide("_sv", "_mv"))})
    return x.withColumn("order_block_distance", F.least(F.abs(F.col("close") - F.col("order_block_bull")), F.abs(F.col("close") - F.col("order_block_bear")))).drop("_rn", "_ret", "_mv", "_bv", "_sv")


def fair_value_gaps(bars: DataFrame, gap: float = 2 * PIP) -> DataFrame:
    h2, l2 = R.lag("high", 2), R.lag("low", 2)
    up, down = h2 < F.col("low") - gap, l2 > F.col("high") + gap
    return bars.withColumns({"fvg_up": F.coalesce(up.cast("int"), F.lit(0)), "fvg_down": F.coalesce(down.cast("int"), F.lit(0)), "fvg_size": F.when(up, (F.col("low") - h2) / PIP).when(down, (l2 - F.col("high")) / PIP).otherwise(0.0)})


def structure_breaks(bars: DataFrame, lookback: int = 50, least: int = 10) -> DataFrame:
    """Breaks of structure from strict two-sided swings inside the last lookback + 1 bars. A swing is known two bars later."""
    side = lambda c, k: F.lead(c, k).over(R.w) if k > 0 else F.lag(c, -k).over(R.w)
    top = lambda c, cmp: cmp(side(c, -1)) & cmp(side(c, -2)) & cmp(side(c, 1)) & cmp(side(c, 2))
    x = bars.withColumns({"_sh": F.when(top("high", lambda o: F.col("high") > o), F.col("high")), "_sl": F.when(top("low", lambda o: F.col("low") < o), F.col("low"))})
    w = R.w.rowsBetween(-(lookback - 2), -2)
    x = x.withColumns({"_nh": F.count("_sh").over(w), "_nl": F.count("_sl").over(w), "_lh": F.last("_sh", True).over(w), "_ll": F.last("_sl", True).over(w), "_ok": F.count("*").over(R.rows(lookback + 1)) >= least})
    bull = F.col("_ok") & (F.col("_nh") >= 2) & (F.col("high") > F.col("_lh"))
    bear = F.col("_ok") & (F.col("_nl") >= 2) & (F.col("low") < F.col("_ll"))
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    choch = (bull & (F.col("_nl") >= 2)) | (bear & (F.col("_nh") >= 2))
    x = x.withColumns({"bos_bull": flag(bull), "bos_bear": flag(bear), "choch": flag(choch), "mss": flag(choch & ((F.col("_nh") >= 3) | (F.col("_nl") >= 3)))})
    return x.drop("_sh", "_sl", "_nh", "_nl", "_lh", "_ll", "_ok")


def premium_discount(bars: DataFrame, lookback: int = 50, least: int = 25, include_current: bool = True) -> DataFrame:
    """1 in the upper 30 % of the range of lookback + 1 bars, -1 in the lower 30 %; inducement beyond the range of the bars before."""
    w, prior = R.rows(lookback + 1), R.prior(lookback)
    hi, lo = F.max("high").over(w), F.min("low").over(w)
    ready, c = F.count("*").over(w) >= least, F.col("close")
    edge = w if include_current else prior
    induced = (c > 1.001 * F.max("high").over(edge)) | (c < 0.999 * F.min("low").over(edge))
    return bars.withColumns({
        "premium_discount": F.when(ready & (c > lo + 0.7 * (hi - lo)), 1).when(ready & (c < lo + 0.3 * (hi - lo)), -1).otherwise(0),
        "inducement": F.when(ready & F.coalesce(induced, F.lit(False)), 1).otherwise(0),
    })


def smart_money(bars: DataFrame) -> DataFrame:
    out = bars
    for part in (liquidity, order_blocks, fair_value_gaps, structure_breaks, premium_discount):
        out = part(out)
    return out
