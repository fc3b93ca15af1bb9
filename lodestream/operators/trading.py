"""Labels, order flow, simulated fills, costs and risk limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import market_session
from ..functions.windows import Rolling
from .align import asof, within_events

R = Rolling()


def order_flow(ticks: DataFrame, windows: tuple[int, ...] = (20, 60)) -> DataFrame:
    """Cumulative volume delta, trade size, buy share and trades a second over the last trades."""
    t = Rolling(order=("ts", "sequence"))
    signed = F.when(F.col("side") == "buy", F.col("volume")).when(F.col("side") == "sell", -F.col("volume")).otherwise(0.0)
    x = ticks.withColumns({"_s": signed, "_b": F.when(F.col("side") == "buy", F.col("volume")).otherwise(0.0)})
    out = {"cvd": F.sum("_s").over(t.cum)}
    for n in windows:
        w = t.rows(n)
        out |= {f"cvd_{n}": F.sum("_s").over(w), f"trade_size_{n}": F.avg("volume").over(w), f"buy_share_{n}": F.try_divide(F.sum("_b").over(w), F.sum("volume").over(w))}
        seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.min("ts").over(w).cast("timestamp"))) / 1e6
        out[f"trade_rate_{n}"] = F.try_divide(F.count("*").over(w) - 1, seconds)
    return x.withColumns(out).drop("_s", "_b")


def anchored_vwap(bars: DataFrame, anchor: str) -> Column:
    """Volume-weighted typical price since the start of the day, week or month (or any truncation)."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    w = Window.partitionBy("symbol", F.date_trunc(anchor, "ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return F.try_divide(F.sum(tp * F.col("volume")).over(w), F.sum("volume").over(w))


def vwap_bands(bars: DataFrame, anchor: str, widths: tuple[float, ...] = (1.0, 2.0)) -> dict[str, Column]:
    """The anchored mean and bands of so many volume-weighted deviations of the typical price around it."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    w = Window.partitionBy("symbol", F.date_trunc(anchor, "ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    v = F.sum("volume").over(w)
    mean = F.try_divide(F.sum(tp * F.col("volume")).over(w), v)
    dev = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.sum(tp * tp * F.col("volume")).over(w), v) - mean * mean))
    return {"vwap": mean} | {f"vwap_{side}_{k:g}": mean + sign * k * dev for k in widths for side, sign in (("upper", 1), ("lower", -1))}


def support_resistance(bars: DataFrame, n: int = 20) -> DataFrame:
    """The extremes of the n bars before, and whether a bar makes a higher high or a lower low than the bar before it."""
    return bars.withColumns({
        "resistance": F.max("high").over(R.prior(n)), "support": F.min("low").over(R.prior(n)),
        "higher_high": F.coalesce((F.col("high") > R.lag("high")).cast("int"), F.lit(0)), "lower_low": F.coalesce((F.col("low") < R.lag("low")).cast("int"), F.lit(0)),
    })


def regimes(bars: DataFrame, columns: list[str], lookback: int = 100, share: float = 0.75) -> dict[str, Column]:
    """1 where a column exceeds its own percentile of the last rows."""
    return {f"{c}_regime": F.coalesce((F.col(c) > F.expr(f"percentile({c}, {share})").over(R.rows(lookback))).cast("int"), F.lit(0)) for c in columns}


def pivots(daily: DataFrame) -> DataFrame:
    """Standard, Fibonacci and Camarilla levels from the bar before."""
    h, low, c = R.lag("high"), R.lag("low"), R.lag("close")
    p, span = (h + low + c) / 3, h - low
    return daily.withColumns({
        "pivot": p, "r1": 2 * p - low, "s1": 2 * p - h, "r2": p + span, "s2": p - span, "fib_r1": p + 0.382 * span, "fib_s1": p - 0.382 * span, "fib_r2": p + 0.618 * span, "fib_s2": p - 0.618 * span,
        "cam_r3": c + span * 1.1 / 4, "cam_s3": c - span * 1.1 / 4, "prev_high": h, "prev_low": low,
    })


def session_features(bars: DataFrame) -> DataFrame:
    h, d = F.hour("ts"), F.dayofweek("ts")
    cycle = lambda x, n: (F.sin(2 * F.pi() * x / n), F.cos(2 * F.pi() * x / n))
    (hs, hc), (ds, dc) = cycle(h, 24), cycle(d, 7)
    return bars.withColumns({"session": market_session(F.col("ts")), "hour_sin": hs, "hour_cos": hc, "day_sin": ds, "day_cos": dc, "weekend": d.isin(1, 7).cast("int")})


def forward_label(bars: DataFrame, horizon: int = 5, move: float = 0.15) -> DataFrame:
    """1 if the close `horizon` bars ahead is at least `move` higher, -1 if lower, else 0; null at the end."""
    d = F.lead("close", horizon).over(R.w) - F.col("close")
    return bars.withColumns({"forward_return": F.try_divide(d, F.col("close")), "label": F.when(d >= move, 1).when(d <= -move, -1).when(d.isNotNull(), 0)})


def triple_barrier(bars: DataFrame, up: float, down: float, horizon: int) -> DataFrame:
    """Which barrier the next `horizon` bars touch first: 1 upper, -1 lower (the lower on a tie within a bar), 0 neither."""
    w = R.w.rowsBetween(1, horizon)
    hs, ls = F.collect_list("high").over(w), F.collect_list("low").over(w)
    x = bars.withColumns({"_h": hs, "_l": ls})
    first = lambda arr, hit: F.array_min(F.transform(F.filter(F.transform(arr, lambda v, i: F.when(hit(v), i)), lambda i: i.isNotNull()), lambda i: i))
    a, b = first("_h", lambda v: v >= F.col("close") + up), first("_l", lambda v: v <= F.col("close") - down)
    label = F.when(b.isNotNull() & (a.isNull() | (b <= a)), -1).when(a.isNotNull(), 1).otherwise(0)
    return x.withColumn("barrier", F.when(F.size("_h") == horizon, label)).withColumn("meta_weight", F.abs(F.lead("close", horizon).over(R.w) - F.col("close"))).drop("_h", "_l")


def simulate_fills(orders: DataFrame, quotes: DataFrame, latency_ms: int = 25, slippage: float = 0.005, probability: float = 0.85) -> DataFrame:
    """orders (ts, order_id, side) against quotes (ts, bid, ask), latency later, symbol by symbol where both sides have one;
    whether one is filled follows from a hash of its id."""
    late = orders.withColumns({"_sent": F.col("ts"), "ts": F.col("ts") + F.expr(f"interval {latency_ms} milliseconds")})
    x = asof(late, quotes, ["bid", "ask"], by=["symbol"] if "symbol" in orders.columns and "symbol" in quotes.columns else None)
    u = F.pmod(F.xxhash64("order_id"), F.lit(1_000_000)) / 1_000_000
    price = F.when(F.col("side") == "buy", F.col("ask") + slippage).otherwise(F.col("bid") - slippage)
    return x.withColumns({"filled": (u < probability) & F.col("bid").isNotNull(), "fill_price": price}).withColumn("fill_price", F.when(F.col("filled"), F.col("fill_price")))


#: Spread multipliers by session.
SPREADS = {"asian": 1.5, "london": 1.0, "overlap": 0.8, "new_york": 1.0, "closed": 2.0}


def costs(trades: DataFrame, spread: float = 0.3, commission: float = 7.0) -> DataFrame:
    """trades (ts, quantity): spread by session, commission per lot, weekend charge threefold."""
    s = market_session(F.col("ts"))
    mult = F.lit(1.0)
    for name, m in SPREADS.items():
        mult = F.when(s == name, m).otherwise(mult)
    return trades.withColumns({"session": s, "spread_cost": spread * mult * F.col("quantity"), "commission": commission * F.col("quantity"), "swap_days": F.when(F.dayofweek("ts") == 6, 3).otherwise(1)})


def kelly(win_rate: Column, win: Column, loss: Column, share: float = 0.25, cap: float = 0.02) -> Column:
    """Quarter Kelly within [0, cap]."""
    b = F.try_divide(win, loss)
    f = win_rate - F.try_divide(1 - win_rate, b)
    return F.coalesce(F.least(F.greatest(f * share, F.lit(0.0)), F.lit(cap)), F.lit(0.0))


def stop_and_target(atr_pips: Column) -> tuple[Column, Column]:
    """Stop of one and target of one and a half average ranges, each within its limits in pips."""
    bound = lambda x, lo, hi: F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))
    return bound(atr_pips, 5, 20), bound(atr_pips * 1.5, 10, 30)


#: The share of the usual size that may be traded near news, by impact.
NEWS_SIZE = {"high": 0.0, "medium": 0.5, "low": 1.0}


def news_size(rows: DataFrame, news: DataFrame, before: str = "5 minutes", after: str = "5 minutes") -> DataFrame:
    """rows with size_factor: the least share that any news nearby leaves, 1 without news."""
    kept = rows.withColumn("size_factor", F.lit(1.0))
    for impact, factor in sorted(NEWS_SIZE.items(), key=lambda x: -x[1]):
        events = news.filter(F.col("impact") == impact)
        near = within_events(kept, events, before, after).withColumn("size_factor", F.lit(factor))
        kept = near.unionByName(within_events(kept, events, before, after, inside=False))
    return kept


def stress(positions: DataFrame, shocks: dict[str, float]) -> DataFrame:
    """positions (symbol, quantity, price) -> (scenario, pnl): every price moved by a scenario's share, in one aggregation."""
    pnl = positions.agg(F.sum(F.col("quantity") * F.col("price")).alias("_value"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(x)).alias("shock")) for n, x in shocks.items()]))
    return pnl.select("_value", each.alias("s")).select("s.scenario", (F.col("_value") * F.col("s.shock")).alias("pnl"))


def buy_and_hold(bars: DataFrame) -> DataFrame:
    """(symbol, ret): last close over first close, less one."""
    return bars.groupBy("symbol").agg((F.max_by("close", "ts") / F.min_by("close", "ts") - 1).alias("ret"))


def circuit_breakers(log: DataFrame, balance: float, order: list[str], levels: tuple[float, ...] = (0.03, 0.04, 0.05)) -> DataFrame:
    """Daily drawdown as a share of the balance and the number of levels it has passed so far that day."""
    w = Window.partitionBy(F.to_date("ts")).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = log.withColumn("_cum", F.sum("pnl").over(w)).withColumn("drawdown", (F.greatest(F.max("_cum").over(w), F.lit(0.0)) - F.col("_cum")) / balance)
    worst = F.max("drawdown").over(w)
    return x.withColumn("breaker", sum(((worst >= lv).cast("int") for lv in levels), F.lit(0))).withColumn("trades_today", F.count("*").over(w)).drop("_cum")


def moving_average_cross(bars: DataFrame, fast: int = 5, slow: int = 13) -> DataFrame:
    """Benchmark: long while the fast simple mean is above the slow one; return of the next bar."""
    x = bars.withColumns({"_f": R.mean("close", fast), "_s": R.mean("close", slow), "_next": F.lead("close").over(R.w)})
    long = F.coalesce((F.col("_f") > F.col("_s")).cast("int"), F.lit(0))
    return x.withColumns({"position": long, "ret": long * F.coalesce(F.try_divide("_next", "close") - 1, F.lit(0.0))}).drop("_f", "_s", "_next")


def psi(expected: DataFrame, actual: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Population stability index between two histograms over fixed edges."""
    def hist(df: DataFrame, name: str) -> DataFrame:
        bin_ = sum(((F.col(column) >= e).cast("int") for e in edges), F.lit(0))
        h = df.filter(F.col(column).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count("*").alias("c"))
        return h.withColumn(name, F.col("c") / F.sum("c").over(Window.partitionBy())).select("bin", name)

    x = hist(expected, "e").join(hist(actual, "a"), "bin", "full_outer").na.fill(0.0)
    e, a = F.greatest("e", F.lit(1e-6)), F.greatest("a", F.lit(1e-6))
    return x.agg(F.sum((a - e) * F.ln(a / e)).alias("psi"))


def bootstrap(returns: DataFrame, draws: int = 1000, seed: int = 7) -> DataFrame:
    """Poisson bootstrap of the mean return: every row gets a weight in each draw, from its id and the draw's number. A task
    adds up its rows' weights and returns a row for each draw; rows are never multiplied by draws."""
    cdf = np.array([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183])

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros(draws), np.zeros(draws)
        numbers = np.arange(draws, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        for f in frames:
            for at in range(0, len(f), 1024):
                h = f["h"].to_numpy()[at : at + 1024].view(np.uint64)[:, None] ^ numbers[None, :]
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
                weight = np.searchsorted(cdf, (h >> np.uint64(11)).astype(float) / (1 << 53), "right")
                total += f["ret"].to_numpy()[at : at + 1024] @ weight
                count += weight.sum(0)
        yield pd.DataFrame({"draw": np.arange(draws), "total": total, "count": count})

    rows = returns.select(F.xxhash64("id").alias("h"), F.col("ret").cast("double").alias("ret")).filter("ret is not null")
    parts = rows.mapInPandas(weigh, "draw long, total double, count double")
    return parts.groupBy("draw").agg(F.try_divide(F.sum("total"), F.sum("count")).alias("mean"))
