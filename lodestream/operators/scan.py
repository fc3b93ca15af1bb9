"""Indicators that are recurrences over a symbol's bars, as Arrow-batched functions.

A long series is cut into chunks that overlap: a chunk starts `overlap` rows early from its own seed, and the
recurrences here forget a seed geometrically, so that after the overlap the values are those of one pass to
within rounding. A task then holds chunk + overlap rows, whatever a symbol's length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ewm(x: pd.Series, alpha: float) -> pd.Series:
    """y = alpha x + (1 - alpha) y, from the first value on."""
    return x.ewm(alpha=alpha, adjust=False, ignore_na=True).mean().where(x.notna().cummax())


def seeded(x: pd.Series, p: int, alpha: float, skip: int = 0) -> pd.Series:
    """The recurrence seeded with the mean of the first p values after the leading nulls and `skip` more."""
    first = (int(np.argmax(x.notna().to_numpy())) if x.notna().any() else len(x)) + skip
    out = pd.Series(np.nan, index=x.index)
    if first + p <= len(x):
        y = x.iloc[first + p - 1 :].copy()
        y.iloc[0] = x.iloc[first : first + p].mean()
        out.iloc[first + p - 1 :] = y.ewm(alpha=alpha, adjust=False).mean()
    return out


def ema(x: pd.Series, p: int) -> pd.Series:
    return seeded(x, p, 2 / (p + 1))


def wilder(x: pd.Series, p: int, skip: int = 0) -> pd.Series:
    return seeded(x, p, 1 / p, skip)


def true_range(f: pd.DataFrame) -> pd.Series:
    c1 = f["close"].shift()
    return pd.concat([f["high"] - f["low"], (f["high"] - c1).abs(), (f["low"] - c1).abs()], axis=1).max(axis=1)


def rsi(c: pd.Series, p: int) -> pd.Series:
    d = c.diff()
    up, down = wilder(d.clip(lower=0), p), wilder((-d).clip(lower=0), p)
    return (100 - 100 / (1 + up / down.where(down != 0))).where(down != 0, 100.0).where(up.notna())


def rsi_variant(c: pd.Series, p: int) -> pd.Series:
    """The seed means are smoothed once more with the last seed change before the first value."""
    d = c.diff()

    def smooth(x: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=x.index)
        if len(x) > p:
            y = x.iloc[p:].copy()
            y.iloc[0] = (x.iloc[1 : p + 1].mean() * (p - 1) + x.iloc[p]) / p
            out.iloc[p:] = y.ewm(alpha=1 / p, adjust=False).mean()
        return out

    up, down = smooth(d.clip(lower=0)), smooth((-d).clip(lower=0))
    return (100 - 100 / (1 + up / down.where(down != 0))).where(down != 0, 100.0).where(up.notna())


def kama(c: np.ndarray, p: int) -> np.ndarray:
    out = np.full(len(c), np.nan)
    if len(c) <= p:
        return out
    step = np.abs(np.diff(c, prepend=c[0]))
    path = np.convolve(step, np.ones(p), "valid")[1:]
    move = np.abs(c[p:] - c[:-p])
    er = np.divide(move, path, out=np.ones_like(move), where=path > 0)
    weight = (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2
    k = c[p - 1]
    for i in range(p, len(c)):
        k += weight[i - p] * (c[i] - k)
        out[i] = k
    return out


def sar(h: np.ndarray, low: np.ndarray, step: float = 0.02, most: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Parabolic stop and the side it stands on (1 below prices, -1 above)."""
    n = len(h)
    out, side = np.full(n, np.nan), np.zeros(n)
    if n < 2:
        return out, side
    long = not (low[0] - low[1] > max(h[1] - h[0], 0))
    stop, far, rate = (low[0], h[1], step) if long else (h[0], low[1], step)
    for i in range(1, n):
        if long:
            if low[i] <= stop:
                long, stop, far, rate = False, max(far, h[i - 1], h[i]), low[i], step
                out[i], side[i] = stop, -1
                stop = max(stop + rate * (far - stop), h[i - 1], h[i])
                continue
            out[i], side[i] = stop, 1
            if h[i] > far:
                far, rate = h[i], min(rate + step, most)
            stop = min(stop + rate * (far - stop), low[i - 1], low[i])
        else:
            if h[i] >= stop:
                long, stop, far, rate = True, min(far, low[i - 1], low[i]), h[i], step
                out[i], side[i] = stop, 1
                stop = min(stop + rate * (far - stop), low[i - 1], low[i])
                continue
            out[i], side[i] = stop, -1
            if low[i] < far:
                far, rate = low[i], min(rate + step, most)
            stop = max(stop + rate * (far - stop), h[i - 1], h[i])
    return out, side


def directional(f: pd.DataFrame, p: int = 14) -> dict[str, pd.Series]:
    up, down = f["high"].diff(), -f["low"].diff()
    plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    tr = true_range(f)
    tr.iloc[:1] = plus.iloc[:1] = minus.iloc[:1] = np.nan

    def sums(x: pd.Series) -> pd.Series:
        """Wilder sums: p - 1 values to start with, then one p-th less and the new value."""
        out = pd.Series(np.nan, index=x.index)
        if len(x) > p:
            y = x.iloc[p - 1 :] * 1.0
            y.iloc[0] = x.iloc[1:p].sum() / p
            out.iloc[p:] = y.ewm(alpha=1 / p, adjust=False).mean().iloc[1:] * p
        return out

    t, a, b = sums(tr), sums(plus), sums(minus)
    pdi, mdi = 100 * a / t.where(t != 0), 100 * b / t.where(t != 0)
    total = pdi + mdi
    dx = (100 * (pdi - mdi).abs() / total.where(total != 0)).where(total != 0, 0.0).where(t.notna())
    adx = wilder(dx, p)
    return {"plus_di": pdi, "minus_di": mdi, "dx": dx, "adx": adx, "adxr": (adx + adx.shift(p - 1)) / 2}


def mama(c: np.ndarray, h: np.ndarray, low: np.ndarray, fast: float = 0.5, slow: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Adaptive averages whose rate follows the change of phase of a discrete Hilbert transform of the median price."""
    n, price = len(c), (h + low) / 2
    out, follow = np.full(n, np.nan), np.full(n, np.nan)
    smooth, detr, i1, q1 = (np.zeros(n) for _ in range(4))
    i2 = q2 = re = im = 0.0
    period, phase, m, f = 6.0, 0.0, price[0] if n else 0.0, price[0] if n else 0.0
    taps = ((0, 0.0962), (2, 0.5769), (4, -0.5769), (6, -0.0962))
    for k in range(6, n):
        smooth[k] = (4 * price[k] + 3 * price[k - 1] + 2 * price[k - 2] + price[k - 3]) / 10
        gain = 0.075 * period + 0.54
        turn = lambda x, k=k, gain=gain: sum(w * x[k - d] for d, w in taps) * gain
        detr[k] = turn(smooth)
        q1[k], i1[k] = turn(detr), detr[k - 3]
        j_i, j_q = turn(i1), turn(q1)
        i2, q2 = 0.2 * (i1[k] - j_q) + 0.8 * i2, 0.2 * (q1[k] + j_i) + 0.8 * q2
        if k == 6:
            i2_1, q2_1 = i2, q2
        re, im = 0.2 * (i2 * i2_1 + q2 * q2_1) + 0.8 * re, 0.2 * (i2 * q2_1 - q2 * i2_1) + 0.8 * im
        i2_1, q2_1 = i2, q2
        raw = 2 * np.pi / np.arctan(im / re) if re and im else period
        raw = min(max(raw, 0.67 * period), 1.5 * period)
        period = 0.2 * min(max(raw, 6), 50) + 0.8 * period
        now = np.degrees(np.arctan(q1[k] / i1[k])) if i1[k] else 0.0
        rate = min(max(fast / max(phase - now, 1.0), slow), fast)
        phase = now
        m = rate * price[k] + (1 - rate) * m
        f = 0.5 * rate * m + (1 - 0.5 * rate) * f
        if k >= 32:
            out[k], follow[k] = m, f
    return out, follow


def hilbert_trend(c: np.ndarray) -> np.ndarray:
    """Trend line: the mean of the last dominant cycle of the price, smoothed by weights 4, 3, 2, 1."""
    n = len(c)
    out, mean = np.full(n, np.nan), np.zeros(n)
    smooth, detr, i1, q1 = (np.zeros(n) for _ in range(4))
    total = np.concatenate([[0.0], np.cumsum(c)])
    i2 = q2 = re = im = i2_1 = q2_1 = smooth_period = 0.0
    period = 6.0
    taps = ((0, 0.0962), (2, 0.5769), (4, -0.5769), (6, -0.0962))
    for k in range(6, n):
        smooth[k] = (4 * c[k] + 3 * c[k - 1] + 2 * c[k - 2] + c[k - 3]) / 10
        gain = 0.075 * period + 0.54
        turn = lambda x, k=k, gain=gain: sum(w * x[k - d] for d, w in taps) * gain
        detr[k] = turn(smooth)
        q1[k], i1[k] = turn(detr), detr[k - 3]
        i2, q2 = 0.2 * (i1[k] - turn(q1)) + 0.8 * i2, 0.2 * (q1[k] + turn(i1)) + 0.8 * q2
        re, im = 0.2 * (i2 * i2_1 + q2 * q2_1) + 0.8 * re, 0.2 * (i2 * q2_1 - q2 * i2_1) + 0.8 * im
        i2_1, q2_1 = i2, q2
        raw = 2 * np.pi / np.arctan(im / re) if re and im else period
        raw = min(max(raw, 0.67 * period), 1.5 * period)
        period = 0.2 * min(max(raw, 6), 50) + 0.8 * period
        smooth_period = 0.33 * period + 0.67 * smooth_period
        span = min(max(int(smooth_period + 0.5), 1), k + 1)
        mean[k] = (total[k + 1] - total[k + 1 - span]) / span
        if k >= 63:
            out[k] = (4 * mean[k] + 3 * mean[k - 1] + 2 * mean[k - 2] + mean[k - 3]) / 10
    return out


def _averages(f: pd.DataFrame) -> dict[str, pd.Series]:
    c = f["close"]
    out = {f"ema_{p}": ema(c, p) for p in (3, 5, 8, 13, 20, 21, 34, 55)}
    out |= {f"ema_first_{p}": ewm(c, 2 / (p + 1)) for p in (5, 13)}
    for p in (8, 21):
        e1 = ema(c, p)
        e2 = ema(e1, p)
        out |= {f"dema_{p}": 2 * e1 - e2, f"tema_{p}": 3 * e1 - 3 * e2 + ema(e2, p)}
    e3 = ema(ema(ema(c, 14), 14), 14)
    return out | {"trix_14": 100 * (e3 / e3.shift() - 1)}


def _ranges(f: pd.DataFrame) -> dict[str, pd.Series]:
    tr, middle, atr20 = true_range(f), ema(f["close"], 20), wilder(true_range(f), 20)
    out = {f"atr_{p}": wilder(tr, p) for p in (7, 14, 20, 21)}
    out |= {"atr_14_ema": ewm(tr, 2 / 15), "natr_14": 100 * wilder(tr, 14, skip=1) / f["close"]}
    return out | {"keltner_upper": middle + 2 * atr20, "keltner_lower": middle - 2 * atr20}


def _strengths(f: pd.DataFrame) -> dict[str, pd.Series]:
    c = f["close"]
    out = {f"rsi_{p}": rsi(c, p) for p in (7, 14, 21)} | {"rsi_variant_14": rsi_variant(c, 14)}
    r14 = out["rsi_14"]
    span = r14.rolling(5).max() - r14.rolling(5).min()
    k = (100 * (r14 - r14.rolling(5).min()) / span.where(span != 0)).where(span != 0, 0.0).where(span.notna())
    out |= {"stochrsi_k": k, "stochrsi_d": k.rolling(3).mean()}
    d = c.diff()
    for p in (14, 21):
        up, down = wilder(d.clip(lower=0), p), wilder((-d).clip(lower=0), p)
        out[f"cmo_{p}"] = 100 * (up - down) / (up + down).where(up + down != 0)
    return out


def _convergence(f: pd.DataFrame) -> dict[str, pd.Series]:
    c = f["close"]
    macd = seeded(c, 12, 2 / 13, skip=14) - ema(c, 26)
    fix = seeded(c, 12, 0.15, skip=14) - seeded(c, 26, 0.075)
    signal, fixed = ema(macd, 9), ema(fix, 9)
    return {"macd": macd.where(signal.notna()), "macd_signal": signal, "macd_hist": macd - signal, "macdfix": fix.where(fixed.notna()), "macdfix_signal": fixed}


def _flows(f: pd.DataFrame) -> dict[str, pd.Series]:
    c, h, low, v = f["close"], f["high"], f["low"], f["volume"]
    flow = ((c - low) - (h - c)) / (h - low).where(h != low)
    ad = (flow.fillna(0) * v).cumsum()
    osc = ewm(ad, 2 / 4) - ewm(ad, 2 / 11)
    return {"adosc": osc.where(np.arange(len(f)) >= 9), "chaikin_osc": ema(ad, 3) - ema(ad, 10), "volume_ema_20": ema(v, 20), "force_13": ema(c.diff() * v, 13)}


def _adaptive(f: pd.DataFrame) -> dict[str, pd.Series]:
    return {f"kama_{p}": pd.Series(kama(f["close"].to_numpy(), p), index=f.index) for p in (10, 20)}


def _stops(f: pd.DataFrame) -> dict[str, pd.Series]:
    stop, side = sar(f["high"].to_numpy(), f["low"].to_numpy())
    return {"sar": pd.Series(stop, index=f.index), "sarext": pd.Series(np.where(side < 0, -stop, stop), index=f.index)}


def _trend(f: pd.DataFrame) -> dict[str, pd.Series]:
    return {"ht_trendline": pd.Series(hilbert_trend(f["close"].to_numpy()), index=f.index)}


def _phases(f: pd.DataFrame) -> dict[str, pd.Series]:
    m, follow = mama(f["close"].to_numpy(), f["high"].to_numpy(), f["low"].to_numpy())
    return {"mama": pd.Series(m, index=f.index), "fama": pd.Series(follow, index=f.index)}


def _variances(f: pd.DataFrame, omega: float = 2e-6, alpha: float = 0.09, beta: float = 0.9, decay: float = 0.94) -> dict[str, pd.Series]:
    """Conditional variance of log returns with fixed coefficients, seeded by the first squared return, and the
    exponentially weighted volatility."""
    r2 = np.log(f["close"] / f["close"].shift()) ** 2
    # h = omega + alpha r2 + beta h is omega / (1 - beta) plus a weighted mean of r2, scaled
    mean = ewm(r2, 1 - beta)
    first = r2.first_valid_index()
    k = pd.Series(np.arange(len(f)), index=f.index) - (list(f.index).index(first) if first is not None else 0)
    start = r2.loc[first] if first is not None else np.nan
    fade = beta ** k.clip(lower=0)
    h = (mean - start * fade) * alpha / (1 - beta) + omega * (1 - fade) / (1 - beta) + start * fade
    return {"garch_variance": h.where(mean.notna()), "ewma_volatility": np.sqrt(ewm(r2, 1 - decay))}


#: Families of recurrences; of each, all are made or none.
FAMILIES = (_averages, _ranges, _strengths, _convergence, _flows, directional, _adaptive, _stops, _trend, _phases, _variances)


def recursive(f: pd.DataFrame, families: tuple = FAMILIES) -> dict[str, pd.Series]:
    """The recurrences of the families on one series of bars in time order."""
    return {name: x for family in families for name, x in family(f).items()}


def names(family=None) -> list[str]:
    x = pd.DataFrame({n: np.arange(1.0, 5.0) for n in ("open", "high", "low", "close", "volume")})
    return list(recursive(x, (family,) if family else FAMILIES))


def recurrences(bars: DataFrame, wanted: list[str] | None = None, chunk: int = 100_000, overlap: int = 8192) -> DataFrame:
    """bars -> symbol, ts and the named recurrences, or all; only their families are computed. chunk is at least overlap."""
    if overlap > chunk:
        raise ValueError("a chunk must be at least as long as its overlap")
    wanted = wanted or names()
    families = tuple(x for x in FAMILIES if set(names(x)) & set(wanted))
    at = F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1
    x = bars.select("symbol", "ts", "open", "high", "low", "close", "volume").withColumn("_at", at)
    # a row also warms up the chunk after its own
    own = F.floor(F.col("_at") / chunk)
    also = F.floor((F.col("_at") + overlap) / chunk)
    x = x.withColumn("_own", own).withColumn("_chunk", F.explode(F.array_distinct(F.array(own, also))))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("ts", ignore_index=True)
        out = recursive(f, families)
        mine = (f["_own"] == f["_chunk"]).to_numpy()
        return pd.DataFrame({"symbol": f["symbol"], "ts": f["ts"], **{n: out[n].astype(float) for n in wanted}})[mine]

    kinds = {n: x.schema[n].dataType.simpleString() for n in ("symbol", "ts")}
    schema = ", ".join([*(f"{n} {k}" for n, k in kinds.items()), *(f"{n} double" for n in wanted)])
    out = x.groupBy("symbol", "_chunk").applyInPandas(run, schema)
    return out.select("symbol", "ts", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in wanted])
