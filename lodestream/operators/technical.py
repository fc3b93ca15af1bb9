"""Technical indicators that need no recurrence: projections and rolling windows over one symbol's bars.

Stages exist because a window cannot be taken over a window: each stage is one projection, and all stages share
one partitioning and order, so the whole catalogue costs one shuffle and one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import Rolling

R = Rolling()


def _ohlcv() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in ("open", "high", "low", "close", "volume"))


def _base() -> dict[str, Column]:
    O, H, L, C, V = _ohlcv()  # noqa: E741
    tp = (H + L + C) / 3
    c1 = R.lag("close")
    ln = lambda a, b: F.ln(F.try_divide(a, b))
    ho, lo, co = ln(H, O), ln(L, O), ln(C, O)
    positive = (O > 0) & (H > 0) & (L > 0) & (C > 0) & (c1 > 0)
    gk = ho * (ho - co) + lo * (lo - co) - ho * lo + 0.5 * F.pow(ln(C, c1), 2)
    tp1 = R.lag((H + L + C) / 3)
    r = F.try_divide(C - c1, c1)
    down = V < R.lag("volume")
    grow = F.when((r > -1) & r.isNotNull(), F.ln(1 + r)).otherwise(0.0)
    return {
        "_n": R.n, "_c1": c1, "_tp": tp, "_tr": F.coalesce(F.greatest(H - L, F.abs(H - c1), F.abs(L - c1)), H - L),
        "_gk": F.when(positive, gk), "_pk": 0.25 * F.pow(ln(H, L), 2), "_rs": ho * ln(H, C) + lo * ln(L, C), "_lr2": F.coalesce(F.pow(ln(C, c1), 2), F.lit(0.0)),
        "_up": F.when(tp > tp1, tp * V).otherwise(0.0), "_dn": F.when(tp < tp1, tp * V).otherwise(0.0), "_adt": F.coalesce(F.try_divide((C - L) - (H - C), H - L) * V, F.lit(0.0)),
        "_eom": F.try_divide((H + L) / 2 - R.lag((H + L) / 2), F.try_divide(V, H - L)), "_obv": F.coalesce(F.signum(C - c1) * V, V), "_pvt": F.coalesce(V * r, F.lit(0.0)),
        "_nvi": F.when(down, grow).otherwise(0.0), "_pvi": F.when(down, 0.0).otherwise(grow),
        "_bp": C - F.least(L, c1), "_tr1": F.greatest(H, c1) - F.least(L, c1), "_volchg": V,
    }


def _linreg(p: int) -> Column:
    """Endpoint of the least-squares line through p closes: a fixed weighting of lags."""
    C = F.col("close")
    mean = (p - 1) / 2
    sxx = sum((i - mean) ** 2 for i in range(p))
    return sum(((R.lag("close", p - 1 - i) if i < p - 1 else C) * (1 / p + (i - mean) * (p - 1 - mean) / sxx) for i in range(p)), F.lit(0.0))


def _gkyz(p: int) -> Column:
    m = F.avg("_gk").over(R.rows(p))
    return F.when((F.col("_n") > p) & (m >= 0), F.sqrt(252 * m))


def _williams(p: int) -> Column:
    C = F.col("close")
    hh, ll = R.max("high", p), R.min("low", p)
    return F.when(hh.isNotNull(), F.coalesce(F.try_divide(hh - C, hh - ll) * -100, F.lit(-50.0)))


def _cci(p: int) -> Column:
    m = F.avg("_tp").over(R.rows(p))
    mad = F.aggregate(F.collect_list("_tp").over(R.rows(p)), F.lit(0.0), lambda a, x: a + F.abs(x - m)) / p
    return F.when(F.col("_n") >= p, F.coalesce(F.try_divide(F.col("_tp") - m, 0.015 * mad), F.lit(0.0)))


def _fast_k(p: int) -> Column:
    C = F.col("close")
    hh, ll = R.max("high", p), R.min("low", p)
    return F.when(hh.isNotNull(), F.coalesce(F.try_divide(C - ll, hh - ll) * 100, F.lit(0.0)))


def _rolling() -> dict[str, Column]:
    O, H, L, C, V = _ohlcv()  # noqa: E741
    out: dict[str, Column] = {f"sma_{p}": R.mean("close", p) for p in (5, 10, 20, 50)}
    for p in (5, 10, 20):
        out[f"_raw_{p}"] = 2 * R.weighted("close", p // 2) - R.weighted("close", p)
    for p in (10, 20):
        out |= {f"linreg_{p}": F.when(F.col("_n") >= p, _linreg(p)), f"midpoint_{p}": (R.max("close", p) + R.min("close", p)) / 2, f"roc_{p}": F.coalesce(R.pct("close", p) * 100, F.when(F.col("_n") > p, 0.0)), f"rocp_{p}": F.coalesce(R.pct("close", p), F.when(F.col("_n") > p, 0.0)), f"rocr_{p}": F.coalesce(R.pct("close", p) + 1, F.when(F.col("_n") > p, 0.0)), f"mom_{p}": R.diff("close", p)}
    out |= {f"gkyz_{p}": _gkyz(p) for p in (20, 60)}
    out |= {f"parkinson_{p}": R.mean("_pk", p) * math.sqrt(252) for p in (20, 60)}
    out |= {f"realized_{p}": R.sum("_lr2", p) * math.sqrt(252) for p in (20, 60)}
    out |= {f"parkinson_std_{p}": F.sqrt(R.mean("_pk", p) * 4 / (4 * math.log(2)) * 252) for p in (20, 60)}
    out |= {f"rogers_satchell_{p}": R.mean("_rs", p) * math.sqrt(252) for p in (20, 60)}
    out |= {f"williams_{p}": _williams(p) for p in (14, 21)}
    out |= {f"cci_{p}": _cci(p) for p in (14, 20)}
    out |= {f"volume_ratio_{p}": F.try_divide(V, R.mean("volume", p)) for p in (5, 20)}
    dev = R.std("close", 20, population=True)
    mid = R.mean("close", 20)
    out |= {"bb_upper": mid + 2 * dev, "bb_lower": mid - 2 * dev, "bb_percent": F.try_divide(C - (mid - 2 * dev), 4 * dev), "bb_width": F.try_divide(4 * dev, mid)}
    out |= {"donchian_high": R.max("high", 20), "donchian_low": R.min("low", 20), "donchian_mid": (R.max("high", 20) + R.min("low", 20)) / 2, "midprice_14": (R.max("high", 14) + R.min("low", 14)) / 2}
    vwap = F.try_divide(F.sum(F.col("_tp") * V).over(R.cum), F.sum(V).over(R.cum))
    out |= {"vwap": vwap, "vwap_distance": F.try_divide(C - vwap, vwap) * 100}
    up, dn = F.sum("_up").over(R.rows(14)), F.sum("_dn").over(R.rows(14))
    out |= {"mfi_14": F.when(F.col("_n") > 14, F.coalesce(F.try_divide(100 * up, up + dn), F.lit(0.0)))}
    out |= {"ad_line": F.sum("_adt").over(R.cum), "obv": F.sum("_obv").over(R.cum), "pvt": F.sum("_pvt").over(R.cum), "nvi": 1000 * F.exp(F.sum("_nvi").over(R.cum)), "pvi": 1000 * F.exp(F.sum("_pvi").over(R.cum))}
    w15 = R.rows(15)
    since = lambda pos: F.when(F.col("_n") >= 15, 100 * (14 - (F.col("_n") - pos)) / 14)
    high_at, low_at = F.max_by("_n", F.struct("high", "_n")).over(w15), F.min_by("_n", F.struct(L, -F.col("_n"))).over(w15)
    out |= {"aroon_up": since(high_at), "aroon_down": since(low_at), "aroon_osc": since(high_at) - since(low_at)}
    ratio = lambda p: F.try_divide(F.sum("_bp").over(R.rows(p)), F.sum("_tr1").over(R.rows(p)))
    out |= {"ultosc": F.when(F.col("_n") > 28, 100 * (4 * ratio(7) + 2 * ratio(14) + ratio(28)) / 7)}
    out |= {"bop": F.coalesce(F.try_divide(C - O, H - L), F.lit(0.0)), "wclprice": (H + L + 2 * C) / 4, "avgprice": (O + H + L + C) / 4, "medprice": (H + L) / 2, "typprice": F.col("_tp"), "trange": F.when(F.col("_n") > 1, F.col("_tr")), "high_low_ratio": F.try_divide(H, L)}
    out |= {"_fast5": _fast_k(5), "macdext": R.mean("close", 12) - R.mean("close", 26), "eom": F.col("_eom")}
    return out


def _second() -> dict[str, Column]:
    out = {f"hma_{p}": R.weighted(f"_raw_{p}", math.isqrt(p)) for p in (5, 10, 20)}
    return out | {"stochf_k": F.col("_fast5"), "stochf_d": R.mean("_fast5", 3), "stoch_k": R.mean("_fast5", 3), "eom_14": R.mean("eom", 14), "macdext_signal": R.mean("macdext", 9)}


def _third() -> dict[str, Column]:
    squeeze = F.when(R.min("bb_width", 120).isNotNull(), (F.col("bb_width") <= R.min("bb_width", 120)).cast("int"))
    return {"bb_squeeze": squeeze, "stoch_d": R.mean("stoch_k", 3), "macdext_hist": F.col("macdext") - F.col("macdext_signal"), "chaikin_ad_line": F.col("ad_line")}


def technical(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    """bars (symbol, ts, open, high, low, close, volume) -> symbol, ts and the named indicators, or all of them. Columns
    that no named indicator needs are pruned by the optimizer."""
    x = bars
    for stage in (_base(), _rolling(), _second(), _third()):
        x = x.withColumns(stage)
    return x.select("symbol", "ts", *(names or indicator_names()))


def indicator_names() -> list[str]:
    return [n for stage in (_rolling(), _second(), _third()) for n in stage if n[0] != "_"]
