"""Features of one price against others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import Rolling
from .align import asof
from .ordered import carry

ASSETS = ["DXY", "TIPS", "SPY"]
R = Rolling(by=("symbol",))


def aligned(base: DataFrame, assets: DataFrame, names: list[str] = ASSETS) -> DataFrame:
    """base bars (symbol, ts, close) with the latest close of each asset at or before each bar."""
    wide = assets.groupBy("ts").pivot("asset", names).agg(F.max("close")).select("ts", *names)
    return asof(base.select("symbol", "ts", "close"), carry(wide, names), names)


def features(x: DataFrame, names: list[str] = ASSETS, windows: tuple[int, ...] = (20, 60, 240)) -> DataFrame:
    """x: aligned bars. Correlation of prices and of returns, beta, regime, ratio, spread, divergence and market regimes."""
    x = x.withColumn("_r", R.pct("close"))
    x = x.withColumns({f"_r_{n}": R.pct(n) for n in names} | {f"{n}_ratio": F.try_divide(F.col("close"), F.col(n)) for n in names})
    out = {}
    for n in names:
        for w in windows:
            out[f"{n}_corr_{w}"] = R.corr("close", n, w)
            out[f"{n}_return_corr_{w}"] = R.corr("_r", f"_r_{n}", w)
            out[f"{n}_beta_{w}"] = F.try_divide(R.cov("_r", f"_r_{n}", w), R.full(F.var_samp(f"_r_{n}"), f"_r_{n}", w))
        for w in (20, 60):
            out[f"{n}_ratio_z_{w}"] = R.zscore(f"{n}_ratio", w)
        out[f"{n}_ratio_momentum"] = R.diff(f"{n}_ratio", 5)
        out[f"{n}_ratio_change"] = R.pct(f"{n}_ratio")
        for k in (5, 20):
            g, a = R.pct("close", k), R.pct(n, k)
            out[f"{n}_divergence_{k}"] = F.when((g > 0) & (a < 0), 1).when((g < 0) & (a > 0), -1).otherwise(0)
        out[f"{n}_rate_differential"] = R.pct("close") - R.pct(n)
        out[f"{n}_relative_strength"] = F.try_divide(R.pct("close", 20), R.pct(n, 20))
    g20 = R.pct("close", 20)
    out["risk_on_off"] = F.when(R.pct("SPY", 20) > g20, 1).otherwise(-1) if "SPY" in names else F.lit(0)
    out["dollar_regime"] = F.when(R.pct("DXY", 20) > 0, 1).otherwise(-1) if "DXY" in names else F.lit(0)
    out["inflation_regime"] = F.when(R.pct("TIPS", 20) > 0, 1).otherwise(-1) if "TIPS" in names else F.lit(0)
    x = x.withColumns(out)
    regime = {f"{n}_corr_regime_{w}": F.coalesce((F.col(f"{n}_corr_{w}") > R.mean(f"{n}_corr_{w}", 2 * w)).cast("int"), F.lit(0)) for n in names for w in windows}
    return x.withColumns(regime).drop("_r", *[f"_r_{n}" for n in names])
