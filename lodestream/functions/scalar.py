"""Scalar expressions on prices, sessions and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(n: Column, d: Column, default: float = 0.0) -> Column:
    """n / d; the default where that is null, NaN or infinite."""
    q = F.try_divide(n, d)
    return F.when(q.isNull() | F.isnan(q) | (F.abs(q) == float("inf")), F.lit(default)).otherwise(q)


def pip_size(symbol: Column) -> Column:
    return F.when(F.upper(symbol) == "XAUUSD", 0.01).otherwise(0.0001)


def pips_to_price(pips: Column, symbol: Column) -> Column:
    return pips * pip_size(symbol)


def price_to_pips(price: Column, symbol: Column) -> Column:
    return price / pip_size(symbol)


def market_session(ts: Column) -> Column:
    """Trading session of an instant in UTC; the first that fits."""
    h = F.hour(ts)
    return F.when((h >= 8) & (h < 17), F.when(h >= 13, "overlap").otherwise("london")).when((h >= 13) & (h < 22), "new_york").when((h >= 23) | (h < 8), "asian").otherwise("closed")


def position_size(balance: Column, risk: Column, stop_pips: Column, symbol: Column) -> Column:
    """Lots so that the stop loses balance * risk; half-even to two places."""
    pip_value = F.when(F.upper(symbol) == "XAUUSD", 100.0).otherwise(10.0)
    return F.bround(safe_divide(balance * risk, stop_pips * pip_value), 2)


#: The share of relevance by words in a feature's name, first match first.
RELEVANCE = [("obi|imbalance|microprice|depth", 1.0), ("volume|vpvr|cvd", 0.9), ("hma|gkyz|atr", 0.8), ("ema|sma|vwap", 0.6), ("rsi|macd|stoch", 0.4)]


def business_relevance(name: Column) -> Column:
    out = F.lit(0.5)
    for words, share in reversed(RELEVANCE):
        out = F.when(F.lower(name).rlike(words), share).otherwise(out)
    return out


def content_hash(df_columns: list[str]) -> Column:
    """Sixteen hex characters of a row's SHA-256."""
    return F.substring(F.sha2(F.to_json(F.struct(*df_columns)), 256), 1, 16)
