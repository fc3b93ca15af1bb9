"""Expressions over nested order books: arrays of (price, size) structs, best level first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIDS, ASKS = "bids", "asks"


def level(side: Column | str, i: int, field: str) -> Column:
    """Field of level i from 1; null where the book is shorter."""
    return F.get(side, F.lit(i - 1))[field]


def _both() -> Column:
    return (F.size(BIDS) > 0) & (F.size(ASKS) > 0)


def spread() -> Column:
    return F.when(_both(), level(ASKS, 1, "price") - level(BIDS, 1, "price")).otherwise(0.0)


def mid() -> Column:
    return F.when(_both(), (level(BIDS, 1, "price") + level(ASKS, 1, "price")) / 2).otherwise(0.0)


def _sum(terms: list[Column]) -> Column:
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out


def total(side: Column | str, k: int, f=lambda x: x["size"]) -> Column:
    """Levels are added up one by one, not by a fold over the array: such sums stay in generated code."""
    return _sum([F.when(F.size(side) >= i, f(F.get(side, F.lit(i - 1)))).otherwise(0.0) for i in range(1, k + 1)])


def imbalance(k: int, need_depth: bool = True) -> Column:
    """(bids - asks) / (bids + asks) over k levels; 0 if that is 0 / 0 or, with need_depth, a side has fewer levels."""
    b, a = total(BIDS, k), total(ASKS, k)
    q = F.coalesce(F.try_divide(b - a, b + a), F.lit(0.0))
    return F.when((F.size(BIDS) >= k) & (F.size(ASKS) >= k), q).otherwise(0.0) if need_depth else q


def _fold(k: int, f) -> Column:
    """Sum over the levels of which both prices stand and both sizes are positive; f of (bid, ask)."""
    terms = []
    for i in range(k):
        b, a = F.get(BIDS, F.lit(i)), F.get(ASKS, F.lit(i))
        valid = b["price"].isNotNull() & a["price"].isNotNull() & (b["size"] > 0) & (a["size"] > 0)
        terms.append(F.when(valid, f(b, a)).otherwise(0.0))
    return _sum(terms)


def microprice(k: int) -> Column:
    """Volume-weighted prices of both sides, each weighted by the other side's volume; null without a valid level."""
    b, a = _fold(k, lambda b, a: b["size"]), _fold(k, lambda b, a: a["size"])
    avg_b, avg_a = F.try_divide(_fold(k, lambda b, a: b["size"] * b["price"]), b), F.try_divide(_fold(k, lambda b, a: a["size"] * a["price"]), a)
    return F.try_divide(b * avg_a + a * avg_b, a + b)


def weighted_mid(k: int) -> Column:
    size = lambda b, a: a["size"] + b["size"]
    return F.try_divide(_fold(k, lambda b, a: (a["price"] + b["price"]) / 2 * size(b, a)), _fold(k, size))


def vwap(side: Column | str, k: int) -> Column:
    return F.try_divide(total(side, k, lambda x: x["price"] * x["size"]), total(side, k))


def slope(side: Column | str, k: int, least: int = 2) -> Column:
    """Least-squares slope of size on price over the first k levels; 0 with fewer than `least` or with one price."""
    levels = [F.get(side, F.lit(i)) for i in range(k)]
    valid = [F.coalesce(x["price"].isNotNull() & (x["size"] > 0), F.lit(False)) for x in levels]
    n = _sum([F.when(v, 1.0).otherwise(0.0) for v in valid])
    # prices are taken relative to the first one, which keeps the sums of squares exact enough
    p0 = F.coalesce(*[x["price"] for x in levels])
    fold = lambda f: _sum([F.when(v, f(x["price"] - p0, x["size"])).otherwise(0.0) for v, x in zip(valid, levels, strict=True)])
    sx, sy, sxy, sxx = fold(lambda x, y: x), fold(lambda x, y: y), fold(lambda x, y: x * y), fold(lambda x, y: x * x)
    return F.when(n >= least, F.coalesce(F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx), F.lit(0.0))).otherwise(0.0)


def violations() -> Column:
    """Crossed top, levels out of order and sizes that are not positive, each counted."""
    def steps(side: Column | str, wrong) -> Column:
        pairs = F.zip_with(F.slice(side, 1, F.greatest(F.size(side) - 1, F.lit(0))), F.slice(side, 2, F.greatest(F.size(side), F.lit(1))), lambda x, y: wrong(x["price"], y["price"]))
        return F.size(F.filter(pairs, lambda x: x))

    sizes = lambda side: F.size(F.filter(side, lambda x: x["size"] <= 0))
    top = F.when(_both() & (level(BIDS, 1, "price") >= level(ASKS, 1, "price")), 1).otherwise(0)
    return top + steps(BIDS, lambda x, y: x <= y) + steps(ASKS, lambda x, y: x >= y) + sizes(BIDS) + sizes(ASKS)


def flatten(levels: int = 5) -> list[Column]:
    """bid_price_1.. ask_size_5; levels that a book lacks are null."""
    return [level(side, i, f).alias(f"{name}_{f}_{i}") for name, side in (("bid", BIDS), ("ask", ASKS)) for f in ("price", "size") for i in range(1, levels + 1)]


def row_features(k: int = 5) -> dict[str, Column]:
    """Per-row features of one snapshot."""
    b1, a1, m = level(BIDS, 1, "price"), level(ASKS, 1, "price"), mid()
    out = {"best_bid": F.coalesce(b1, F.lit(0.0)), "best_ask": F.coalesce(a1, F.lit(0.0)), "spread": spread(), "mid": m, "spread_pct": F.try_divide(spread(), m) * 100}
    for i in (1, 3, 5):
        out[f"imbalance_{i}"] = imbalance(i)
        out[f"microprice_{i}"] = microprice(i)
        out[f"microprice_vs_mid_{i}"] = F.try_divide(microprice(i) - m, m) * 10000
        out[f"weighted_mid_{i}"] = weighted_mid(i)
        out[f"bid_depth_{i}"], out[f"ask_depth_{i}"] = total(BIDS, i), total(ASKS, i)
        out[f"volume_ratio_{i}"] = F.try_divide(total(BIDS, i), total(BIDS, i) + total(ASKS, i))
        out[f"effective_spread_{i}"] = F.try_divide(level(ASKS, i, "price") - level(BIDS, i, "price"), (level(ASKS, i, "price") + level(BIDS, i, "price")) / 2)
    out["bid_vwap"], out["ask_vwap"] = vwap(BIDS, k), vwap(ASKS, k)
    out["bid_slope"], out["ask_slope"] = slope(BIDS, k), slope(ASKS, k)
    out["impact_bid"] = F.try_divide(b1 - level(BIDS, 5, "price"), b1)
    out["impact_ask"] = F.try_divide(level(ASKS, 5, "price") - a1, a1)
    return out
