"""Running sums and exact quantiles of a whole table, and values carried along time, without one task for all rows.

Rows are dealt by value ranges; a range starts from the totals of those before it, of which there are as many as ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds of a unit of time.
MICROS = {"millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def number(df: DataFrame, column: str) -> Column:
    """A column of numbers, dates or times as a number in the same order."""
    kind = df.schema[column].dataType.simpleString()
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.unix_date(column) if kind == "date" else F.col(column)


def ranged(df: DataFrame, column: str, n: int = 64) -> DataFrame:
    """df with _range, the number of one of n value ranges of about equal rows; nulls are in the first."""
    x = number(df, column)
    edges = sorted(set(df.agg(F.percentile_approx(x, [k / n for k in range(1, n)], 10 * n).alias("e")).first()["e"] or []))
    at = F.size(F.filter(F.lit(edges), lambda e: e < x)) if edges else F.lit(0)
    return df.withColumn("_range", F.when(x.isNull(), 0).otherwise(at))


def _same(by: list[str], other: DataFrame, x: DataFrame) -> Column:
    hit = x["_range"] == other["_range_of"]
    for c in by:
        hit &= x[c].eqNullSafe(other[f"_by_{c}"])
    return hit


def running(df: DataFrame, order: list[str], sums: dict[str, str] | None = None, greatest: dict[str, str] | None = None, by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """df with running sums {new: column} and running maxima {new: column} up to each row, in `order` within `by`. The
    first column of order decides on the ranges; rows that share it stay together."""
    sums, greatest, by = sums or {}, greatest or {}, by or []
    x = ranged(df, order[0])
    turn = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    w = Window.partitionBy(*by, "_range").orderBy(*[turn(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*[f"_by_{c}" for c in by]).orderBy(turn("_range_of")).rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_range_of")).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_t_{n}") for n, c in greatest.items()])
    first = [F.sum(f"_t_{n}").over(before).alias(f"_t_{n}") for n in sums] + [F.max(f"_t_{n}").over(before).alias(f"_t_{n}") for n in greatest]
    totals = totals.select(*[f"_by_{c}" for c in by], "_range_of", *first)
    out = x.join(totals, _same(by, totals, x), "left")
    out = out.withColumns({n: F.coalesce(F.col(f"_t_{n}"), F.lit(0)) + F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()} | {n: F.greatest(f"_t_{n}", F.max(c).over(w)) for n, c in greatest.items()})
    return out.select(*df.columns, *sums, *greatest)


def quantiles(df: DataFrame, column: str, shares: list[float], by: list[str] | None = None, name: str = "quantiles") -> DataFrame:
    """(by, name): exact quantiles, interpolated linearly, as an array in the order of shares; from counts of distinct
    values, so that no task holds a group's values."""
    by = by or []
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    x = running(counts, [column], {"_upto": "_n"}, by=by)
    totals = counts.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.sum("_n").alias("_all"))
    hit = F.lit(True)
    for c in by:
        hit &= x[c].eqNullSafe(totals[f"_by_{c}"])
    x = x.join(F.broadcast(totals) if not by else totals, hit)
    value = lambda at: F.max(F.when((F.col("_upto") - F.col("_n") <= at) & (at < F.col("_upto")), F.col(column).cast("double")))
    out = []
    for s in shares:
        at = (F.col("_all") - 1) * s
        low, high, share = value(F.floor(at)), value(F.ceil(at)), F.max(at - F.floor(at))
        out.append(low * (1 - share) + high * share)
    return x.groupBy(*by).agg(F.array(*out).alias(name))


def micros(length: str) -> int:
    count, unit = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", length.lower()).groups()
    return int(count) * MICROS[unit]


def bucketed(df: DataFrame, ts: str, bucket: str) -> Column:
    """The number of the time bucket; a numeric ts counts microseconds."""
    return F.floor(number(df, ts) / micros(bucket))


def carry(df: DataFrame, columns: list[str], ts: str = "ts", by: list[str] | None = None, first: list[Column] | None = None, back: bool = False, bucket: str = "1 day") -> DataFrame:
    """df with each column's nulls filled by the last value before (back: by the next one after), in the order of ts, then
    of `first`, within `by`. Time buckets are filled apart from each other and start from the last values of those before."""
    by, first = by or [], first or []
    x = df.withColumn("_range", bucketed(df, ts, bucket))
    turn = (lambda c: F.desc(c)) if back else (lambda c: F.asc(c))
    w = Window.partitionBy(*by, "_range").orderBy(turn(ts), *first).rowsBetween(Window.unboundedPreceding, 0)
    newest = F.min_by if back else F.max_by
    ends = x.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_range_of")).agg(*[newest(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_t_{c}") for c in columns])
    before = Window.partitionBy(*[f"_by_{c}" for c in by]).orderBy(turn("_range_of")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[f"_by_{c}" for c in by], "_range_of", *[F.last(f"_t_{c}", True).over(before).alias(f"_t_{c}") for c in columns])
    out = x.join(ends, _same(by, ends, x), "left").withColumns({c: F.coalesce(F.last(c, True).over(w), F.col(f"_t_{c}")) for c in columns})
    return out.select(*df.columns)
