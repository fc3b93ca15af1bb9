"""Joins along time: as-of, aligned, within intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import carry, number


def asof(left: DataFrame, right: DataFrame, values: list[str], by: list[str] | None = None, ts: str = "ts", tolerance: str | None = None, bucket: str = "1 day") -> DataFrame:
    """left with, for each row, the values of right's latest row at or before it; right must be unique in (by, ts).

    Both sides go into one stream, and the last right row is carried forward. The stream is cut into time buckets that
    are scanned apart from each other, each starting from the last right row of those before: neither a symbol nor a
    whole table needs a single task. A numeric ts counts microseconds."""
    by = by or []
    row = F.struct(F.col(ts).alias("_rts"), *[F.col(v) for v in values])
    l = left.select(F.struct(*left.columns).alias("_l"), *by, F.col(ts).alias("_ts"), F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("_r"))  # noqa: E741
    r = right.select(F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("_l"), *by, F.col(ts).alias("_ts"), row.alias("_r"))
    # a right row of the same instant comes first
    out = carry(l.unionByName(r), ["_r"], "_ts", by, [F.col("_l").isNotNull()], bucket=bucket).filter("_l is not null")
    found = F.col("_r")
    if tolerance:
        found = F.when(F.col("_ts") <= F.col("_r._rts") + F.expr(f"interval {tolerance}"), F.col("_r"))
    return out.select("_l.*", *[found[v].alias(v) for v in values])


def forward_asof(left: DataFrame, right: DataFrame, values: list[str], ts: str = "ts", bucket: str = "1 day") -> DataFrame:
    """For each left row the values of the first right row at or after it."""
    l, r = left.withColumn("_neg", -number(left, ts)), right.withColumn("_neg", -number(right, ts)).select("_neg", *values)  # noqa: E741
    return asof(l, r, values, ts="_neg", bucket=bucket).drop("_neg")


def synchronize(base: DataFrame, assets: DataFrame, names: list[str], freq: str = "1 minute", backfill: bool = False, bucket: str = "1 day") -> DataFrame:
    """base (ts, ...) with the last close of each asset in the bucket of its ts, filled forward, and backward if asked."""
    last = assets.groupBy(F.window("ts", freq)["start"].alias("_b")).pivot("asset", names).agg(F.max_by("close", "ts"))
    x = carry(base.withColumn("_b", F.window("ts", freq)["start"]).join(last, "_b", "left").drop("_b"), names, bucket=bucket)
    return carry(x, names, back=True, bucket=bucket) if backfill else x


def union_axis(base: DataFrame, assets: DataFrame, names: list[str], bucket: str = "1 day") -> DataFrame:
    """All times of either side, each series carried forward: (ts, close, one column per asset)."""
    wide = assets.groupBy("ts").pivot("asset", names).agg(F.max("close"))
    return carry(base.select("ts", "close").join(wide, "ts", "full_outer").select("ts", "close", *names), ["close", *names], bucket=bucket)


def within_events(rows: DataFrame, events: DataFrame, before: str = "5 minutes", after: str = "5 minutes", inside: bool = True, bucket: str = "1 hour") -> DataFrame:
    """Rows within an event's interval (inside) or outside all of them. Events are put into every time bucket their
    interval touches, so that the range join is an equi-join on the bucket with a residual test."""
    e = events.select((F.col("ts") - F.expr(f"interval {before}")).alias("_from"), (F.col("ts") + F.expr(f"interval {after}")).alias("_to"))
    step = F.expr(f"interval {bucket}")
    first = F.window("_from", bucket)["start"]
    e = e.withColumn("_first", first).withColumn("_b", F.explode(F.sequence(F.col("_first"), F.col("_to"), step))).drop("_first")
    x = rows.withColumn("_b", F.window("ts", bucket)["start"])
    hit = (x["_b"] == e["_b"]) & (x["ts"] >= e["_from"]) & (x["ts"] <= e["_to"])
    return x.join(e, hit, "left_semi" if inside else "left_anti").drop("_b")
