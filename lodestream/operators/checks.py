"""Checks of frames by kind and column, times in several formats, samples, and functions over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns that each kind of frame must have.
REQUIRED = {"tick": ("ts", "symbol", "price", "volume"), "orderbook": ("ts", "symbol", "bids", "asks"), "bars": ("ts", "symbol", "open", "high", "low", "close", "volume"), "cross_asset": ("ts", "asset", "close"), "features": ("ts", "symbol")}


def missing_columns(df: DataFrame, kind: str) -> list[str]:
    return [c for c in REQUIRED[kind] if c not in df.columns]


def column_checks(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, nulls, infinite, constant): NaN counts as null; a column of one value, or of none, is constant. One
    aggregation over all columns."""
    x = lambda c: F.col(c).cast("double")
    empty = lambda c: x(c).isNull() | F.isnan(x(c))
    aggs = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(empty(c)).alias("nulls"), F.count_if(F.abs(x(c)) == float("inf")).alias("infinite"), F.coalesce(F.min(F.when(~empty(c), x(c))) == F.max(F.when(~empty(c), x(c))), F.lit(True)).alias("constant")).alias(f"_{k}") for k, c in enumerate(columns)]
    return df.agg(*aggs).select(F.explode(F.array(*[f"_{k}" for k in range(len(columns))])).alias("s")).select("s.*")


def repeated_columns(df: DataFrame, columns: list[str]) -> list[tuple[str, str]]:
    """Pairs of columns whose values are equal in every row, told by sums of row hashes: one aggregation."""
    x = df.select(F.monotonically_increasing_id().alias("_row"), *columns)
    sums = x.agg(*[F.sum(F.xxhash64(F.col(c).cast("string"), "_row").cast("decimal(38,0)")).alias(c) for c in columns]).first()
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :] if sums[a] == sums[b]]


def frame_is_valid(df: DataFrame, kind: str, most_nulls: float = 0.05, least_rows: int = 100) -> tuple[bool, list[str]]:
    """(passed, messages): an empty frame, a missing column or an infinite value fails; many nulls or few rows only warn."""
    if missing := missing_columns(df, kind):
        return False, [f"missing: {', '.join(missing)}"]
    numbers = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float", "int", "bigint")]
    rows = column_checks(df, numbers).collect() if numbers else []
    n = rows[0]["rows"] if rows else df.count()
    if not n:
        return False, ["empty"]
    wrong = [f"{r['column']}: infinite" for r in rows if r["infinite"]]
    said = [f"{r['column']}: {r['nulls']} of {n} null" for r in rows if r["nulls"] > most_nulls * n] + ([f"{n} rows"] if n < least_rows else [])
    return not wrong, wrong + said


def parse_time(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm")) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def sample(df: DataFrame, share: float, key: str, seed: int = 42) -> DataFrame:
    """Rows whose key's hash falls into the share: the same rows for the same seed, however the table is partitioned."""
    return df.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def map_batches(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int = 1000) -> DataFrame:
    """f over batches of at most `rows` rows of a partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), rows):
                yield f(frame.iloc[at : at + rows])

    return df.mapInPandas(run, schema)
