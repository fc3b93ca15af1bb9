"""Isolation forest: rows that random splits set apart early are anomalies.

Trees grow on the driver from a bounded sample, chosen by hash; every row is scored where it lies, by trees that are
broadcast as arrays of at most 2 * sample nodes each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_depth(n: np.ndarray | int) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary search tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Tree:
    """Nodes as arrays: column -1 marks a leaf, whose value is the depth that its rows would still have."""

    def __init__(self, x: np.ndarray, rng: np.random.Generator):
        self.column, self.cut, self.left, self.value = [], [], [], []
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        queue = [(x, 0, self._node())]
        while queue:
            rows, depth, at = queue.pop()
            spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(x.shape[1])
            if depth >= limit or len(rows) <= 1 or not spread.any():
                self.value[at] = depth + float(mean_depth(len(rows)))
                continue
            c = rng.choice(np.flatnonzero(spread))
            cut = rng.uniform(rows[:, c].min(), rows[:, c].max())
            self.column[at], self.cut[at], self.left[at] = int(c), float(cut), self._node()
            self._node()
            low = rows[:, c] <= cut
            queue += [(rows[low], depth + 1, self.left[at]), (rows[~low], depth + 1, self.left[at] + 1)]
        self.column, self.cut, self.left, self.value = (np.array(v) for v in (self.column, self.cut, self.left, self.value))

    def _node(self) -> int:
        for v, x in ((self.column, -1), (self.cut, 0.0), (self.left, 0), (self.value, 0.0)):
            v.append(x)
        return len(self.column) - 1

    def depths(self, x: np.ndarray) -> np.ndarray:
        at, going = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(going):
            node = at[going]
            going = going[self.column[node] >= 0]
            node = at[going]
            at[going] = self.left[node] + (x[going, self.column[node]] > self.cut[node])
        return self.value[at]


def isolation_forest(df: DataFrame, columns: list[str], trees: int = 100, sample_rows: int = 256, fit_rows: int = 10_000, share: float = 0.1, seed: int = 42, least_rows: int = 100) -> DataFrame:
    """df with isolation (the score, between 0 and 1, higher: more apart) and anomaly, the share of highest scores. Columns are
    standardised, nulls and infinite values are 0; with fewer than least_rows rows nothing is an anomaly."""
    x = [F.coalesce(F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.nanvl(F.col(c).cast("double"), F.lit(0.0))), F.lit(0.0)) for c in columns]
    rows = df.select(F.array(*x).alias("v")).orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(fit_rows).toPandas()
    if len(rows) < least_rows:
        return df.withColumns({"isolation": F.lit(0.0), "anomaly": F.lit(False)})
    fit = np.stack(rows["v"].to_numpy())
    mean, std = fit.mean(0), fit.std(0)
    std[std == 0] = 1.0
    rng, fit = np.random.default_rng(seed), (fit - mean) / std
    size = min(sample_rows, len(fit))
    forest = [Tree(fit[rng.choice(len(fit), size, replace=False)], rng) for _ in range(trees)]
    score = lambda z: 2 ** (-np.mean([t.depths(z) for t in forest], axis=0) / float(mean_depth(size)))
    limit = float(np.quantile(score(fit), 1 - share))
    shared = df.sparkSession.sparkContext.broadcast((forest, mean, std, size))

    @F.pandas_udf("double")
    def isolation(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grown, m, s, n = shared.value
        for v in parts:
            z = (np.stack(v.to_numpy()) - m) / s if len(v) else np.zeros((0, len(m)))
            yield pd.Series(2 ** (-np.mean([t.depths(z) for t in grown], axis=0) / float(mean_depth(n))))

    return df.withColumn("isolation", isolation(F.array(*x))).withColumn("anomaly", F.col("isolation") > limit)
