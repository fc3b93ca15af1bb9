"""Rolling primitives over rows of one symbol in time order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Rolling:
    """Builds window expressions; every one of them has the same partitioning and order, so a projection of many
    of them needs one shuffle and one sort."""

    by: tuple[str, ...] = ("symbol",)
    order: tuple[Column | str, ...] = ("ts",)

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def rows(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(-(n - 1), 0)

    def prior(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(-n, -1)

    @property
    def cum(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def n(self) -> Column:
        """Position in the series from 1."""
        return F.row_number().over(self.w)

    def lag(self, c: Column | str, k: int = 1) -> Column:
        return F.lag(_col(c), k).over(self.w)

    def diff(self, c: Column | str, k: int = 1) -> Column:
        return _col(c) - self.lag(c, k)

    def pct(self, c: Column | str, k: int = 1) -> Column:
        return F.try_divide(_col(c), self.lag(c, k)) - 1

    def full(self, agg: Column, c: Column | str, n: int) -> Column:
        """The aggregate over n rows, null until n values stand in the window."""
        return F.when(F.count(_col(c)).over(self.rows(n)) == n, agg.over(self.rows(n)))

    def mean(self, c: Column | str, n: int) -> Column:
        return self.full(F.avg(_col(c)), c, n)

    def sum(self, c: Column | str, n: int) -> Column:
        return self.full(F.sum(_col(c)), c, n)

    def std(self, c: Column | str, n: int, population: bool = False) -> Column:
        return self.full((F.stddev_pop if population else F.stddev_samp)(_col(c)), c, n)

    def max(self, c: Column | str, n: int) -> Column:
        return self.full(F.max(_col(c)), c, n)

    def min(self, c: Column | str, n: int) -> Column:
        return self.full(F.min(_col(c)), c, n)

    def cov(self, x: Column | str, y: Column | str, n: int) -> Column:
        both = F.when(_col(x).isNotNull() & _col(y).isNotNull(), 1)
        return F.when(F.count(both).over(self.rows(n)) == n, F.covar_samp(_col(x), _col(y)).over(self.rows(n)))

    def corr(self, x: Column | str, y: Column | str, n: int) -> Column:
        sx, sy = F.stddev_samp(_col(x)).over(self.rows(n)), F.stddev_samp(_col(y)).over(self.rows(n))
        return F.try_divide(self.cov(x, y, n), sx * sy)

    def zscore(self, c: Column | str, n: int) -> Column:
        return F.try_divide(_col(c) - self.mean(c, n), self.std(c, n))

    def weighted(self, c: Column | str, n: int) -> Column:
        """Linear weights, the newest row n: sums of lags, no array."""
        total = sum((self.lag(c, k) * (n - k) for k in range(1, n)), _col(c) * n)
        return total / (n * (n + 1) / 2)

    def ffill(self, c: Column | str) -> Column:
        return F.last(_col(c), ignorenulls=True).over(self.cum)

    def bfill(self, c: Column | str) -> Column:
        """Looks into the future: only where asked for."""
        return F.first(_col(c), ignorenulls=True).over(self.w.rowsBetween(0, Window.unboundedFollowing))

    def ffill_limited(self, c: Column | str, limit: int) -> Column:
        """Forward fill over gaps of at most limit rows."""
        return F.coalesce(_col(c), F.last(_col(c), ignorenulls=True).over(self.prior(limit)))
