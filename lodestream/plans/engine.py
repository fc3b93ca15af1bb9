"""Registry of feature groups, dependency order, the minimal and extended sets, selection and pruning."""

from __future__ import annotations

import graphlib
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import Rolling
from ..operators import scan, structure, technical

R = Rolling()


@dataclass(frozen=True)
class Group:
    """compute: bars -> (symbol, ts, features); needs: columns; after: groups whose columns it reads."""

    name: str
    compute: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ("open", "high", "low", "close", "volume")
    after: tuple[str, ...] = ()
    priority: int = 2
    enabled: bool = True
    min_rows: int = 0


@dataclass
class Engine:
    groups: dict[str, Group] = field(default_factory=dict)

    def register(self, group: Group) -> None:
        self.groups[group.name] = group
        self.order()  # a cycle is an error at once

    def order(self, names: set[str] | None = None) -> list[str]:
        """Topological order of the groups and all they depend on."""
        graph = {g.name: set(g.after) for g in self.groups.values()}
        if names is not None:
            wanted, queue = set(), list(names)
            while queue:
                if (n := queue.pop()) not in wanted:
                    wanted.add(n)
                    queue.extend(graph[n])
            graph = {n: graph[n] for n in wanted}
        return list(graphlib.TopologicalSorter(graph).static_order())

    def chosen(self, feature_set: str = "extended", names: list[str] | None = None) -> set[str]:
        if names is not None:
            return set(names)
        return {g.name for g in self.groups.values() if g.enabled and (feature_set != "minimal" or g.priority <= 2)}

    def extract(self, bars: DataFrame, feature_set: str = "extended", names: list[str] | None = None, fill: bool = False) -> DataFrame:
        """One wide table of bars and the groups' columns; a name that two groups give is kept from the first."""
        out = bars
        for name in self.order(self.chosen(feature_set, names)):
            g = self.groups[name]
            if missing := set(g.needs) - set(out.columns):
                raise ValueError(f"{name} needs {sorted(missing)}")
            f = g.compute(out)
            new = [c for c in f.columns if c not in out.columns]
            out = out.join(f.select("symbol", "ts", *new), ["symbol", "ts"], "left")
            if g.min_rows:
                enough = F.count("*").over(Window.partitionBy("symbol")) >= g.min_rows
                out = out.withColumns({c: F.when(enough, F.col(c)) for c in new})
        return fill_forward(out, [c for c in out.columns if c not in bars.columns]) if fill else out


def default_engine() -> Engine:
    e = Engine()
    e.register(Group("technical", technical.technical, priority=1, min_rows=100))
    e.register(Group("recurrences", scan.recurrences, priority=1, min_rows=100))
    e.register(Group("smart_money", structure.smart_money, priority=3, min_rows=50))
    e.register(Group("profile", lambda b: structure.rolling_profile(b, 100), priority=2, min_rows=200))
    return e


def fill_forward(df: DataFrame, columns: list[str], zero: bool = True) -> DataFrame:
    last = {c: R.ffill(c) for c in columns}
    return df.withColumns({c: F.coalesce(v, F.lit(0)) if zero else v for c, v in last.items()})


def minimal_features(bars: DataFrame, fill: bool = True) -> DataFrame:
    """The six features of the fast path, in window expressions and one recurrence: hma_5, atr_14 (exponential, seeded by the
    first true range), gkyz_volatility, obi proxy by signed volume, vpvr_breakout, liquidity_sweep."""
    o, h, low, c, v = (F.col(n) for n in ("open", "high", "low", "close", "volume"))
    c1 = R.lag("close")
    ln = lambda a, b: F.ln(F.try_divide(a, b))
    gk = ln(h, o) * (ln(h, o) - ln(c, o)) + ln(low, o) * (ln(low, o) - ln(c, o)) - ln(h, o) * ln(low, o) + 0.5 * F.pow(ln(c, c1), 2)
    tr = F.coalesce(F.greatest(h - low, F.abs(h - c1), F.abs(low - c1)), h - low)
    x = bars.withColumns({"_rn": R.n, "_gk": gk, "_tr": tr, "_raw": 2 * R.weighted("close", 2) - R.weighted("close", 5), "_up": F.when(c > c1, v).otherwise(0.0), "_down": F.when(c < c1, v).otherwise(0.0)})
    m = F.avg("_gk").over(R.rows(20))
    up, down = F.sum("_up").over(R.rows(10)), F.sum("_down").over(R.rows(10))
    price = F.max_by("close", F.struct(F.col("volume"), -F.col("_rn"))).over(R.rows(100))
    prior_hi, prior_lo = F.max("high").over(R.prior(20)), F.min("low").over(R.prior(20))
    far = F.try_divide(c - price, price)
    x = x.withColumns({
        "hma_5": R.weighted("_raw", 2), "gkyz_volatility": F.when((F.col("_rn") > 20) & (m >= 0), F.sqrt(252 * m)), "obi_5_level": F.when(F.col("_rn") >= 10, F.coalesce(F.try_divide(up - down, up + down), F.lit(0.0))),
        "vpvr_breakout": F.when((F.col("_rn") >= 50) & (far > 0.02), 1).when((F.col("_rn") >= 50) & (far < -0.02), -1).otherwise(0),
        "liquidity_sweep": F.when((F.col("_rn") > 20) & (h > prior_hi + 0.01) & (c < prior_hi), 1).when((F.col("_rn") > 20) & (low < prior_lo - 0.01) & (c > prior_lo), -1).otherwise(0),
    })
    # the recurrence forgets its seed by a factor of 13/15 a bar, so 300 bars of history give it in full
    alpha, span = 2 / 15, 300
    trs = F.reverse(F.collect_list("_tr").over(R.rows(span)))
    weights = [alpha * (1 - alpha) ** k for k in range(span)]
    seed = F.when(F.col("_rn") <= span, F.element_at(trs, -1) * F.pow(F.lit(1 - alpha), F.col("_rn") - 1) * (1 - alpha)).otherwise(0.0)
    total = F.aggregate(F.zip_with(trs, F.lit(weights), lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    x = x.withColumn("atr_14", total + seed)
    names = ["hma_5", "atr_14", "gkyz_volatility", "obi_5_level", "vpvr_breakout", "liquidity_sweep"]
    x = x.select("symbol", "ts", *names)
    return fill_forward(x, names) if fill else x


def column_stats(df: DataFrame, columns: list[str], target: str | None = None) -> DataFrame:
    """(feature, variance, distinct, corr): one aggregation over all columns, turned into rows."""
    aggs = [F.struct(F.lit(c).alias("feature"), F.var_samp(c).alias("variance"), F.count_distinct(c).alias("distinct"), (_corr(c, target) if target else F.lit(None).cast("double")).alias("corr")).alias(c) for c in columns]
    return df.agg(*aggs).select(F.explode(F.array(*columns)).alias("s")).select("s.*")


def _corr(a: str, b: str):
    """Null instead of an error where a column is constant."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def select_by_variance(df: DataFrame, columns: list[str], k: int = 200, drop_share: float = 0.1) -> list[str]:
    """Names above the lowest tenth of variances, the k greatest; ties by name."""
    rows = sorted(((r["variance"] or 0.0, r["feature"]) for r in column_stats(df, columns).collect()), key=lambda r: (-r[0], r[1]))
    floor = sorted(v for v, _ in rows)[math.floor((len(rows) - 1) * drop_share)] if rows else 0.0
    return [n for v, n in rows if v > floor][:k]


def select_by_correlation(df: DataFrame, columns: list[str], target: str, k: int = 50) -> list[str]:
    rows = column_stats(df, columns, target).collect()
    return [r["feature"] for r in sorted(rows, key=lambda r: (-abs(r["corr"] or 0.0), r["feature"]))[:k]]


def drop_constant(df: DataFrame, columns: list[str], least_variance: float = 0.0) -> list[str]:
    """Columns of more than one distinct value whose variance is above the bound."""
    return [r["feature"] for r in column_stats(df, columns).collect() if r["distinct"] > 1 and (r["variance"] or 0.0) > least_variance]


def post_process(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ("symbol", "ts"), most: int = 200, limit: float = 0.95) -> DataFrame:
    """One row a key, nulls filled forward, then backward, then by 0; constant columns go, of more than 50 the most variable
    `most` stay, and of more than 20 those correlated beyond the limit go."""
    rest = [c for c in df.columns if c not in keys]
    x = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*df.columns)
    on = Window.partitionBy(keys[0]).orderBy(keys[1]).rowsBetween(0, Window.unboundedFollowing)
    r = Rolling(by=(keys[0],), order=(keys[1],))
    x = x.withColumns({c: F.coalesce(r.ffill(c), F.first(c, True).over(on), F.lit(0)) for c in columns})
    kept = drop_constant(x, columns)
    if len(kept) > 50:
        kept = select_by_variance(x, kept, most)
    if len(kept) > 20:
        kept = prune_correlated(x, kept, limit)
    return x.select(*[c for c in df.columns if c not in columns or c in kept])


def correlation_matrix(df: DataFrame, columns: list[str], method: str = "pearson"):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    v = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(df)
    return Correlation.corr(v, "_v", method).first()[0].toArray()


def prune_correlated(df: DataFrame, columns: list[str], limit: float = 0.95) -> list[str]:
    """For each column with earlier ones beyond the limit, only the one of greatest variance stays among those."""
    m = correlation_matrix(df, columns)
    var = {r["feature"]: r["variance"] or 0.0 for r in column_stats(df, columns).collect()}
    gone: set[str] = set()
    for j, c in enumerate(columns):
        if near := [columns[i] for i in range(j) if abs(m[i][j]) > limit]:
            best = max([*near, c], key=lambda n: var[n])
            gone |= {n for n in near if n != best}
    return [c for c in columns if c not in gone]


def univariate(df: DataFrame, columns: list[str], target: str, k: int) -> list[str]:
    """The k columns of greatest F statistic against a continuous target."""
    from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler

    v = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(df.withColumn("_y", F.col(target).cast("double")))
    s = UnivariateFeatureSelector(featuresCol="_v", outputCol="_o", labelCol="_y", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(k)
    return [columns[i] for i in sorted(s.fit(v).selectedFeatures)]


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 16) -> DataFrame:
    """(feature, mi) in nats between equal-width bins of each column and a discrete target."""
    lo_hi = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns]).first()
    long = df.select(target, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.least(F.lit(bins - 1), F.floor((F.col(c) - lo_hi[c]["lo"]) / (max(lo_hi[c]["hi"] - lo_hi[c]["lo"], 1e-300)) * bins).cast("int")).alias("bin")) for c in columns])).alias("e")).select(F.col(target).alias("y"), "e.*")
    n = long.groupBy("feature", "bin", "y").agg(F.count("*").alias("n"))
    a, b, t = (n.groupBy("feature", *k).agg(F.sum("n").alias(c)) for k, c in ((["bin"], "na"), (["y"], "nb"), ([], "nt")))
    x = n.join(a, ["feature", "bin"]).join(b, ["feature", "y"]).join(t, "feature")
    return x.groupBy("feature").agg(F.sum(F.col("n") / F.col("nt") * F.ln(F.col("n") * F.col("nt") / (F.col("na") * F.col("nb")))).alias("mi"))
