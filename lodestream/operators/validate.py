"""Validation rules, anomaly flags and quality metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import book
from ..functions.windows import Rolling
from .clean import gap_seconds

ARRIVAL = Rolling(order=("sequence",))


@dataclass
class Rule:
    """count: an aggregate that gives the number of violations; needs: columns without which the rule passes."""

    name: str
    count: Callable[[], Column]
    needs: tuple[str, ...] = ()
    severity: str = "warning"
    enabled: bool = True


def outside(c: str, lo: float, hi: float) -> Callable[[], Column]:
    return lambda: F.count_if((F.col(c) < lo) | (F.col(c) > hi))


@dataclass
class RuleSet:
    rules: list[Rule] = field(default_factory=list)

    @staticmethod
    def ticks() -> RuleSet:
        """Limits on price, volume, spread, jumps and order."""
        return RuleSet([
            Rule("price_range", outside("price", 1000, 5000), ("price",), "error"),
            Rule("volume_range", outside("volume", 0, 1000), ("volume",)),
            Rule("spread_range", outside("spread", 0.1, 10), ("spread",)),
            Rule("price_jump", lambda: F.count_if(F.abs(F.col("_pct")) * 100 > 2), ("price",)),
            Rule("timestamp_order", lambda: F.coalesce(F.max(F.when(F.col("_gap") < 0, 1).otherwise(0)), F.lit(0)) + F.count_if(F.col("_gap") > 60), ("ts",), "error"),
        ])

    @staticmethod
    def books() -> RuleSet:
        return RuleSet([Rule("book_integrity", lambda: F.sum(book.violations()), ("bids", "asks"), "critical")])

    def add(self, rule: Rule) -> None:
        self.rules.append(rule)

    def remove(self, name: str) -> None:
        self.rules = [r for r in self.rules if r.name != name]

    def run(self, df: DataFrame, by: str = "symbol") -> DataFrame:
        """(by, rule, severity, violations, passed): one aggregation for all rules. A rule whose columns are missing passes."""
        x = df
        if "price" in df.columns:
            x = x.withColumn("_pct", ARRIVAL.pct("price"))
        if "ts" in df.columns:
            x = x.withColumn("_gap", gap_seconds(ARRIVAL))
        live = [r for r in self.rules if r.enabled]
        counts = [(r.count() if set(r.needs) <= set(df.columns) else F.lit(0)).cast("long").alias(f"_{k}") for k, r in enumerate(live)]
        x = x.groupBy(by).agg(F.count("*").alias("_n"), *counts)
        each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(f"_{k}").alias("violations")) for k, r in enumerate(live)]))
        return x.select(by, each.alias("r")).select(by, "r.*", (F.col("r.violations") == 0).alias("passed"))


def price_anomaly(c: str = "price", rolling: Rolling = ARRIVAL, window: int = 20, least: int = 10, z: float = 3.0) -> Column:
    """A value more than z population deviations from the mean of up to `window` rows before it, from row `least` on."""
    w = rolling.prior(window)
    score = F.abs(F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w)))
    return F.coalesce((rolling.n > least) & (score > z), F.lit(False))


def volume_anomaly(c: str = "volume", rolling: Rolling = ARRIVAL, window: int = 50, least: int = 10, k: float = 3.0) -> Column:
    """A value outside k interquartile ranges of the quartiles of up to `window` rows before it."""
    w = rolling.prior(window)
    lo, hi = F.expr(f"percentile({c}, 0.25)").over(w), F.expr(f"percentile({c}, 0.75)").over(w)
    return F.coalesce((rolling.n > least) & ((F.col(c) < lo - k * (hi - lo)) | (F.col(c) > hi + k * (hi - lo))), F.lit(False))


def tick_quality(ticks: DataFrame) -> DataFrame:
    """Per symbol: completeness, accuracy, consistency, timeliness and their weighted sum."""
    x = ticks.withColumns({"_a": price_anomaly().cast("int"), "_b": volume_anomaly().cast("int"), "_gap2": gap_seconds(ARRIVAL)})
    cells = F.avg((F.col("price").isNotNull().cast("int") + F.col("volume").isNotNull().cast("int") + F.col("ts").isNotNull().cast("int")) / 3)
    m = x.groupBy("symbol").agg(F.count("*").alias("total"), cells.alias("completeness"), F.sum(F.col("_a") + F.col("_b")).alias("anomalies"), F.avg("_gap2").alias("_mean_gap"))
    bad = RuleSet.ticks().run(ticks).groupBy("symbol").agg(F.sum("violations").alias("violations"))
    out = m.join(bad, "symbol").withColumns({
        "accuracy": 1 - F.col("anomalies") / F.col("total"), "consistency": 1 - F.col("violations") / F.col("total"), "timeliness": F.greatest(F.lit(0.0), 1 - F.abs(F.coalesce("_mean_gap", F.lit(1.0)) - 1)),
    })
    return out.withColumn("overall", 0.3 * F.col("completeness") + 0.3 * F.col("accuracy") + 0.2 * F.col("consistency") + 0.2 * F.col("timeliness")).drop("_mean_gap")


def book_quality(books: DataFrame) -> DataFrame:
    bad = RuleSet.books().run(books).select("symbol", "violations")
    n = books.groupBy("symbol").agg(F.count("*").alias("total"), F.avg(((F.size("bids") > 0) & (F.size("asks") > 0)).cast("int")).alias("completeness"))
    return n.join(bad, "symbol").withColumn("consistency", 1 - F.col("violations") / F.col("total"))


def frame_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: rows, nulls (NaN among them), infinite values, distinct values (approximate) and completeness."""
    number = lambda c: F.col(c).cast("double")
    stats = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull() | F.isnan(number(c))).alias(f"null_{c}") for c in columns], *[F.count_if(F.abs(number(c)) == float("inf")).alias(f"inf_{c}") for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"null_{c}").alias("nulls"), F.col(f"inf_{c}").alias("infinite")) for c in columns]))
    return stats.select("n", each.alias("e")).select("e.column", F.col("n").alias("rows"), "e.nulls", "e.infinite", (1 - F.try_divide("e.nulls", "n")).alias("completeness"))


def multivariate_anomaly(df: DataFrame, columns: list[str], threshold: float = 3.0) -> DataFrame:
    """Flags rows by Mahalanobis distance per root of the number of columns; mean and covariance come from one aggregation."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=columns, outputCol="_v").transform(df.na.fill(0.0, columns))
    x = StandardScaler(inputCol="_v", outputCol="_z", withMean=True).fit(x).transform(x)
    pca = PCA(k=len(columns), inputCol="_z", outputCol="_p").fit(x)
    var = [max(float(v), 1e-12) for v in pca.explainedVariance]
    total = len(columns)
    parts = vector_to_array("_p")
    d2 = sum((parts[k] * parts[k] / (v * total) for k, v in enumerate(var)), F.lit(0.0))
    return pca.transform(x).withColumns({"distance": F.sqrt(d2 / total), "anomaly": F.sqrt(d2 / total) > threshold}).select(*df.columns, "distance", "anomaly")


def quality_summary(metrics: DataFrame) -> DataFrame:
    """metrics (data_type, overall, anomalies, failed) -> per type counts, mean score and sums."""
    return metrics.groupBy("data_type").agg(F.count("*").alias("n"), F.avg("overall").alias("overall"), F.sum("anomalies").alias("anomalies"), F.sum("failed").alias("failed"))


def quality_status(score: Column) -> Column:
    return F.when(score >= 0.9, "excellent").when(score >= 0.8, "good").when(score >= 0.7, "acceptable").when(score >= 0.5, "poor").otherwise("critical")
