"""Training, prediction, evaluation, validation splits and importance for binary classifiers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import quantiles, running


@dataclass(frozen=True)
class BoostedTrees:
    """Gradient-boosted trees of Spark, classes weighed by neg / pos; one class for both kinds of boosting."""

    rounds: int = 50
    depth: int = 6
    rate: float = 0.05
    subsample: float = 0.8
    seed: int = 42

    def fit(self, df: DataFrame, features: list[str], label: str, validation: str | None = None):
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        n = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count("*").alias("n")).first()
        ratio = (n["n"] - n["pos"]) / n["pos"] if n["pos"] else 1.0
        x = df.withColumns({"_label": F.col(label).cast("double"), "_weight": F.when(F.col(label) == 1, ratio).otherwise(1.0)})
        trees = GBTClassifier(featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=self.rounds, maxDepth=self.depth, stepSize=self.rate, subsamplingRate=self.subsample, seed=self.seed)
        if validation:
            trees = trees.setValidationIndicatorCol(validation)
        return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep"), trees]).fit(x)


def predict(model, df: DataFrame, cut: float = 0.5) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return with_confidence(model.transform(df).withColumn("p", vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction"), cut)


def with_confidence(df: DataFrame, cut: float = 0.5) -> DataFrame:
    """predicted = p > cut, confidence = |p - 0.5| * 2."""
    return df.withColumns({"predicted": (F.col("p") > cut).cast("int"), "confidence": F.abs(F.col("p") - 0.5) * 2})


def classification_metrics(df: DataFrame) -> DataFrame:
    """df (y, p, predicted) -> one row; 0 where a ratio has no denominator."""
    tp, fp, fn, tn = (F.count_if((F.col("predicted") == a) & (F.col("y") == b)) for a, b in ((1, 1), (1, 0), (0, 1), (0, 0)))
    r = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    eps = 1e-15
    q = F.least(F.greatest(F.col("p"), F.lit(eps)), F.lit(1 - eps))
    loss = F.avg(-F.when(F.col("y") == 1, F.ln(q)).otherwise(F.ln(1 - q)))
    return df.agg(F.count("*").alias("n"), r(tp + tn, F.count("*")).alias("accuracy"), r(tp, tp + fp).alias("precision"), r(tp, tp + fn).alias("recall"), r(2 * tp, 2 * tp + fp + fn).alias("f1"), loss.alias("log_loss"))


def _by_score(df: DataFrame) -> DataFrame:
    return df.groupBy("p").agg(F.count_if(F.col("y") == 1).alias("_t"), F.count_if(F.col("y") == 0).alias("_f"))


def _with_totals(c: DataFrame) -> DataFrame:
    """The curve with the numbers of positives and negatives, one row that is broadcast."""
    return c.join(F.broadcast(c.agg(F.sum("_t").alias("_pos"), F.sum("_f").alias("_neg"))))


def _curve(df: DataFrame) -> DataFrame:
    return running(_by_score(df), ["p"], {"tp": "_t", "fp": "_f"}, descending=True)


def curve(df: DataFrame) -> DataFrame:
    """(p, tp, fp) cumulative over falling distinct p: one row per distinct score, from counts per score."""
    return _curve(df).select("p", "tp", "fp")


def roc_auc(df: DataFrame) -> DataFrame:
    """Exact area by ranks: pairs ordered right plus half of the ties, from counts per score."""
    x = running(_by_score(df), ["p"], {"_b": "_f"})
    return x.agg(F.try_divide(F.sum(F.col("_t") * (F.col("_b") - F.col("_f") / 2)), F.sum("_t").cast("double") * F.sum("_f")).alias("roc_auc"))


def pr_auc(df: DataFrame) -> DataFrame:
    """Trapezoid over recall, from (0, 1). The point before a score follows from its own counts."""
    c, t, f = _with_totals(_curve(df)), F.col("tp") - F.col("_t"), F.col("fp") - F.col("_f")
    width = F.try_divide("_t", "_pos")
    before = F.coalesce(F.try_divide(t, t + f), F.lit(1.0))
    return c.agg(F.sum(width * (F.col("tp") / (F.col("tp") + F.col("fp")) + before) / 2).alias("pr_auc"))


def youden(df: DataFrame) -> DataFrame:
    """Threshold of greatest true minus false positive rate."""
    j = F.try_divide("tp", "_pos") - F.try_divide("fp", "_neg")
    return _with_totals(_curve(df)).withColumn("j", j).agg(F.max_by("p", F.struct(F.round("j", 12), "p")).alias("threshold"), F.max("j").alias("j"))


def strategy_returns(df: DataFrame, unit: float = 0.01) -> DataFrame:
    return df.withColumn("ret", F.when(F.col("predicted") == F.col("y"), F.col("confidence") * unit).otherwise(-F.col("confidence") * unit))


def performance(df: DataFrame, order: str, ret: str = "ret", by: list[str] | None = None) -> DataFrame:
    """Sharpe, Sortino, drawdown of additive returns, profit factor, expectancy, win rate, value at risk and shortfall, omega."""
    by = by or []
    r = F.col(ret)
    x = running(df, [order], {"_cum": ret}, by=by)
    x = running(x, [order], greatest={"_peak": "_cum"}, by=by).withColumn("_dd", F.col("_cum") - F.col("_peak"))
    mean, std, down = F.avg(r), F.stddev_pop(r), F.stddev_pop(F.when(r < 0, r))
    gain, loss = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0)))
    var = quantiles(df, ret, [0.05], by, "_q")
    out = x.groupBy(*by).agg(
        F.count("*").alias("n"), F.coalesce(F.try_divide(mean, std), F.lit(0.0)).alias("_sh"), F.count_if(r < 0).alias("_neg"), mean.alias("expectancy"), down.alias("_down"), F.min("_dd").alias("max_drawdown"), F.sum(r).alias("total"),
        F.coalesce(F.try_divide(gain, loss), F.lit(0.0)).alias("profit_factor"), F.avg((r > 0).cast("int")).alias("win_rate"),
    )
    out = (out.join(var, by, "left") if by else out.join(F.broadcast(var))).withColumn("var_95", F.col("_q")[0])
    year = math.sqrt(252)
    sortino = F.when(F.col("_neg") == 0, F.when(F.col("expectancy") > 0, float("inf")).otherwise(0.0)).otherwise(F.coalesce(F.try_divide("expectancy", "_down"), F.lit(0.0)) * year)
    return out.select(*by, "n", "expectancy", (F.col("_sh") * year).alias("sharpe"), sortino.alias("sortino"), "max_drawdown", "profit_factor", "win_rate", "var_95", F.coalesce(F.try_divide("total", F.abs("max_drawdown")), F.lit(0.0)).alias("calmar"))


def shortfall(df: DataFrame, ret: str = "ret") -> DataFrame:
    """Mean return at or below the 5 % quantile."""
    cut = quantiles(df, ret, [0.05], name="_v")
    return df.join(F.broadcast(cut), F.col(ret) <= F.col("_v")[0]).agg(F.avg(ret).alias("cvar_95"))


def expanding_folds(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """fold 0 is the head that is never tested; folds 1..k of n // (k + 1) rows each follow in order."""
    n = df.agg(F.count("*").alias("_n")).withColumn("_size", F.floor(F.col("_n") / (k + 1)))
    x = running(df.withColumn("_one", F.lit(1)), order, {"_at": "_one"}).join(F.broadcast(n))
    fold = F.floor((F.col("_at") - 1 - (F.col("_n") - k * F.col("_size"))) / F.col("_size")) + 1
    return x.withColumn("fold", F.greatest(F.lit(0), fold).cast("int")).drop("_one", "_at", "_size", "_n")


def walk_forward(df: DataFrame, start: str, train_days: int, test_days: int, folds: int, purge: str = "30 minutes") -> DataFrame:
    """Rows with the folds they train or test in: test windows follow train windows after a purged gap."""
    s = df.sparkSession
    f = s.range(folds).select(F.col("id").cast("int").alias("fold"), (F.to_timestamp_ntz(F.lit(start)) + F.make_dt_interval(F.col("id").cast("int") * test_days)).alias("_a"))
    f = f.withColumn("_b", F.col("_a") + F.make_dt_interval(F.lit(train_days))).withColumn("_c", F.col("_b") + F.make_dt_interval(F.lit(test_days)))
    x = df.join(F.broadcast(f), (df["ts"] >= f["_a"]) & (df["ts"] < f["_c"]))
    role = F.when(F.col("ts") < F.col("_b") - F.expr(f"interval {purge}"), "train").when(F.col("ts") >= F.col("_b"), "test")
    return x.withColumn("role", role).filter("role is not null").drop("_a", "_b", "_c")


def retrain_reasons(age_days: Column, score: Column, best: Column, frequency: str = "monthly", degradation: float = 0.05) -> Column:
    limit = {"daily": 1, "weekly": 7, "monthly": 30}[frequency]
    return F.when(F.try_divide(best - score, best) > degradation, "degraded").when(age_days >= limit, "old")


def importance(model, features: list[str], df: DataFrame | None = None, target: str | None = None) -> DataFrame:
    """(feature, gain, corr, stability, relevance, score): gain from the trees, |correlation|, the deviation of monthly
    correlations left out of stability, and relevance by name."""
    from pyspark.sql import SparkSession

    from ..functions.scalar import business_relevance
    from ..plans.engine import column_stats

    s = SparkSession.active()
    gain = model.stages[-1].featureImportances.toArray()
    out = s.createDataFrame([(n, float(g)) for n, g in zip(features, gain, strict=True)], "feature string, gain double")
    corr = column_stats(df, features, target).select("feature", F.abs("corr").alias("corr")) if df is not None else out.select("feature", F.lit(0.0).alias("corr"))
    out = out.join(corr, "feature").withColumns({"stability": F.lit(0.5), "relevance": business_relevance(F.col("feature"))})
    return out.withColumn("score", 0.65 * F.col("gain") + 0.15 * F.coalesce("corr", F.lit(0.0)) + 0.1 * F.col("stability") + 0.1 * F.col("relevance"))


def permutation_importance(df: DataFrame, features: list[str], target: str, seed: int = 7) -> DataFrame:
    """max(0, mse of a linear model with one column shuffled - mse) / mse, a column at a time."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    x = df.select(*features, F.col(target).cast("double").alias("_y"))
    make = lambda d: VectorAssembler(inputCols=features, outputCol="_v").transform(d)
    model = LinearRegression(featuresCol="_v", labelCol="_y").fit(make(x))
    mse = lambda d: model.transform(make(d)).agg(F.avg(F.pow(F.col("_y") - F.col("prediction"), 2))).first()[0]
    base, rows = mse(x), []
    # a column is shuffled within parts that a hash of the row deals out, none of them larger than a task holds
    parts = max(1, x.count() // 100_000)
    x = x.withColumn("_b", F.pmod(F.xxhash64(*x.columns), F.lit(parts)))
    ranked = lambda d, *o: d.withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy(*o)))
    for f in features:
        mixed = ranked(x.drop(f), *x.drop(f).columns).join(ranked(x.select(f, "_b"), F.xxhash64(f, F.lit(seed)), F.rand(seed)), ["_b", "_k"]).drop("_k", "_b")
        rows.append((f, max(0.0, mse(mixed) - base) / base if base else 0.0))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def search(df: DataFrame, features: list[str], label: str, grid: dict[str, list], folds: int = 3):
    """Cross-validated search over BoostedTrees' parameters; returns the fitted CrossValidatorModel."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    trees = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=10)
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(getattr(trees, name), values)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), trees])
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=b.build(), evaluator=BinaryClassificationEvaluator(labelCol="_label"), numFolds=folds, seed=7)
    return cv.fit(df.withColumn("_label", F.col(label).cast("double")))


def top_features(scores: DataFrame, n: int = 10, column: str = "score") -> DataFrame:
    """The n features of greatest absolute score, ties by name."""
    return scores.orderBy(F.desc(F.abs(column)), "feature").limit(n)


def prune_features(scores: DataFrame, threshold: float, column: str = "score") -> list[str]:
    """Names of the features whose score reaches the threshold, best first."""
    return [r["feature"] for r in scores.filter(F.col(column) >= threshold).orderBy(F.desc(column), "feature").collect()]


def cross_validate(df: DataFrame, features: list[str], label: str, order: list[str], k: int = 5, model: BoostedTrees | None = None) -> tuple[DataFrame, list[float]]:
    """(df with fold and oof, log loss of each fold): each fold is scored by a model of all rows before it; the head that is
    never tested scores 0."""
    model, folded = model or BoostedTrees(), expanding_folds(df, order, k)
    out, losses = folded.filter("fold = 0").withColumn("oof", F.lit(0.0)), []
    for fold in range(1, k + 1):
        scored = predict(model.fit(folded.filter(F.col("fold") < fold), features, label), folded.filter(F.col("fold") == fold)).withColumnRenamed("p", "oof").drop("predicted", "confidence")
        q = F.least(F.greatest("oof", F.lit(1e-15)), F.lit(1 - 1e-15))
        losses.append(scored.agg(F.avg(-F.when(F.col(label) == 1, F.ln(q)).otherwise(F.ln(1 - q)))).first()[0])
        out = out.unionByName(scored)
    return out, losses


def save_model(model, path: str, features: list[str], version: str = "1") -> str:
    """Writes a fitted pipeline and, beside it, its features, version and a hash of both; returns the hash."""
    import hashlib
    import json

    from pyspark.sql import SparkSession

    note = {"features": features, "version": version}
    note["hash"] = hashlib.sha256(json.dumps(note, sort_keys=True).encode()).hexdigest()[:16]
    model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/note")
    return note["hash"]


def load_model(path: str):
    """(fitted pipeline, {features, version, hash})."""
    import json

    from pyspark.ml import PipelineModel
    from pyspark.sql import SparkSession

    return PipelineModel.load(f"{path}/model"), json.loads(SparkSession.active().read.text(f"{path}/note").first()[0])


def stacked(columns: list[str], weights: list[float]) -> Column:
    """Weighted mean of base probabilities."""
    return sum((F.col(c) * w for c, w in zip(columns, weights, strict=True)), F.lit(0.0)) / sum(weights)
