"""Matchers, calibration and the singleton model, on MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matcher(features: list[str], kind: str = "gbt", seed: int = 7, **settings) -> Pipeline:
    """A model of P(match): medians for missing values, which flags mark, then trees or a logistic regression.

    Columns are those of ``with_flags``."""
    inputs = [f"{f}_v" for f in features]
    steps = [Imputer(inputCols=inputs, outputCols=[f"{f}_i" for f in features], strategy="median"), VectorAssembler(inputCols=[f"{f}_i" for f in features] + [f"{f}_m" for f in features], outputCol="features")]
    if kind == "gbt":
        model = GBTClassifier(labelCol="label", weightCol="weight", seed=seed, **({"maxIter": 20, "maxDepth": 4} | settings))
    else:
        model = LogisticRegression(labelCol="label", weightCol="weight", **({"regParam": 1e-4} | settings))
    return Pipeline(stages=[*steps, model])


def with_flags(rows: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles (<f>_v, NaN where missing) with flags of missing ones (<f>_m); a weight of 1 where there is none."""
    out = rows.withColumns({f"{f}_v": F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features} | {f"{f}_m": F.col(f).isNull().cast("double") for f in features})
    return out if "weight" in rows.columns else out.withColumn("weight", F.lit(1.0))


def fit(rows: DataFrame, features: list[str], kind: str = "gbt", held: str | None = None, **settings) -> PipelineModel:
    """Fit on ``rows``, kept in memory or on disk meanwhile, since training reads them many times.

    ``held`` names a boolean column of the rows that trees stop growing by, when they don't improve on them."""
    from pyspark import StorageLevel

    ready = with_flags(rows, features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if held and kind == "gbt":
            settings = {"validationIndicatorCol": held, "validationTol": 1e-3} | settings
        return matcher(features, kind, **settings).fit(ready if held and kind == "gbt" or not held else ready.where(~F.col(held)))
    finally:
        ready.unpersist()


def predict(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with ``prob``."""
    return model.transform(with_flags(rows, features)).withColumn("prob", vector_to_array("probability")[1]).select(*rows.columns, "prob")


def logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.ln(p / (1 - p))


class Calibrator:
    """Probabilities out of raw ones (``prob``): by isotonic regression, Platt's logit, beta's two logs, or none.

    Fit on rows (prob, label) that the matcher didn't see, and applied to any."""

    def __init__(self, kind: str = "isotonic") -> None:
        if kind not in ("none", "isotonic", "platt", "beta"):
            raise ValueError(f"no calibration of kind {kind}")
        self.kind, self.model = kind, None

    def _inputs(self, rows: DataFrame) -> DataFrame:
        p = F.greatest(F.least("prob", F.lit(1 - 1e-6)), F.lit(1e-6))
        inputs = {"_a": logit(p)} if self.kind == "platt" else {"_a": F.ln(p), "_b": -F.ln(1 - p)}
        return VectorAssembler(inputCols=list(inputs), outputCol="_x").transform(rows.withColumns(inputs))

    def fit(self, rows: DataFrame) -> Calibrator:
        rows = rows.select(F.col("prob").cast("double").alias("prob"), F.col("label").cast("double").alias("label"))
        if self.kind == "isotonic":
            self.model = IsotonicRegression(featuresCol="prob", labelCol="label").fit(rows)
        elif self.kind != "none":
            self.model = LogisticRegression(featuresCol="_x", labelCol="label", regParam=0.0, probabilityCol="_q", rawPredictionCol="_raw", predictionCol="_y").fit(self._inputs(rows))
        return self

    def apply(self, rows: DataFrame, name: str = "calibrated") -> DataFrame:
        """``rows`` with the calibrated probability."""
        if self.kind == "none":
            return rows.withColumn(name, F.col("prob").cast("double"))
        if self.kind == "isotonic":
            return self.model.setPredictionCol("_y").transform(rows.withColumn("prob", F.col("prob").cast("double"))).withColumn(name, F.col("_y")).drop("_y")
        out = self.model.transform(self._inputs(rows))
        return out.withColumn(name, vector_to_array("_q")[1]).select(*rows.columns, name)


def calibration_error(rows: DataFrame, p: str) -> DataFrame:
    """One row: mean negative log likelihood and Brier score of a probability."""
    q, y = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6)), F.col("label")
    return rows.agg(F.round(F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))), 6).alias("nll"), F.round(F.avg((q - y) * (q - y)), 6).alias("brier"))


class Singletons:
    """The probability that a query has any match, by its candidates' scores; the share that has one, if all or none do."""

    FEATURES = ("p_max", "p_second", "gap", "p_sum", "p_mean", "n_cand", "n_p50", "n_p80", "score_max", "name_freq_l", "name_ntok_l", "name_empty_l")

    def fit(self, context: DataFrame) -> Singletons:
        """``context`` is ``entity_context`` with label (whether there is a match)."""
        self.columns = [c for c in self.FEATURES if c in context.columns]
        seen = context.agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.avg("label").alias("mean")).first()
        self.constant = float(seen["mean"] or 0.0) if seen["lo"] == seen["hi"] else None
        self.model = None if self.constant is not None else fit(context, self.columns, "gbt", maxIter=30, maxDepth=4)
        return self

    def apply(self, context: DataFrame) -> DataFrame:
        """(q, any_match)"""
        if self.model is None:
            return context.select("q", F.lit(self.constant).alias("any_match"))
        return predict(self.model, context, self.columns).select("q", F.col("prob").alias("any_match"))


def entity_context(pairs: DataFrame, p: str = "prob", entities: DataFrame | None = None) -> DataFrame:
    """(q, p_max, p_sum, p_mean, n_cand, n_p50, n_p80, p_second, gap, and of the pairs' columns score_max and the query's name_freq_l,
    name_ntok_l, name_empty_l), for the model of whether a query has any match.

    With ``entities`` (q), a row for each, zeros without candidates."""
    own = [c for c in ("name_freq_l", "name_ntok_l", "name_empty_l") if c in pairs.columns]
    ranked = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(p), "p")))
    out = ranked.groupBy("q").agg(
        F.max(p).alias("p_max"), F.sum(p).alias("p_sum"), F.avg(p).alias("p_mean"), F.count("*").alias("n_cand"),
        F.count_if(F.col(p) >= 0.5).alias("n_p50"), F.count_if(F.col(p) >= 0.8).alias("n_p80"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col(p))), F.lit(0.0)).alias("p_second"),
        *([F.max("score").alias("score_max")] if "score" in pairs.columns else []), *[F.max(c).alias(c) for c in own],
    )
    if entities is not None:
        zero = [c for c in out.columns if c not in ("q", *own)]
        out = entities.select("q").join(out, "q", "left").fillna(0, zero)
    return out.withColumn("gap", F.col("p_max") - F.col("p_second"))


def importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features by the trees' gain, a missing flag's counted with its feature."""
    gains = model.stages[-1].featureImportances.toArray()
    n = len(features)
    return sorted(((f, float(gains[k] + gains[n + k])) for k, f in enumerate(features)), key=lambda x: (-x[1], x[0]))
