"""Logistic models, support vector machines, additive model and averaged networks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import RFormula, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, functions as F

from acctrisk.functions.hashing import poisson_weight
from acctrisk.models.base import (
    Fit, Scorer, assembled, check_predictors, pipeline, probability_scorer)
from acctrisk.models.trees import averaged
from acctrisk.sources.schemas import KEY, LABEL

# The interaction terms and degrees of freedom the models are defined on.
LOGISTIC_INTERACTIONS = (
    ("mean_balance", "max_balance"), ("mean_cash_balance", "max_cash_balance"),
    ("SpendingOL_perc_max", "SpendingOL_ind"),
)
ADDITIVE_INTERACTIONS = (
    ("min_payment", "median_payment"), ("mean_balance", "max_balance"),
    ("CB_limit_perc_max", "CB_limit_perc_mean"), ("SpendingOL_perc_max", "SpendingOL_ind"),
)
SMOOTH_TERMS = {
    "mean_payment": 7, "number_payments": 4, "TotalBalanceOL_perc_max": 4, "TotalBalanceOL_perc_mean": 3,
}


def scaled() -> StandardScaler:
    return StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)


def logistic(predictors: Sequence[str], ridge: float = 0.0, max_iter: int = 100) -> Fit:
    return pipeline(predictors, LogisticRegression(labelCol=LABEL, regParam=ridge, maxIter=max_iter))


def formula(predictors: Sequence[str], interactions: Sequence[tuple[str, str]] = ()) -> str:
    """``label ~ a + b + a:b``: main effects of all predictors and the listed products."""
    terms = list(dict.fromkeys([*predictors, *[p for pair in interactions for p in pair]]))
    return f"{LABEL} ~ " + " + ".join([*terms, *[f"{a}:{b}" for a, b in interactions]])


def logistic_formula(text: str, max_iter: int = 100) -> Fit:
    """Logistic regression on an R-style formula; ``a*b`` is ``a + b + a:b``."""

    def fit(train: DataFrame) -> Scorer:
        encoded = RFormula(formula=text, featuresCol="features", labelCol="label", handleInvalid="error")
        classifier = LogisticRegression(labelCol="label", maxIter=max_iter)
        return probability_scorer(Pipeline(stages=[encoded, classifier]).fit(train))

    return fit


def _binomial(train: DataFrame, predictors: Sequence[str]):
    glm = GeneralizedLinearRegression(family="binomial", labelCol=LABEL, predictionCol="score", maxIter=25)
    return Pipeline(stages=[assembled(predictors), glm]).fit(train)


def stepwise(predictors: Sequence[str], start: Sequence[str] = (), max_steps: int = 50) -> Fit:
    """Binomial GLM whose predictors enter or leave one at a time while that lowers the AIC.

    The loop is on the driver; every candidate is a distributed fit.
    """

    def fit(train: DataFrame) -> Scorer:
        check_predictors(train, predictors)
        rows = train.persist()
        chosen = list(start) or [predictors[0]]
        model = _binomial(rows, chosen)
        best = model.stages[-1].summary.aic
        for _ in range(max_steps):
            moves = [[*chosen, p] for p in predictors if p not in chosen]
            moves += [[q for q in chosen if q != p] for p in chosen if len(chosen) > 1]
            tried = [(m.stages[-1].summary.aic, i, m) for i, m in enumerate(_binomial(rows, v) for v in moves)]
            aic, i, candidate = min(tried, key=lambda t: t[:2])
            if aic >= best:
                break
            best, chosen, model = aic, moves[i], candidate
        rows.unpersist()

        def score(df: DataFrame) -> DataFrame:
            return model.transform(df).select(*df.columns, "score")

        return score

    return fit


def _margin_machine(features: str, ridge: float, max_iter: int) -> list:
    """A linear machine and, as it gives no probability, a logistic fit on its margin."""
    margin = "__margin"
    machine = LinearSVC(labelCol=LABEL, featuresCol=features, regParam=ridge, maxIter=max_iter,
                        rawPredictionCol="__raw", predictionCol="__side")
    calibration = LogisticRegression(labelCol=LABEL, featuresCol=margin)
    return [machine, VectorAssembler(inputCols=["__raw"], outputCol=margin), calibration]


def svm_linear(predictors: Sequence[str], ridge: float = 0.01, max_iter: int = 50) -> Fit:
    return pipeline(predictors, scaled(), *_margin_machine("scaled", ridge, max_iter))


def fourier_features(sigma: float, inputs: int, size: int, seed: int = 8):
    """A column function whose inner products approximate ``exp(-sigma * |x - y|**2)``."""
    random = np.random.default_rng(seed)
    directions = random.normal(0.0, math.sqrt(2 * sigma), (inputs, size))
    phases = random.uniform(0.0, 2 * math.pi, size)

    @F.pandas_udf("array<double>")
    def expand(x: pd.Series) -> pd.Series:
        z = np.stack(x.to_numpy()) if len(x) else np.empty((0, inputs))
        return pd.Series(list(math.sqrt(2 / size) * np.cos(z @ directions + phases)))

    return expand


def svm_radial(predictors: Sequence[str], sigma: float = 0.05, cost: float = 1.0, size: int = 200,
               max_iter: int = 50) -> Fit:
    """Radial-kernel machine as a linear machine on random Fourier features."""
    expand = fourier_features(sigma, len(predictors), size)

    def fit(train: DataFrame) -> Scorer:
        check_predictors(train, predictors)
        scale = Pipeline(stages=[assembled(predictors), scaled()]).fit(train)

        def mapped(df: DataFrame) -> DataFrame:
            z = expand(vector_to_array(F.col("scaled")))
            return scale.transform(df).withColumn("mapped", array_to_vector(z))

        rows = mapped(train).select(KEY, LABEL, "mapped").persist()
        ridge = 1.0 / (cost * max(rows.count(), 1))
        model = Pipeline(stages=_margin_machine("mapped", ridge, max_iter)).fit(rows)
        rows.unpersist()

        def score(df: DataFrame) -> DataFrame:
            return probability_scorer(model)(mapped(df)).select(*df.columns, "score")

        return score

    return fit


def additive(predictors: Sequence[str], smooth: dict[str, int] = SMOOTH_TERMS,
             interactions: Sequence[tuple[str, str]] = ADDITIVE_INTERACTIONS, ridge: float = 1e-3) -> Fit:
    """Additive logistic model: cubic spline columns for the smooth terms, products for interactions.

    Knots are quantiles of the training rows and basis columns are plain expressions.
    """

    def fit(train: DataFrame) -> Scorer:
        check_predictors(train, list(dict.fromkeys([*predictors, *smooth])))
        names = list(smooth)
        spread = train.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in names]).first()
        knots = train.approxQuantile(names, [i / 8 for i in range(1, 8)], 0.001)

        def basis(df: DataFrame) -> tuple[DataFrame, list[str]]:
            extra = {}
            for name, cuts in zip(names, knots):
                mean, scale = spread[name]["m"], spread[name]["s"] or 1.0
                z = (F.col(name) - mean) / scale
                inner = sorted(set(cuts))[:: max(1, len(set(cuts)) // max(1, smooth[name] - 3))]
                extra[f"__{name}_2"], extra[f"__{name}_3"] = z * z, z * z * z
                for i, knot in enumerate(inner):
                    above = F.greatest(z - (knot - mean) / scale, F.lit(0.0))
                    extra[f"__{name}_k{i}"] = above * above * above
            for a, b in interactions:
                extra[f"__{a}_by_{b}"] = F.col(a) * F.col(b)
            return df.withColumns(extra), list(extra)

        rows, added = basis(train)
        model = Pipeline(stages=[
            assembled([*predictors, *added]),
            LogisticRegression(labelCol=LABEL, regParam=ridge)]).fit(rows)

        def score(df: DataFrame) -> DataFrame:
            return probability_scorer(model)(basis(df)[0]).select(*df.columns, "score")

        return score

    return fit


def network(predictors: Sequence[str], size: int = 2, seed: int = 8, bag_seed: int | None = None,
            max_iter: int = 100) -> Fit:
    """One-hidden-layer network; with ``bag_seed`` it sees a bootstrap sample of the rows."""
    base = pipeline(predictors, scaled(), MultilayerPerceptronClassifier(
        labelCol=LABEL, featuresCol="scaled", layers=[len(predictors), size, 2], maxIter=max_iter, seed=seed))
    if bag_seed is None:
        return base

    def fit(train: DataFrame) -> Scorer:
        copies = F.array_repeat(F.lit(1), poisson_weight(F.col(KEY), bag_seed))
        return base(train.withColumn("__copy", F.explode(copies)).drop("__copy"))

    return fit


def network_average(predictors: Sequence[str], size: int = 2, networks: int = 5, max_iter: int = 100) -> Fit:
    """Mean probability of networks that differ in seed and bootstrap sample."""
    return averaged([network(predictors, size, seed=8 + i, bag_seed=7919 * (i + 1), max_iter=max_iter)
                     for i in range(networks)])
