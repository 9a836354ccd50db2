"""Naive Bayes from class statistics."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from acctrisk.models.base import Fit, Scorer, check_predictors
from acctrisk.sources.schemas import LABEL

VARIANCE_FLOOR = 1e-6


def require_both_classes(labels: Iterable) -> None:
    if {int(v) for v in labels if v is not None} != {0, 1}:
        raise ValueError("the training rows must hold both classes, 0 and 1")


def class_statistics(train: DataFrame, predictors: Sequence[str]) -> dict:
    """Rows, mean and variance per class and predictor: one aggregation, two rows on the driver."""
    check_predictors(train, predictors)
    measures = [f(c).alias(f"{n}_{c}") for c in predictors for n, f in (("m", F.avg), ("v", F.var_samp))]
    rows = train.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"), *measures).collect()
    require_both_classes(r[LABEL] for r in rows)
    return {
        int(r[LABEL]): {
            "n": r["n"],
            **{c: (r[f"m_{c}"], max(r[f"v_{c}"] or 0.0, VARIANCE_FLOOR)) for c in predictors},
        } for r in rows if r[LABEL] is not None
    }


def log_density(column: Column, mean: float, variance: float) -> Column:
    away = column - F.lit(mean)
    return F.lit(-0.5 * math.log(2 * math.pi * variance)) - away * away / F.lit(2 * variance)


def _posterior(no: Column, yes: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(no - yes))


def gaussian(predictors: Sequence[str]) -> Fit:
    """Normal densities within each class."""

    def fit(train: DataFrame) -> Scorer:
        stats = class_statistics(train, predictors)

        def score(df: DataFrame) -> DataFrame:
            total = {
                c: sum((log_density(F.col(p), *s[p]) for p in predictors), F.lit(math.log(s["n"])))
                for c, s in stats.items()}
            return df.withColumn("score", _posterior(total[0], total[1]))

        return score

    return fit


def _pooled(stats: dict, predictor: str) -> tuple[float, float]:
    n = sum(s["n"] for s in stats.values())
    mean = sum(s["n"] * s[predictor][0] for s in stats.values()) / n
    squares = sum((s["n"] - 1) * s[predictor][1] + s["n"] * (s[predictor][0] - mean) ** 2 for s in stats.values())
    return mean, max(squares / max(n - 1, 1), VARIANCE_FLOOR)


def inclusion(stats: dict, predictor: str, prior: float = 0.5) -> float:
    """Posterior probability that a predictor depends on the class (BIC approximation)."""
    n = sum(s["n"] for s in stats.values())
    apart = -0.5 * sum(s["n"] * math.log(s[predictor][1]) for s in stats.values())
    together = -0.5 * n * math.log(_pooled(stats, predictor)[1])
    odds = apart - together - math.log(n) + math.log(prior / (1 - prior))
    return 1 / (1 + math.exp(-max(min(odds, 700.0), -700.0)))


def model_averaged(predictors: Sequence[str], prior: float = 0.5) -> Fit:
    """Naive Bayes averaged over which predictors matter.

    A predictor counts with its class density to the degree that its statistics favour a
    dependence on the class, and with its overall density otherwise.
    """

    def fit(train: DataFrame) -> Scorer:
        stats = class_statistics(train, predictors)
        weight = {p: inclusion(stats, p, prior) for p in predictors}

        def term(p: str, s: dict) -> Column:
            own, all_rows = log_density(F.col(p), *s[p]), log_density(F.col(p), *_pooled(stats, p))
            # log(w * exp(own) + (1 - w) * exp(all_rows)) without leaving the log scale
            a = own + math.log(max(weight[p], 1e-300))
            b = all_rows + math.log(max(1 - weight[p], 1e-300))
            return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))

        def score(df: DataFrame) -> DataFrame:
            total = {c: sum((term(p, s) for p in predictors), F.lit(math.log(s["n"]))) for c, s in stats.items()}
            return df.withColumn("score", _posterior(total[0], total[1]))

        return score

    return fit
