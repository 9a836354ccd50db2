"""Stepwise selection by AIC with moves scored on one matrix."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from acctrisk.models import gram
from acctrisk.models.base import Fit, Scorer, check_predictors

#: AIC by which a move may look worse on the matrix and still be fitted.
DOUBT = 1.0


def _design(columns: Sequence[str], spread: dict) -> gram.Design:
    def design(data):
        return np.column_stack([np.ones(len(next(iter(data.values())))), *[(data[c] - spread[c][0]) / spread[c][1] for c in columns]])

    return design


def _padded(design: gram.Design, columns: Sequence[str], chosen: Sequence[str], beta: np.ndarray) -> np.ndarray:
    """Coefficients of the chosen columns as those of all."""
    out = np.zeros(len(columns) + 1)
    out[0] = beta[0]
    for c, b in zip(chosen, beta[1:]):
        out[1 + list(columns).index(c)] = b
    return out


def moves(products: np.ndarray, columns: Sequence[str], chosen: Sequence[str]) -> list[tuple[float, str]]:
    """The change of AIC that each variable makes by entering or leaving, least first.

    ``products`` are the cross products of all columns with the weights of the chosen model. Swept on
    that model, they give each move's change of the squared error, which stands for the deviance.
    """
    swept, inside = products, [0, *[1 + list(columns).index(c) for c in chosen]]
    for k in inside:
        swept = gram.sweep(swept, k)
    out = []
    for i, c in enumerate(columns, 1):
        if i in inside:
            out.append((swept[i, -1] ** 2 / -swept[i, i] - 2, c))
        elif swept[i, i] > 1e-7 * products[i, i]:
            out.append((2 - swept[i, -1] ** 2 / swept[i, i], c))
    return sorted(out)


def path(df: DataFrame, columns: Sequence[str], start: Sequence[str], max_steps: int = 1000) -> tuple[list[tuple], list[str], np.ndarray, dict]:
    """Steps ``(variable, entered, aic)`` from the start on, the variables chosen, their coefficients and spreads.

    A step takes one pass for the matrix and one fit, mostly of the best move only.
    """
    spread = gram.standard(df, columns)

    def fitted(names):
        beta, products, deviance = gram.logistic_fit(df, names, _design(names, spread), len(names) + 1)
        return beta, deviance + 2 * np.count_nonzero(beta)

    # Of the start, variables that others determine are left out: they have no coefficient.
    beta, aic = fitted(list(start))
    chosen = [c for c, b in zip(start, beta[1:]) if b]
    beta, steps = np.array([beta[0], *[b for b in beta[1:] if b]]), [(None, None, float(aic))]
    everything = _design(columns, spread)
    for _ in range(max_steps):
        products, _ = gram.cross_products(df, columns, everything, _padded(everything, columns, chosen, beta))
        for change, name in moves(products, columns, chosen):
            if change > DOUBT:
                return steps, chosen, beta, spread
            names = [c for c in chosen if c != name] if name in chosen else [*chosen, name]
            other, found = fitted(names)
            if found < aic - 1e-7:
                steps.append((name, name not in chosen, float(found)))
                chosen, beta, aic = names, other, found
                break
        else:
            break
    return steps, chosen, beta, spread


def stepwise(predictors: Sequence[str], start: Sequence[str] | None = None, max_steps: int = 1000) -> Fit:
    """Logistic model whose variables enter or leave one at a time while that lowers the AIC; from the full model on."""

    def fit(train: DataFrame) -> Scorer:
        check_predictors(train, predictors)
        _, chosen, beta, spread = path(train, predictors, predictors if start is None else start, max_steps)

        def score(df: DataFrame) -> DataFrame:
            terms = [F.lit(float(b)) * (F.col(c).cast("double") - spread[c][0]) / spread[c][1] for c, b in zip(chosen, beta[1:])]
            return df.withColumn("score", 1 / (1 + F.exp(-sum(terms, F.lit(float(beta[0]))))))

        return score

    return fit


def step_table(df: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """The steps from the full model on: ``step``, ``variable``, ``entered`` and ``aic``."""
    check_predictors(df, predictors)
    steps, *_ = path(df, predictors, predictors)
    return df.sparkSession.createDataFrame([(i, *s) for i, s in enumerate(steps)], "step int, variable string, entered boolean, aic double")
