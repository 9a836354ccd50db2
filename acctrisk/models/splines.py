"""Additive logistic model with penalised splines of given degrees of freedom."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from acctrisk.models import gram
from acctrisk.models.base import Fit, Scorer, check_predictors
from acctrisk.models.linear import ADDITIVE_INTERACTIONS, SMOOTH_TERMS

#: Inner knots of a smooth term, at quantiles.
KNOTS = 12
# The products of the model, that of its two smooth terms with a product among them.
PRODUCTS = (*ADDITIVE_INTERACTIONS, ("TotalBalanceOL_perc_max", "TotalBalanceOL_perc_mean"))


def basis(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Cubic B-splines on ascending knots; values beyond the outer knots count as these."""
    x = np.clip(x, knots[0], knots[-1])
    t = np.concatenate([[knots[0]] * 3, knots, [knots[-1]] * 3])
    last = np.searchsorted(knots, knots[-1]) + 2  # the interval that also holds the right end
    at = np.minimum(np.searchsorted(t, x, "right") - 1, last)
    out = np.zeros((len(x), len(t) - 1))
    out[np.arange(len(x)), at] = 1
    for degree in (1, 2, 3):
        new = np.zeros((len(x), len(t) - 1 - degree))
        for i in range(new.shape[1]):
            for width, from_, part in ((t[i + degree] - t[i], x - t[i], i), (t[i + degree + 1] - t[i + 1], t[i + degree + 1] - x, i + 1)):
                if width > 0:
                    new[:, i] += from_ / width * out[:, part]
        out = new
    return out


def roughness(size: int) -> np.ndarray:
    """Squared second differences of neighbouring coefficients."""
    second = np.diff(np.eye(size), 2, axis=0)
    return second.T @ second


def freedom(products: np.ndarray, rough: np.ndarray, weight: float) -> float:
    """The trace of the smoother: effective degrees of freedom."""
    return float(np.trace(np.linalg.solve(products + weight * rough + 1e-10 * np.trace(products) * np.eye(len(rough)), products)))


def smoothing(products: np.ndarray, rough: np.ndarray, wanted: float) -> float:
    """The weight of the penalty at which a term has the wanted degrees of freedom, or 0 if it can't have so many."""
    low, high = -12.0, 14.0
    scale = np.trace(products) / max(np.trace(rough), 1e-300)
    if freedom(products, rough, 0.0) <= wanted:
        return 0.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if freedom(products, rough, scale * 10 ** middle) > wanted else (low, middle)
    return scale * 10 ** middle


class Terms:
    """The columns of the model: a constant, linear terms, products, and a block per smooth term."""

    def __init__(self, df: DataFrame, linear: Sequence[str], smooth: dict[str, int], products: Sequence[tuple[str, str]]):
        self.columns = list(dict.fromkeys([*linear, *smooth, *[c for pair in products for c in pair]]))
        self.linear, self.products = [c for c in linear if c not in smooth], list(products)
        self.spread = gram.standard(df, self.columns)
        found = df.approxQuantile(list(smooth), [i / (KNOTS + 1) for i in range(KNOTS + 2)], 0.001)
        self.knots = {c: np.unique([self._z(c, np.array(q))]) for c, q in zip(smooth, found)}
        self.knots = {c: k for c, k in self.knots.items() if len(k) > 1}
        self.blocks, at = {}, 1 + len(self.linear) + len(self.products)
        for c, k in self.knots.items():
            self.blocks[c] = slice(at, at + len(k) + 2)
            at += len(k) + 2
        self.size, self.wanted = at, {c: smooth[c] + 1 for c in self.knots}  # one for the block's own constant

    def _z(self, column: str, x: np.ndarray) -> np.ndarray:
        return (x - self.spread[column][0]) / self.spread[column][1]

    def design(self, data: dict[str, np.ndarray]) -> np.ndarray:
        z = {c: self._z(c, data[c]) for c in self.columns}
        return np.column_stack([np.ones(len(z[self.columns[0]])), *[z[c] for c in self.linear], *[z[a] * z[b] for a, b in self.products],
                                *[basis(z[c], k) for c, k in self.knots.items()]])

    def penalty(self, products: np.ndarray) -> np.ndarray:
        out = np.zeros((self.size, self.size))
        for c, block in self.blocks.items():
            own = products[block, block]
            rough = roughness(len(own))
            out[block, block] = smoothing(own, rough, self.wanted[c]) * rough
        return out

    def freedoms(self, products: np.ndarray) -> dict[str, float]:
        """Effective degrees of freedom of each smooth term, without its constant."""
        out = {}
        for c, block in self.blocks.items():
            own = products[block, block]
            out[c] = freedom(own, roughness(len(own)), smoothing(own, roughness(len(own)), self.wanted[c])) - 1
        return out


def additive(predictors: Sequence[str], smooth: dict[str, int] = SMOOTH_TERMS, products: Sequence[tuple[str, str]] = PRODUCTS) -> Fit:
    """Additive logistic model. A smooth term is a cubic spline whose penalty is solved for its degrees of freedom.

    Each iteration is one pass that sums cross products; the driver holds matrices of the number of
    coefficients. A term with fewer distinct quantiles than its degrees needs is not penalised.
    """

    def fit(train: DataFrame) -> Scorer:
        check_predictors(train, list(dict.fromkeys([*predictors, *smooth, *[c for pair in products for c in pair]])))
        terms = Terms(train, predictors, smooth, products)
        beta, _, _ = gram.logistic_fit(train, terms.columns, terms.design, terms.size, terms.penalty)

        @F.pandas_udf("double")
        def probability(*columns: pd.Series) -> pd.Series:
            eta = terms.design(dict(zip(terms.columns, (c.to_numpy() for c in columns)))) @ beta
            return pd.Series(1 / (1 + np.exp(-np.clip(eta, -30, 30))))

        def score(df: DataFrame) -> DataFrame:
            return df.withColumn("score", probability(*[F.col(c).cast("double") for c in terms.columns]))

        return score

    return fit
