"""Weighted cross products of rows, summed by Spark, and logistic fits from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from acctrisk.sources.schemas import LABEL

#: Iterations of a fit, and the relative change of its deviance that ends it.
ITERATIONS, CLOSE = 40, 1e-9

#: The design of a batch: a column per coefficient.
Design = Callable[[dict[str, np.ndarray]], np.ndarray]


def standard(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and spread of each column; a constant column has spread 1."""
    found = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c: (found[i]["m"] or 0.0, found[i]["s"] or 1.0) for i, c in enumerate(columns)}


def cross_products(df: DataFrame, columns: Sequence[str], design: Design, beta: np.ndarray) -> tuple[np.ndarray, float]:
    """Cross products of the design and the working response with the logistic weights at ``beta``, and the deviance.

    Each task gives its sums in ``size**2`` rows at most; the driver gets as many, whatever the table.
    """
    size = len(beta) + 1

    def add(batches):
        sums = np.zeros(size * size + 1)
        for batch in batches:
            data = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate([*columns, LABEL])}
            x, y = design(data), data[LABEL]
            eta = np.clip(x @ beta, -30, 30)
            p = 1 / (1 + np.exp(-eta))
            w = np.maximum(p * (1 - p), 1e-10)
            root = np.column_stack([x, eta + (y - p) / w]) * np.sqrt(w)[:, None]
            sums[:-1] += (root.T @ root).ravel()
            sums[-1] -= 2 * np.sum(y * np.log(p) + (1 - y) * np.log1p(-p))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["place", "value"])

    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)], F.col(LABEL).cast("double"))
    found = rows.mapInArrow(add, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size * size + 1)
    out[found["place"].to_numpy()] = found["value"].to_numpy()
    return out[:-1].reshape(size, size), float(out[-1])


def sweep(matrix: np.ndarray, k: int) -> np.ndarray:
    """The matrix swept on one pivot: its variable enters the regression or, swept again, leaves it."""
    pivot = matrix[k, k]
    out = matrix - np.outer(matrix[:, k], matrix[k]) / pivot
    out[k], out[:, k] = matrix[k] / pivot, matrix[:, k] / pivot
    out[k, k] = -1 / pivot
    return out


def logistic_fit(df: DataFrame, columns: Sequence[str], design: Design, size: int, penalty: Callable | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, the last cross products and the deviance, by iterated weighted least squares.

    ``penalty`` makes a matrix from the cross products, which is added to them. Coefficients that the
    others determine are 0.
    """
    beta, last = np.zeros(size), np.inf
    for _ in range(ITERATIONS):
        products, deviance = cross_products(df, columns, design, beta)
        if abs(last - deviance) <= CLOSE * (abs(deviance) + 1):
            break
        last = deviance
        left, right = products[:-1, :-1], products[:-1, -1]
        if penalty is not None:
            left = left + penalty(left)
        beta = solve(left, right)
    return beta, products, deviance


def solve(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of normal equations; columns that earlier ones determine get 0."""
    scale = np.sqrt(np.maximum(np.diag(left), 1e-300))
    swept, used = np.column_stack([left / np.outer(scale, scale), right / scale]), []
    for k in range(len(left)):
        if swept[k, k] > 1e-9:
            row = swept[k] / swept[k, k]
            swept = swept - np.outer(swept[:, k], row)
            swept[k] = row
            used.append(k)
    out = np.zeros(len(left))
    out[used] = swept[used, -1] / scale[used]
    return out
