"""Naive Bayes with kernel densities.

A density is estimated from counts on a grid: one aggregation gives the counts of all classes
and predictors, a table of fixed size, and the smoothing is done on that table. The cost of a
row is a look-up, however many training rows there were.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from acctrisk.models.base import Fit, Scorer, check_predictors
from acctrisk.models.bayes import require_both_classes
from acctrisk.sources.schemas import LABEL

# The usual rule-of-thumb bandwidth, the grid, and the margin in bandwidths.
BANDWIDTH_FACTOR, NORMAL_IQR = 0.9, 1.34
GRID, MARGIN = 512, 3.0
DENSITY_FLOOR = 1e-12


def _ranges(train: DataFrame, predictors: Sequence[str], adjust: float) -> dict:
    """Class size, and low end, grid step and bandwidth per class and predictor."""
    measures = [f(c).alias(f"{n}_{c}") for c in predictors
                for n, f in (("s", F.stddev_samp), ("lo", F.min), ("hi", F.max))]
    quarters = [F.percentile_approx(c, [0.25, 0.75], 10_000).alias(f"q_{c}") for c in predictors]
    out = {}
    for r in train.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"), *measures, *quarters).collect():
        ranges = {}
        for c in predictors:
            spread = r[f"s_{c}"] or 0.0
            quarter = (r[f"q_{c}"][1] - r[f"q_{c}"][0]) / NORMAL_IQR
            width = min(spread, quarter) or spread or abs(r[f"lo_{c}"]) or 1.0
            width *= adjust * BANDWIDTH_FACTOR * r["n"] ** -0.2
            low, high = r[f"lo_{c}"] - MARGIN * width, r[f"hi_{c}"] + MARGIN * width
            ranges[c] = (float(low), float((high - low) / (GRID - 1)), float(width))
        out[int(r[LABEL])] = (r["n"], ranges)
    require_both_classes(out)
    return out


def _grid_counts(train: DataFrame, predictors: Sequence[str], ranges: dict) -> dict:
    """Rows per grid point, each row shared between the two points around it."""
    entries = []
    for c in predictors:
        low = F.when(F.col(LABEL) == 0, ranges[0][1][c][0]).otherwise(ranges[1][1][c][0])
        step = F.when(F.col(LABEL) == 0, ranges[0][1][c][1]).otherwise(ranges[1][1][c][1])
        entries.append(F.struct(F.lit(c).alias("predictor"), ((F.col(c) - low) / step).alias("at")))
    long = train.select(LABEL, F.inline(F.array(*entries)))
    cells = long.groupBy(LABEL, "predictor", F.floor("at").cast("int").alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("at") - F.floor("at")).alias("above"))
    counts = {(k, c): np.zeros(GRID + 1) for k in ranges for c in predictors}
    for r in cells.collect():  # at most classes x predictors x grid points
        grid = counts[int(r[LABEL]), r["predictor"]]
        grid[r["cell"]] += r["n"] - r["above"]
        grid[r["cell"] + 1] += r["above"]
    return counts


def density(counts: np.ndarray, step: float, width: float) -> np.ndarray:
    """Normal-kernel density at the grid points."""
    reach = min(GRID, math.ceil(6 * width / step))
    offsets = np.arange(-reach, reach + 1) * step
    kernel = np.exp(-0.5 * (offsets / width) ** 2) / (width * math.sqrt(2 * math.pi))
    return np.convolve(counts[:GRID], kernel)[reach:reach + GRID] / counts.sum()


def kernel(predictors: Sequence[str], adjust: float = 1.0) -> Fit:
    """Normal-kernel densities within each class, as a probability of class 1."""
    if adjust <= 0:
        raise ValueError("the bandwidth factor must be positive")

    def fit(train: DataFrame) -> Scorer:
        check_predictors(train, predictors)
        rows = train.where(F.col(LABEL).isNotNull())
        ranges = _ranges(rows, predictors, adjust)
        counts = _grid_counts(rows, predictors, ranges)
        tables = {key: density(grid, ranges[key[0]][1][key[1]][1], ranges[key[0]][1][key[1]][2])
                  for key, grid in counts.items()}
        starts = {(k, c): ranges[k][1][c][:2] for k, c in counts}
        prior = math.log(ranges[1][0]) - math.log(ranges[0][0])
        names = list(predictors)

        @F.pandas_udf("double")
        def posterior(points: pd.Series) -> pd.Series:
            x = np.stack(points.to_numpy()) if len(points) else np.empty((0, len(names)))
            odds = np.full(len(x), prior)
            for j, c in enumerate(names):
                for k, sign in ((0, -1.0), (1, 1.0)):
                    low, step = starts[k, c]
                    grid = low + step * np.arange(GRID)
                    found = np.interp(x[:, j], grid, tables[k, c], left=0.0, right=0.0)
                    odds += sign * np.log(np.maximum(found, DENSITY_FLOOR))
            return pd.Series(1 / (1 + np.exp(-np.clip(odds, -700, 700))))

        def score(df: DataFrame) -> DataFrame:
            return df.withColumn("score", posterior(F.array(*[F.col(c).cast("double") for c in names])))

        return score

    return fit
