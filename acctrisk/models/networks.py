"""Averaged networks of one hidden layer with weight decay, all of them fitted together.

A pass adds up the loss, its gradient and its Gauss-Newton matrix per network. What leaves a task, and what
reaches the driver, depends on the networks and not on the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from acctrisk.functions.hashing import poisson_weight
from acctrisk.models.base import Fit, Scorer, added, check_predictors
from acctrisk.models.gram import standard
from acctrisk.operators.joins import union_all
from acctrisk.plans.evaluate import roc_auc
from acctrisk.session import checkpointed
from acctrisk.sources.schemas import KEY, LABEL

#: Relative change of the loss that ends a fit, and the damping at which it gives up.
CLOSE, MOST_DAMPING = 1e-7, 1e8


@dataclass(frozen=True)
class Net:
    """``bag_seed`` draws a bootstrap sample of the rows, ``held`` is a fold that is left out."""

    size: int = 2
    decay: float = 0.33
    seed: int = 8
    bag_seed: int | None = None
    held: int | None = None

    def start(self, inputs: int) -> np.ndarray:
        return np.random.default_rng([self.seed, self.size]).uniform(-0.7, 0.7, self.size * (inputs + 2) + 1)

    def weight(self) -> Column:
        weight = F.lit(1.0) if self.bag_seed is None else poisson_weight(F.col(KEY), self.bag_seed).cast("double")
        return weight if self.held is None else F.when(F.col("fold") == self.held, 0.0).otherwise(weight)


def forward(theta: np.ndarray, size: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hidden layer and the log-odds of rows; ``x`` begins with a column of ones."""
    inner, outer = theta[:-size - 1].reshape(x.shape[1], size), theta[-size - 1:]
    hidden = 1 / (1 + np.exp(-np.clip(x @ inner, -30, 30)))
    return hidden, np.clip(outer[0] + hidden @ outer[1:], -30, 30)


def row_sums(theta: np.ndarray, size: int, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Gauss-Newton matrix of some rows, without the penalty."""
    hidden, odds = forward(theta, size, x)
    p = 1 / (1 + np.exp(-odds))
    slope = hidden * (1 - hidden) * theta[-size:]
    jacobian = np.hstack([(x[:, :, None] * slope[:, None, :]).reshape(len(x), -1), np.ones((len(x), 1)), hidden])
    loss = -np.sum(weight * (y * np.log(p) + (1 - y) * np.log1p(-p)))
    curved = jacobian * (weight * p * (1 - p))[:, None]
    return loss, jacobian.T @ (weight * (p - y)), curved.T @ jacobian


def _part_sums(theta: np.ndarray, size: int, x: np.ndarray, products: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list:
    """What :func:`row_sums` adds up, without the Jacobian: its rows are products of a row of ``x`` and a slope per hidden unit.

    ``products`` has those of all pairs of columns of ``x``; networks on the same rows share them.
    """
    hidden, odds = forward(theta, size, x)
    p = 1 / (1 + np.exp(-odds))
    slope = hidden * (1 - hidden) * theta[-size:]
    off, curve = weight * (p - y), weight * p * (1 - p)
    loss = -np.sum(weight * (y * np.log(p) + (1 - y) * np.log1p(-p)))
    curved, tail = slope * curve[:, None], np.column_stack([np.ones(len(x)), hidden])
    first, second = np.triu_indices(size)
    return [loss, (x.T @ (slope * off[:, None])).ravel(), tail.T @ off, products.T @ (curved[:, first] * slope[:, second]),
            x.T @ (curved[:, :, None] * tail[:, None, :]).reshape(len(x), -1), tail.T @ (tail * curve[:, None])]


def _places(n: int) -> np.ndarray:
    """Where the pair of two columns stands among the pairs of ``n``."""
    out = np.zeros((n, n), np.int64)
    out[np.triu_indices(n)] = np.arange(n * (n + 1) // 2)
    return np.maximum(out, out.T)


def _whole(size: int, inputs: int, parts: list) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Gauss-Newton matrix from the sums of :func:`_part_sums`."""
    loss, inner, outer, pairs, cross, corner = parts
    block = pairs[_places(inputs + 1)][:, :, _places(size)].transpose(0, 2, 1, 3).reshape((inputs + 1) * size, -1)
    cross = cross.reshape((inputs + 1) * size, size + 1)
    return loss, np.concatenate([inner, outer]), np.block([[block, cross], [cross.T, corner]])


def network_sums(rows: DataFrame, inputs: int, nets: dict[int, tuple[int, int, np.ndarray]]) -> dict[int, tuple]:
    """The sums of :func:`row_sums` over all rows, for networks given as weight column, size and coefficients.

    The sums of the tasks meet by network, one row per network and task.
    """
    def add(batches):
        sums: dict[int, list] = {}
        alike: dict[int, list[int]] = {}
        for m, (w, _, _) in nets.items():
            alike.setdefault(w, []).append(m)
        first, second = np.triu_indices(inputs + 1)
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            x = np.column_stack([np.ones(batch.num_rows), *[column(f"x{i}") for i in range(inputs)]])
            y = column("y")
            for w, members in alike.items():
                weight = column(f"w{w}")
                use = np.flatnonzero(weight > 0)
                own, label, weight = x[use], y[use], weight[use]
                products = own[:, first] * own[:, second]
                for m in members:
                    found = _part_sums(nets[m][2], nets[m][1], own, products, label, weight)
                    sums[m] = [a + b for a, b in zip(sums[m], found)] if m in sums else found
        values = []
        for m, parts in sums.items():
            loss, gradient, matrix = _whole(nets[m][1], inputs, parts)
            values.append(np.concatenate([[loss], gradient, matrix[np.triu_indices(len(gradient))]]).tobytes())
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(values, pa.binary())], names=["net", "sums"])

    def meet(batches):
        for (m,), total in added(batches, ("net",), lambda batch, i: np.frombuffer(batch.column("sums")[i].as_buffer())):
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["net", "sums"])

    kind = "net int, sums binary"
    found = rows.mapInArrow(add, kind).repartition("net").sortWithinPartitions("net").mapInArrow(meet, kind).toArrow()
    held = {m: np.frombuffer(v) for m, v in zip(found["net"].to_pylist(), found["sums"].to_pylist())}
    out = {}
    for m, (_, _, theta) in nets.items():
        n = len(theta)
        values = held.get(m, np.zeros(1 + n + n * (n + 1) // 2))
        matrix = np.zeros((n, n))
        matrix[np.triu_indices(n)] = values[1 + n:]
        out[m] = values[0], values[1:n + 1], matrix + np.triu(matrix, 1).T
    return out


def penalised(sums: tuple, theta: np.ndarray, decay: float) -> tuple:
    """The sums with ``decay`` times the squared coefficients added to the loss."""
    loss, gradient, matrix = sums
    return loss + decay * theta @ theta, gradient + 2 * decay * theta, matrix + 2 * decay * np.eye(len(theta))


def fit_networks(df: DataFrame, predictors: Sequence[str], nets: Sequence[Net], max_iter: int = 100) -> tuple[dict, list[np.ndarray]]:
    """Mean and spread of the predictors, and the coefficients of every network.

    Steps are damped Gauss-Newton steps; each pass over the stored rows tries one step of every network
    that is not done. Rows with a missing label or predictor are refused.
    """
    check_predictors(df, predictors)
    moments = standard(df, predictors)
    weights = list(dict.fromkeys((n.bag_seed, n.held) for n in nets))
    gaps = df.where(F.col(LABEL).isNull() | F.greatest(*[F.col(p).isNull() for p in predictors], F.lit(False))).limit(1).count()
    if gaps:
        raise ValueError("labels and predictors must be complete")
    rows = checkpointed(df.select(
        F.col(LABEL).cast("double").alias("y"), *_scaled(predictors, moments),
        *[Net(bag_seed=b, held=h).weight().alias(f"w{i}") for i, (b, h) in enumerate(weights)]))
    inputs = len(predictors)

    def judged(tried: dict[int, np.ndarray]) -> dict[int, tuple]:
        asked = {m: (weights.index((nets[m].bag_seed, nets[m].held)), nets[m].size, t) for m, t in tried.items()}
        return {m: penalised(s, tried[m], nets[m].decay) for m, s in network_sums(rows, inputs, asked).items()}

    best = {m: net.start(inputs) for m, net in enumerate(nets)}
    state, damping, going = judged(best), dict.fromkeys(best, 1.0), set(best)
    for _ in range(max_iter):
        if not going:
            break
        tried = {m: best[m] - np.linalg.solve(state[m][2] + damping[m] * np.eye(len(best[m])), state[m][1]) for m in sorted(going)}
        for m, found in judged(tried).items():
            gained = state[m][0] - found[0]
            if gained > 0:
                best[m], state[m], damping[m] = tried[m], found, max(damping[m] / 10, 1e-6)
                if gained <= CLOSE * (abs(found[0]) + 1):
                    going.discard(m)
            else:
                damping[m] *= 10
                if damping[m] > MOST_DAMPING:
                    going.discard(m)
    return moments, [best[m] for m in range(len(nets))]


def _scaled(predictors: Sequence[str], moments: dict) -> list[Column]:
    return [((F.col(p).cast("double") - moments[p][0]) / moments[p][1]).alias(f"x{i}") for i, p in enumerate(predictors)]


def _scores(df: DataFrame, predictors: Sequence[str], moments: dict, groups: list[list[tuple[int, np.ndarray]]]) -> DataFrame:
    """``df`` with ``__scores``: the mean probability of each group of networks."""
    @F.pandas_udf("array<double>")
    def score(x):
        values = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(predictors)))
        values = np.column_stack([np.ones(len(values)), values])
        out = [np.mean([1 / (1 + np.exp(-forward(t, size, values)[1])) for size, t in group], axis=0) for group in groups]
        return pd.Series(list(np.column_stack(out)))

    return df.withColumn("__scores", score(F.array(*_scaled(predictors, moments))))


def network_average(predictors: Sequence[str], size: int = 2, decay: float = 0.33, networks: int = 5, bag: bool = True,
                    max_iter: int = 100) -> Fit:
    """The mean probability of networks that differ in their first coefficients and bootstrap sample."""
    def fit(train: DataFrame) -> Scorer:
        nets = members(size, decay, networks, bag)
        moments, found = fit_networks(train, predictors, nets, max_iter)
        group = [(size, t) for t in found]

        def score(df: DataFrame) -> DataFrame:
            return _scores(df, predictors, moments, [group]).withColumn("score", F.get("__scores", F.lit(0))).select(*df.columns, "score")

        return score

    return fit


def members(size: int, decay: float, networks: int, bag: bool = True, held: int | None = None) -> list[Net]:
    return [Net(size, decay, 8 + i, 7919 * (i + 1) if bag else None, held) for i in range(networks)]


def network_grid(rows: DataFrame, predictors: Sequence[str], sizes: Sequence[int], decays: Sequence[float], folds: int,
                 networks: int = 5, max_iter: int = 100) -> DataFrame:
    """``size``, ``decay``, ``fold`` and the area under the curve on the rows of that fold, for every setting.

    ``rows`` has a ``fold`` in ``0..folds-1``. The networks of all settings and folds share each pass.
    """
    settings = [(s, d) for s in sizes for d in decays]
    nets = [n for f in range(folds) for s, d in settings for n in members(s, d, networks, held=f)]
    moments, found = fit_networks(rows, predictors, nets, max_iter)
    tables = []
    for f in range(folds):
        own = [(n.size, t) for n, t in zip(nets, found) if n.held == f]
        groups = [own[i:i + networks] for i in range(0, len(own), networks)]
        scored = _scores(rows.where(F.col("fold") == f), predictors, moments, groups)
        scored = checkpointed(scored.select(LABEL, *[F.get("__scores", F.lit(i)).alias(f"s{i}") for i in range(len(groups))]))
        tables.append(roc_auc(scored, LABEL, [f"s{i}" for i in range(len(groups))]).withColumn("fold", F.lit(f)))
    names = rows.sparkSession.createDataFrame([(f"s{i}", s, float(d)) for i, (s, d) in enumerate(settings)], "model string, size int, decay double")
    return union_all(*tables).join(names, "model").select("size", "decay", "fold", "auc")
