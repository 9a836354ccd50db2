"""A classification tree grown on binned predictors and pruned by cost and complexity."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from acctrisk.models import boosting
from acctrisk.models.base import Fit, Scorer, check_predictors
from acctrisk.sources.schemas import LABEL


def _settings(min_split: int, max_depth: int) -> boosting.Settings:
    """With equal margins the second-order gain is four times the fall of the squared error, so it ranks cuts as the Gini index does."""
    return boosting.Settings(rounds=1, step=1.0, max_depth=max_depth, min_loss=0.0, min_hessian=round(min_split / 3) / 4, rows=1.0, columns=1.0, l2=0.0)


def counts(tree: boosting.Tree, node: int) -> tuple[float, float]:
    """Rows of class 0 and 1 in a node: a row has gradient 0.5 less its label, and Hessian 0.25."""
    g, h = tree.sums[node]
    return round(2 * h + g), round(2 * h - g)


def _below(splits, node: int) -> list[int]:
    """The splits of the branch at a node."""
    return [] if node not in splits else [node, *_below(splits, 2 * node + 1), *_below(splits, 2 * node + 2)]


def sequence(tree: boosting.Tree) -> list[tuple[float, frozenset]]:
    """Nested subtrees by weakest link, the full tree first: the least complexity at which each is best, and its splits.

    The cost of a leaf are the rows outside its larger class. The link whose branch saves least per
    further leaf is cut first, together with all others that save as little.
    """
    errors = {n: min(counts(tree, n)) for n in tree.sums}
    splits, out, alpha = set(tree.splits), [], 0.0
    while True:
        def saved(node):
            branch = _below(splits, node)
            leaves = [c for n in branch for c in (2 * n + 1, 2 * n + 2) if c not in splits]
            return (errors[node] - sum(errors[c] for c in leaves)) / len(branch)

        weak = {n: saved(n) for n in splits}
        while weak and min(weak.values()) <= alpha:  # branches that save nothing more go before the subtree counts
            for n in [n for n, s in weak.items() if s <= alpha]:
                splits -= set(_below(splits, n))
            weak = {n: saved(n) for n in splits}
        out.append((alpha, frozenset(splits)))
        if not splits:
            return out
        alpha = min(weak.values())


def at_complexity(steps: list[tuple[float, frozenset]], alpha: float) -> frozenset:
    """The splits of the subtree that is best at a complexity."""
    return [splits for least, splits in steps if least <= alpha][-1]


def _grown(rows: DataFrame, cuts: list[list[float]], helds: Sequence[int | None], min_split: int, max_depth: int) -> list[boosting.Tree]:
    """One tree for each held-out fold, all in the same jobs; nodes of less than ``min_split`` rows stay leaves."""
    models = {i: boosting.Model(_settings(min_split, max_depth), held) for i, held in enumerate(helds)}
    trees = boosting._grow(rows, models, [], [len(c) for c in cuts], 0, 8)
    for tree in trees.values():
        for node in sorted(tree.splits):
            if node and (node - 1) // 2 not in tree.splits or sum(counts(tree, node)) < min_split:
                del tree.splits[node]
    return list(trees.values())


def _subtree(tree: boosting.Tree, splits: frozenset) -> tuple:
    """The arrays of a subtree, whose leaves have the share of class 1 as value."""
    own = boosting.Tree({n: tree.splits[n] for n in splits})
    leaves = {c for n in splits for c in (2 * n + 1, 2 * n + 2) if c not in splits} or {0}
    own.values = {n: counts(tree, n)[1] / max(sum(counts(tree, n)), 1) for n in leaves if n in tree.sums}
    return own.arrays()


def complexity_table(df: DataFrame, predictors: Sequence[str], folds: int, cp: float = 0.001, min_split: int = 100, max_depth: int = 10) -> DataFrame:
    """For each subtree of the sequence down to ``cp``: ``cp``, ``n_splits``, ``rel_error``, ``xerror`` and ``xstd``.

    Errors are relative to those of the root. ``df`` has a ``fold`` column; trees of all folds grow
    together, and one pass counts the held-out errors of all their subtrees, each taken at the
    geometric mean of neighbouring complexities.
    """
    check_predictors(df, predictors)
    cuts = boosting.bin_cuts(df, predictors)
    rows = boosting.binned(df, predictors, cuts, folds + 1, F.col("fold"))
    whole, *parts = _grown(rows, cuts, [None, *range(folds)], min_split, max_depth)
    if not whole.sums:
        return df.sparkSession.createDataFrame([], "cp double, n_splits int, rel_error double, xerror double, xstd double")
    root, total = min(counts(whole, 0)), sum(counts(whole, 0))
    steps = [s for s in sequence(whole)]
    kept = [(a, s) for i, (a, s) in enumerate(steps) if i + 1 == len(steps) or steps[i + 1][0] > cp * root]
    tops = [b for b, _ in kept[1:]] + [math.inf]
    means = [math.sqrt(max(a, cp * root) * b) for (a, _), b in zip(kept, tops)]
    # A fold's tree has fewer rows, and complexities in proportion.
    subtrees = [[_subtree(t, at_complexity(sequence(t), m * (sum(counts(t, 0)) / total if math.isfinite(m) else 1))) for m in means] for t in parts]

    def count(batches):
        wrong = np.zeros(len(means), np.int64)
        for block in boosting.blocks(batches):
            for f, trees in enumerate(subtrees):
                own = block.fold == f
                x, y = block.x[:, own], block.y[own]
                for k, tree in enumerate(trees):
                    wrong[k] += int(np.sum((tree[2][boosting._nodes(tree, x)] > 0.5) != (y == 1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(wrong), dtype=np.int32)), pa.array(wrong)], names=["k", "wrong"])

    wrong = {r.k: r.wrong for r in rows.mapInArrow(count, "k int, wrong long").groupBy("k").agg(F.sum("wrong").alias("wrong")).collect()}
    out = []
    for k, (alpha, splits) in enumerate(kept):
        leaves = [c for n in splits for c in (2 * n + 1, 2 * n + 2) if c not in splits] or [0]
        error = sum(min(counts(whole, c)) for c in leaves)
        share = wrong[k] / total
        scale = max(root, 1)
        out.append((max(alpha / scale, cp), len(splits), error / scale, wrong[k] / scale, math.sqrt(total * share * (1 - share)) / scale))
    return df.sparkSession.createDataFrame(out, "cp double, n_splits int, rel_error double, xerror double, xstd double")


def pruned_tree(predictors: Sequence[str], cp: float = 0.001, min_split: int = 100, max_depth: int = 10) -> Fit:
    """A tree whose every split lowers the errors by ``cp`` of the root's; scores are shares of class 1 in the leaves."""

    def fit(train: DataFrame) -> Scorer:
        check_predictors(train, predictors)
        cuts = boosting.bin_cuts(train, predictors)
        tree, = _grown(boosting.binned(train, predictors, cuts, 1, F.lit(0)), cuts, [None], min_split, max_depth)
        if tree.sums:
            own = _subtree(tree, at_complexity(sequence(tree), cp * min(counts(tree, 0))))
        else:  # no predictor has two values
            share = train.agg(F.avg(LABEL)).first()[0]
            own = (np.array([-1]), np.array([0]), np.array([share or 0.0]), 0)
        edges = [np.array(c) for c in cuts]

        @F.pandas_udf("double")
        def share(*columns: pd.Series) -> pd.Series:
            x = np.stack([np.searchsorted(e, c.to_numpy()) for e, c in zip(edges, columns)])
            return pd.Series(own[2][boosting._nodes(own, x)])

        def score(df: DataFrame) -> DataFrame:
            return df.withColumn("score", share(*[F.col(p) for p in predictors]))

        return score

    return fit
