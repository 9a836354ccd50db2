"""Random forests whose bags come from a hash of the key, tuned by out-of-bag votes.

Who is in the bag of a tree can be computed again for any row, so the rows that a tree did not see judge it, and
no fold is fitted. All trees of all settings grow together, level by level. What a task holds, and what
reaches the driver, depends on the number of open nodes and not on the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from acctrisk.models import boosting
from acctrisk.models.base import Fit, Scorer, check_predictors
from acctrisk.models.boosting import BINS
from acctrisk.sources.schemas import KEY, LABEL

#: Counts that a task holds at most; further open nodes go to further jobs.
CELLS = 16_000_000

#: A Poisson count is above ``k`` where a uniform number reaches the ``k``-th of these.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def bag(keys: np.ndarray, tree: int, seed: int = 8) -> np.ndarray:
    """How often each row is in the bag of a tree: a Poisson count of mean 1. Out of the bag are rows of count 0."""
    return np.searchsorted(_POISSON, boosting._uniform(keys, seed * 1_000_003 + tree), side="right")


@dataclass
class Grown:
    """Tree ``number`` of the setting ``per_split``; nodes are numbered as in a heap, ``counts`` are rows of class 0 and 1."""

    per_split: int
    number: int
    splits: dict[int, tuple[int, int]] = field(default_factory=dict)  # predictor, last bin that goes left
    counts: dict[int, tuple[int, int]] = field(default_factory=dict)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """As those of a boosted tree; the value of a node is its share of class 1."""
        size = 1 + max([0, *self.counts])
        predictor, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        for n, (p, c) in self.splits.items():
            predictor[n], cut[n] = p, c
        for n, (zeros, ones) in self.counts.items():
            value[n] = ones / max(zeros + ones, 1)
        return predictor, cut, value, max((n + 1).bit_length() for n in (0, *self.splits))


def drawn_predictors(usable: Sequence[int], per_split: int, tree: int, node: int, seed: int = 8) -> list[int]:
    """The predictors that a node may split on."""
    random = np.random.default_rng([seed, per_split, tree, node])
    return sorted(random.choice(list(usable), min(per_split, len(usable)), replace=False).tolist())


def _counts(rows: DataFrame, work: list[tuple], seed: int) -> DataFrame:
    """Rows of class 0 and 1 per open node, drawn predictor and bin, one row per node and task.

    ``work`` has for each tree its position, number, arrays, open nodes and their predictors.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((2, nodes.size * drawn.shape[1] * BINS), np.int32) for _, _, _, nodes, drawn in work]
        numbers: dict[int, list[int]] = {}  # trees of several settings share a bag
        for i, (_, number, *_) in enumerate(work):
            numbers.setdefault(number, []).append(i)
        for block in boosting.joined(batches):
            for number, members in numbers.items():
                weight = bag(block.key, number, seed)
                use = np.flatnonzero(weight)
                x, y = block.x[:, use], block.y[use]
                weight, ones, flat = weight[use], y == 1, x.ravel()
                counted = ones | (y == 0)
                for i in members:
                    _, _, tree, nodes, drawn = work[i]
                    places = np.full(max(len(tree[0]), int(nodes[-1]) + 1), -1)
                    places[nodes] = np.arange(nodes.size)
                    place = places.take(boosting._nodes(tree, x))
                    inside = np.flatnonzero((place >= 0) & counted)
                    place = place[inside]
                    width, times, own = drawn.shape[1], weight[inside], held[i].reshape(-1)
                    first = place * (width * BINS) + ones[inside] * held[i].shape[1]
                    for j in range(width):
                        at = first + j * BINS + flat.take(drawn[:, j].take(place) * use.size + inside)
                        if at.size * 4 < own.size:
                            np.add.at(own, at, times.astype(np.int32))
                        else:
                            own += np.bincount(at, times, own.size).astype(np.int32)
        for own, (position, _, _, nodes, drawn) in zip(held, work):
            step = drawn.shape[1] * BINS
            lists = [pa.ListArray.from_arrays(np.arange(nodes.size + 1, dtype=np.int32) * step, pa.array(a)) for a in own]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(nodes.size, position, np.int32)), pa.array(nodes.astype(np.int32)), *lists],
                                             names=["tree", "node", "zeros", "ones"])

    return rows.mapInArrow(add, "tree int, node int, zeros array<int>, ones array<int>")


def best_cut(zeros: np.ndarray, ones: np.ndarray) -> tuple[float, int, int, int, int]:
    """The cut with the greatest fall of the Gini impurity, times the rows: fall, place among predictors, bin, counts left.

    ``zeros`` and ``ones`` have a row per predictor. Of equal cuts the first counts; a fall of 0 is no cut.
    """
    left0, left1 = zeros.cumsum(axis=1, dtype=np.int64), ones.cumsum(axis=1, dtype=np.int64)
    all0, all1 = left0[:, -1:], left1[:, -1:]
    right0, right1 = all0 - left0, all1 - left1

    def pure(a, b):
        return (a * a + b * b) / np.maximum(a + b, 1)

    fall = pure(left0, left1) + pure(right0, right1) - pure(all0, all1)
    fall = np.where((left0 + left1 > 0) & (right0 + right1 > 0), fall, 0.0)
    j, k = np.unravel_index(int(np.argmax(fall)), fall.shape)
    return float(fall[j, k]), int(j), int(k), int(left0[j, k]), int(left1[j, k])


def _best(counts: DataFrame) -> list:
    """One row per open node: its counts and its best cut. The counts of the tasks meet by node, in as many tasks as Spark's shuffle has."""
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = None, None
        out: list[tuple] = []

        def settle():
            zeros, ones = (s.reshape(-1, BINS) for s in sums)
            out.append((*held, int(zeros[0].sum()), int(ones[0].sum()), *best_cut(zeros, ones)))

        for batch in batches:
            tree, node = (batch.column(c).to_numpy() for c in ("tree", "node"))
            for i in range(batch.num_rows):
                found = [batch.column(c)[i].values.to_numpy() for c in ("zeros", "ones")]
                if held == (tree[i], node[i]):
                    sums = [a + b for a, b in zip(sums, found)]
                else:
                    if held is not None:
                        settle()
                    held, sums = (tree[i], node[i]), found
        if held is not None:
            settle()
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in
                                          ((int(t), int(n), *rest) for t, n, *rest in out)], schema)

    kind = "tree int, node int, zeros long, ones long, fall double, place int, cut int, left0 long, left1 long"
    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[t]) for n, t in (c.split() for c in kind.split(", "))])
    return counts.repartition("tree", "node").sortWithinPartitions("tree", "node").mapInArrow(choose, kind).collect()


def _chunks(trees: list[Grown], frontier: dict[int, list[int]], usable: Sequence[int], seed: int) -> Iterator[list[tuple]]:
    """The open nodes in parts that a task can hold."""
    part, size = [], 0
    for i, open_ in frontier.items():
        tree = trees[i]
        nodes = np.array(sorted(open_))
        width = min(tree.per_split, len(usable))
        most = max(1, CELLS // (2 * width * BINS))
        for a in range(0, nodes.size, most):
            some = nodes[a:a + most]
            cells = 2 * some.size * width * BINS
            if part and size + cells > CELLS:
                yield part
                part, size = [], 0
            drawn = np.array([drawn_predictors(usable, tree.per_split, tree.number, n, seed) for n in some.tolist()])
            part.append((i, tree.number, tree.arrays(), some, drawn))
            size += cells
    if part:
        yield part


def grow(rows: DataFrame, cuts: list[list[float]], per_split: Sequence[int], trees: int = 100, min_rows: int = 2,
         max_depth: int = 10, seed: int = 8) -> list[Grown]:
    """``trees`` trees for each number of predictors per split, from the stored bins of :func:`boosting.binned`."""
    if not 1 <= max_depth <= 12:
        raise ValueError("trees have 1 to 12 levels")
    if min(per_split, default=0) < 1:
        raise ValueError("a split needs at least one predictor")
    usable = [j for j, c in enumerate(cuts) if c] or [0]  # with one value in all predictors, the root is counted and stays a leaf
    grown = [Grown(m, t) for m in per_split for t in range(trees)]
    frontier = {i: [0] for i in range(len(grown))}
    for depth in range(max_depth):
        following: dict[int, list[int]] = {}
        for work in _chunks(grown, frontier, usable, seed):
            drawn = {i: dict(zip(nodes.tolist(), d.tolist())) for i, _, _, nodes, d in work}
            for r in _best(_counts(rows, work, seed)):
                tree = grown[r.tree]
                tree.counts[r.node] = r.zeros, r.ones
                if r.fall <= 1e-9 or r.zeros + r.ones < min_rows:
                    continue
                tree.splits[r.node] = drawn[r.tree][r.node][r.place], r.cut
                for child, counts in ((2 * r.node + 1, (r.left0, r.left1)), (2 * r.node + 2, (r.zeros - r.left0, r.ones - r.left1))):
                    tree.counts[child] = counts
                    if min(counts) and sum(counts) >= min_rows and depth + 1 < max_depth:
                        following.setdefault(r.tree, []).append(child)
        frontier = following
    return grown


def oob_votes(rows: DataFrame, grown: Sequence[Grown], seed: int = 8) -> DataFrame:
    """Per row and setting: ``votes`` of the trees that did not see the row, and those of class 1 (``ones``); a leaf of equal counts says 0."""
    settings = sorted({t.per_split for t in grown})
    numbers: dict[int, list[tuple]] = {}  # trees of several settings share a bag
    for t in grown:
        numbers.setdefault(t.number, []).append((settings.index(t.per_split), t.arrays()))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in boosting.blocks(batches):
            key, y = block.key, block.y
            votes, ones = np.zeros((2, len(settings), len(key)), np.int64)
            for number, members in numbers.items():
                out = np.flatnonzero(bag(key, number, seed) == 0)
                x = block.x[:, out]
                for s, tree in members:
                    votes[s, out] += 1
                    ones[s, out] += tree[2][boosting._nodes(tree, x)] > 0.5
            for s, m in enumerate(settings):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(y), pa.array(np.full(len(key), m, np.int32)), pa.array(votes[s]), pa.array(ones[s])],
                                                 names=[KEY, LABEL, "per_split", "votes", "ones"])

    return rows.mapInArrow(vote, f"{KEY} long, `{LABEL}` double, per_split int, votes long, ones long")


def oob_errors(votes: DataFrame, trees: int) -> DataFrame:
    """Per setting: ``n_rows``, ``n_judged`` (with a vote), the mean share of trees out of whose bag a row is, and the error of the vote.

    Equal votes say 0.
    """
    judged = F.col("votes") > 0
    wrong = judged & ((2 * F.col("ones") > F.col("votes")) != (F.col(LABEL) == 1))
    return votes.groupBy("per_split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(judged.cast("long")).alias("n_judged"),
        (F.avg("votes") / trees).alias("oob_share"),
        F.try_divide(F.sum(wrong.cast("long")), F.sum(judged.cast("long"))).alias("oob_error"))


def tune(df: DataFrame, predictors: Sequence[str], per_split: Sequence[int] = range(2, 11), trees: int = 100, min_rows: int = 2,
         max_depth: int = 10, seed: int = 8) -> tuple[list[Grown], DataFrame, list[list[float]]]:
    """The trees of all settings, the :func:`oob_votes`, and the cuts of the bins."""
    check_predictors(df, predictors)
    cuts = boosting.bin_cuts(df, predictors)
    rows = boosting.binned(df, predictors, cuts, 1, F.lit(0))
    grown = grow(rows, cuts, per_split, trees, min_rows, max_depth, seed)
    return grown, oob_votes(rows, grown, seed), cuts


def oob_table(df: DataFrame, predictors: Sequence[str], per_split: Sequence[int] = range(2, 11), trees: int = 100, **options) -> DataFrame:
    """Out-of-bag error per number of predictors tried at a split."""
    return oob_errors(tune(df, predictors, per_split, trees, **options)[1], trees)


def tuned_forest(predictors: Sequence[str], per_split: Sequence[int] = range(2, 11), trees: int = 100, **options) -> Fit:
    """The forest whose number of predictors per split has the least out-of-bag error, of equal ones the least; scores are mean shares of class 1."""
    def fit(train: DataFrame) -> Scorer:
        grown, votes, cuts = tune(train, predictors, per_split, trees, **options)
        errors = {r.per_split: r.oob_error for r in oob_errors(votes, trees).collect()}
        best = min(errors, key=lambda m: (errors[m] if errors[m] is not None else math.inf, m)) if errors else per_split[0]
        own = [t.arrays() for t in grown if t.per_split == best]
        edges = [np.array(c) for c in cuts]

        @F.pandas_udf("double")
        def share(*columns: pd.Series) -> pd.Series:
            x = np.stack([np.searchsorted(e, c.to_numpy()) for e, c in zip(edges, columns)])
            return pd.Series(np.mean([t[2][boosting._nodes(t, x)] for t in own], axis=0))

        def score(df: DataFrame) -> DataFrame:
            return df.withColumn("score", share(*[F.col(p) for p in predictors]))

        return score

    return fit
