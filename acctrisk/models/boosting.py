"""Second-order boosting of trees on binned predictors, many models at once.

A round of all models takes one job per level of their trees. Rows are stored as blocks of bin numbers, one
line per predictor. A task adds up gradients and Hessians of its rows per model, node, predictor and bin; the
sums of the tasks meet by node, and one row per open node reaches the driver. So what leaves a task, and what
reaches the driver, depends on the models and not on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from acctrisk.functions.hashing import uniform
from acctrisk.models.base import Fit, Scorer, added, check_predictors
from acctrisk.session import checkpointed
from acctrisk.sources.schemas import KEY, LABEL

#: Bins of a predictor, rounds between two stored tables, and steps of a score in the area under its curve.
BINS, STORED_ROUNDS, SCORE_STEPS = 64, 10, 4096

#: Rows of a stored block, bytes of a partition of blocks, and rows for which another partition pays.
BLOCK_ROWS, PART_BYTES, PART_ROWS = 10_000, 32 << 20, 25_000

#: Bytes of the sums of all tasks up to which they are added at the driver, which saves a shuffle.
DRIVER_BYTES = 8 << 20

#: Splits up to which rows are sent down a tree split by split, by comparing whole lines.
FEW_SPLITS = 100


@dataclass(frozen=True)
class Settings:
    """``min_loss`` is the least loss that a split removes, ``min_hessian`` the least Hessian sum of a child."""

    rounds: int = 300
    step: float = 0.05
    max_depth: int = 9
    min_loss: float = 0.1
    min_hessian: float = 100.0
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    stop: int = 0  # rounds without a better area on the held-out rows; 0: never

    def __post_init__(self):
        if not 0 < self.step <= 1:
            raise ValueError("the learning rate must be in (0, 1]")
        if self.max_depth > 12:
            raise ValueError("trees have at most 12 levels")


@dataclass
class Tree:
    """Nodes are numbered as in a heap: the children of ``i`` are ``2 * i + 1`` and ``2 * i + 2``."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)  # predictor, last bin that goes left
    sums: dict[int, tuple[float, float]] = field(default_factory=dict)  # gradients and Hessians
    gains: dict[int, float] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def prune(self, min_loss: float) -> None:
        """Last splits that remove less than ``min_loss`` go, and then those above them."""
        for node in sorted(self.splits, reverse=True):
            if 2 * node + 1 not in self.splits and 2 * node + 2 not in self.splits and self.gains[node] < min_loss:
                del self.splits[node], self.gains[node]

    def settle(self, settings: Settings) -> None:
        self.prune(settings.min_loss)
        live = {0} | {c for n in self.splits for c in (2 * n + 1, 2 * n + 2)}
        self.sums = {n: s for n, s in self.sums.items() if n in live}
        self.values = {n: -settings.step * g / (h + settings.l2) for n, (g, h) in self.sums.items() if n not in self.splits}

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        size = 1 + max([0, *(2 * n + 2 for n in self.splits), *self.values])
        predictor, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        for n, (p, c) in self.splits.items():
            predictor[n], cut[n] = p, c
        for n, v in self.values.items():
            value[n] = v
        return predictor, cut, value, max((n + 1).bit_length() for n in (0, *self.splits))


def _nodes(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The node in which each row ends; ``x`` has a line per predictor."""
    predictor, cut, _, depth = tree
    n = x.shape[1]
    inner = np.flatnonzero(predictor >= 0).tolist()
    if len(inner) <= FEW_SPLITS:
        kind = np.uint8 if len(predictor) < 256 else np.uint16
        node, reach = np.zeros(n, kind), {0: np.ones(n, bool)}
        for i in inner:  # parents come first
            here = reach.pop(i, None)
            if here is None:
                continue
            right = here & (x[predictor[i]] > cut[i])
            node += here * kind(i + 1)
            node += right
            reach[2 * i + 1], reach[2 * i + 2] = here ^ right, right
        return node
    node, rows, flat = np.zeros(n, np.int64), np.arange(n), np.ascontiguousarray(x).ravel()
    for _ in range(depth):
        p = predictor.take(node)
        on = p >= 0
        node = np.where(on, 2 * node + 1 + (flat.take(np.where(on, p, 0) * n + rows) > cut.take(node)), node)
    return node


def _uniform(keys: np.ndarray, seed: int) -> np.ndarray:
    """A repeatable number in [0, 1) for each key."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h >> np.uint64(11)).astype(float) / (1 << 53)


def _drawn(keys: np.ndarray, seed: int, share: float) -> np.ndarray:
    """A repeatable sample of rows by key."""
    return np.ones(len(keys), bool) if share >= 1 else _uniform(keys, seed) < share


@dataclass
class Model:
    """What is fitted: the rows outside fold ``held``, all rows where that is missing."""

    settings: Settings
    held: int | None = None
    trees: list[Tree] = field(default_factory=list)
    areas: list[tuple[float | None, float | None]] = field(default_factory=list)  # of training and held-out rows

    def trains(self, fold: np.ndarray) -> np.ndarray:
        return np.ones(len(fold), bool) if self.held is None else fold != self.held


def bin_cuts(df: DataFrame, predictors: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """At most ``bins - 1`` distinct quantiles of each predictor, below its maximum; a bin ends with its cut."""
    found = df.approxQuantile(list(predictors), [i / bins for i in range(1, bins)], 0.001)
    tops = df.agg(*[F.max(p) for p in predictors]).first()
    return [sorted({c for c in cuts if c < top}) for cuts, top in zip(found, tops)]


def binned(df: DataFrame, predictors: Sequence[str], cuts: list[list[float]], models: int, fold: Column) -> DataFrame:
    """Stored blocks of rows: keys, labels, folds, bin numbers ``x`` and a ``margin`` of 0 per model.

    The number of partitions follows the bytes, so that a task may hold the blocks of its partition.
    """
    edges = [np.array(c) for c in cuts]

    def place(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(start, BLOCK_ROWS)
                x = np.stack([np.searchsorted(e, batch.column(p).to_numpy(zero_copy_only=False)) for p, e in zip(predictors, edges)])
                yield _block(Block(
                    x.astype(np.uint8), np.zeros((models, batch.num_rows)), batch.column(LABEL).to_numpy(zero_copy_only=False).astype(float),
                    batch.column("fold").fill_null(-1).to_numpy().astype(np.int32),
                    batch.column(KEY).cast(pa.int64()).fill_null(-1 << 63).to_numpy()))

    rows = df.select(KEY, F.col(LABEL).cast("double").alias(LABEL), fold.cast("int").alias("fold"), *predictors)
    count = df.count()
    bytes_ = count * (len(predictors) + 8 * models + 20)
    parts = max(1, -(-bytes_ // PART_BYTES), min(df.sparkSession.sparkContext.defaultParallelism, count // PART_ROWS))
    return checkpointed(rows.repartition(parts).mapInArrow(place, ", ".join(f"{c} binary" for c in PARTS)))


@dataclass
class Block:
    """``x`` has a line per predictor, ``margin`` one per model; a missing label is NaN, a missing fold -1."""

    x: np.ndarray
    margin: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    key: np.ndarray


#: Columns of the stored blocks.
PARTS = {"x": np.uint8, "margin": np.float64, "y": np.float64, "fold": np.int32, "key": np.int64}


def _block(block: Block) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(getattr(block, c)).tobytes()], pa.binary()) for c in PARTS], names=list(PARTS))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            x, margin, y, fold, key = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in PARTS.items())
            yield Block(x.reshape(-1, len(key)), margin.reshape(-1, len(key)).copy(), y, fold, key)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """All rows of a partition as one block, if there are any."""
    found = list(blocks(batches))
    if found:
        yield Block(*(np.concatenate([getattr(b, c) for b in found], axis=-1) for c in PARTS))


def _advance(x: np.ndarray, margin: dict[int, np.ndarray], since: list[dict[int, tuple]]) -> Iterator[None]:
    """Moves the margins of some models on, round by round."""
    for trees in since:
        for m, tree in trees.items():
            if m in margin:
                margin[m] += tree[2].take(_nodes(tree, x))
        yield


def cut_sums(rows: DataFrame, tasks: dict[int, dict], since: list[dict[int, tuple]], seed: int) -> DataFrame:
    """Per model and node the ``sums`` of gradients and Hessians by predictor and bin, one row per task.

    ``tasks`` has for each model its settings, held-out fold, partial tree, open nodes and predictors.
    """
    def add(batches):
        held = {m: np.zeros((len(t["predictors"]), 2, len(t["open"]) * BINS)) for m, t in tasks.items()}
        alike: dict[tuple, list[int]] = {}  # models that use the same rows
        for m, t in tasks.items():
            alike.setdefault((t["share"], t["held"]), []).append(m)
        places = {}
        for m, t in tasks.items():
            places[m] = np.full(2 * max(len(t["tree"][0]), int(t["open"][-1]) + 1) + 1, -1)
            places[m][t["open"]] = np.arange(len(t["open"]))
        for block in blocks(batches):
            for (share, out), members in alike.items():
                use = np.flatnonzero(_drawn(block.key, seed, share) & ((block.fold != out) if out is not None else True))
                x, y = block.x[:, use], block.y[use]
                margin = {m: block.margin[m, use] for m in members}
                for _ in _advance(x, margin, since):
                    pass
                for m in members:
                    t = tasks[m]
                    place = places[m].take(_nodes(t["tree"], x))
                    inside = np.flatnonzero(place >= 0)
                    p = 1 / (1 + np.exp(-margin[m][inside]))
                    weights = p - y[inside], p * (1 - p)
                    place = place[inside] * BINS
                    for j, f in enumerate(t["predictors"]):
                        at = place + x[f, inside]
                        for k, w in enumerate(weights):
                            held[m][j, k] += np.bincount(at, w, len(t["open"]) * BINS)
        for m, t in tasks.items():
            n = len(t["open"])
            sums = held[m].reshape(-1, 2, n, BINS).transpose(2, 1, 0, 3)
            some = np.flatnonzero(sums[:, 1].any(axis=(1, 2)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), m, np.int32)), pa.array(t["open"][some].astype(np.int32)), pa.array([sums[i].tobytes() for i in some], pa.binary())],
                names=["model", "node", "sums"])

    return rows.mapInArrow(add, "model int, node int, sums binary")


def _together(sums: DataFrame) -> DataFrame:
    return sums.repartition("model", "node").sortWithinPartitions("model", "node")


def _left_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Model, node, and sums left of every cut, by kind, predictor and bin."""
    read = lambda batch, i: np.frombuffer(batch.column("sums")[i].as_buffer())
    for (model, node), total in added(batches, ("model", "node"), read):
        yield model, node, total.reshape(2, -1, BINS).cumsum(axis=2)


def removed_loss(gl, hl, g, h, l2: float = 1.0):
    """Twice the loss that a cut removes; of numbers, arrays or columns."""
    part = lambda g, h: g * g / (h + l2)
    return part(gl, hl) + part(g - gl, h - hl) - part(g, h)


def first_gains(rows: DataFrame, predictors: Sequence[str], cuts: list[list[float]], l2: float = 1.0) -> DataFrame:
    """Every cut of the first tree's root: ``predictor``, ``cut``, the sums left of it and the ``gain``."""
    check_predictors(rows, predictors)
    used = [j for j, c in enumerate(cuts) if c]

    def table(batches):
        for _, _, left in _left_sums(batches):
            for j, f in enumerate(used):
                n = len(cuts[f])
                gl, hl = left[:, j, :n]
                gain = removed_loss(gl, hl, *left[:, j, -1], l2)
                yield pa.RecordBatch.from_arrays([pa.array([predictors[f]] * n, pa.string()), *map(pa.array, (np.array(cuts[f], float), gl, hl, gain))],
                                                 names=["predictor", "cut", "gl", "hl", "gain"])

    root = {0: {"share": 1.0, "held": None, "tree": Tree().arrays(), "open": np.array([0]), "predictors": used}}
    sums = cut_sums(binned(rows, predictors, cuts, 1, F.lit(1)), root, [], 0)
    return _together(sums).mapInArrow(table, "predictor string, cut double, gl double, hl double, gain double")


def _best(sums: DataFrame, tasks: dict[int, dict], settings: dict[int, Settings], cuts: list[int], parts: int) -> list[tuple]:
    """``model``, ``node``, sums, and the best cut of every node: of equal ones that of the first predictor and bin.

    The sums of ``parts`` tasks are added at the driver if they are small, else by node in the tasks of a shuffle.
    """
    predictors = {m: np.array(t["predictors"]) for m, t in tasks.items()}
    names = ["model", "node", "splits", "gain", "predictor", "cut", "gl", "hl", "g", "h"]

    def choose(batches):
        out = []
        for model, node, (gl, hl) in _left_sums(batches):
            own, given = predictors[model], settings[model]
            g, h = gl[:, -1:], hl[:, -1:]
            with np.errstate(invalid="ignore", divide="ignore"):  # an empty child, without an L2 term
                gain = removed_loss(gl, hl, g, h, given.l2)
            gain = np.where((np.arange(BINS) < np.array(cuts)[own][:, None]) & (h != 0) & ~np.isnan(gain), gain, -np.inf)
            splits = (hl >= given.min_hessian) & (h - hl >= given.min_hessian) & (gain > 1e-6)
            found = bool(splits.any())
            j, k = np.unravel_index(int(np.argmax(np.where(splits, gain, -np.inf) if found else gain)), gain.shape)
            out.append((model, node, found, *map(float, (gain[j, k],)), int(own[j]), int(k), *map(float, (gl[j, k], hl[j, k], g[j, 0], h[j, 0]))))
        if out:
            kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    if parts * sum(len(t["open"]) * len(t["predictors"]) for t in tasks.values()) * 2 * 8 * BINS <= DRIVER_BYTES:
        return [r for batch in choose(sums.toArrow().sort_by([("model", "ascending"), ("node", "ascending")]).to_batches()) for r in zip(*batch.to_pydict().values())]
    found = _together(sums).mapInArrow(choose, "model int, node int, splits boolean, gain double, predictor int, cut int, gl double, hl double, g double, h double")
    return [tuple(r) for r in found.collect()]


def _grow(rows: DataFrame, models: dict[int, Model], since: list[dict], cuts: list[int], number: int, seed: int) -> dict[int, Tree]:
    """One further tree for each model, level by level."""
    trees = {m: Tree() for m in models}
    frontier, chosen = {m: [0] for m in models}, {}
    for m, model in models.items():
        share = model.settings.columns
        random = np.random.default_rng([seed, number, model.held if model.held is not None else -1 & 0xFFFF])
        usable = [f for f, n in enumerate(cuts) if n]
        chosen[m] = sorted(random.choice(usable, max(1, round(share * len(usable))), replace=False).tolist()) if usable else []
    while any(frontier.values()):
        tasks = {m: {"share": models[m].settings.rows, "held": models[m].held, "tree": trees[m].arrays(), "open": np.array(sorted(f)), "predictors": chosen[m]}
                 for m, f in frontier.items() if f and chosen[m]}
        if not tasks:
            break
        found = _best(cut_sums(rows, tasks, since, seed * 1_000_003 + number), tasks, {m: models[m].settings for m in tasks}, cuts, rows.rdd.getNumPartitions())
        frontier = {m: [] for m in models}
        for m, node, splits, gain, predictor, cut, gl, hl, g, h in sorted(found):
            tree, settings = trees[m], models[m].settings
            tree.sums.setdefault(node, (g, h))
            depth = (node + 1).bit_length() - 1
            if splits and depth < settings.max_depth:
                tree.splits[node], tree.gains[node] = (predictor, cut), gain
                tree.sums[2 * node + 1], tree.sums[2 * node + 2] = (gl, hl), (g - gl, h - hl)
                if depth + 1 < settings.max_depth:
                    frontier[m] += [c for c in (2 * node + 1, 2 * node + 2) if tree.sums[c][1] >= 2 * settings.min_hessian]
    for m, tree in trees.items():
        tree.settle(models[m].settings)
    return trees


def staged_areas(rows: DataFrame, models: dict[int, Model], since: list[dict], steps: int = SCORE_STEPS) -> DataFrame:
    """``model``, ``stage``, ``held`` and ``auc`` after each of some rounds, from one pass over the rows.

    Scores are counted in ``steps`` steps; pairs within a step count one half.
    """
    def count(batches):
        sums = {(m, stage): np.zeros(4 * steps + 1, np.int32) for m in models for stage in range(len(since))}
        for block in blocks(batches):
            margin = {m: block.margin[m] for m in models}
            label = np.where(block.y == 1, 1, np.where(block.y == 0, 0, -4))  # others count nowhere
            parts = {held: np.where(label < 0, 4, label + 2 * (0 if held is None else block.fold == held)) * steps for held in {m.held for m in models.values()}}
            for stage, _ in enumerate(_advance(block.x, margin, since)):
                for m, model in models.items():
                    part = parts[model.held]
                    at = np.minimum((steps / (1 + np.exp(-margin[m]))).astype(np.int64), steps - 1)
                    sums[m, stage] += np.bincount(np.minimum(part + at, 4 * steps), minlength=4 * steps + 1).astype(np.int32)
        for (m, stage), counts in sums.items():
            at = np.flatnonzero(counts[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([m], pa.int32()), pa.array([stage], pa.int32()), pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([counts[at].tolist()], pa.list_(pa.int32()))],
                names=["model", "stage", "at", "n"])

    def read(batch, i):
        counts = np.zeros(4 * steps, np.int64)
        counts[batch.column("at")[i].values.to_numpy()] = batch.column("n")[i].values.to_numpy()
        return counts

    def area(batches):
        out = []
        for (m, stage), counts in added(batches, ("model", "stage"), read):
            for held, (neg, pos) in zip((False, True), counts.reshape(2, 2, steps).astype(float)):
                if neg.any() or pos.any():
                    pairs = neg.sum() * pos.sum()
                    out.append((m, stage, held, float(pos @ (neg.cumsum() - neg / 2) / pairs) if pairs else None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.bool_(), pa.float64()))],
                                             names=["model", "stage", "held", "auc"])

    counts = rows.mapInArrow(count, "model int, stage int, at array<int>, n array<int>").repartition("model", "stage").sortWithinPartitions("model", "stage")
    return counts.mapInArrow(area, "model int, stage int, held boolean, auc double")


def best_round(areas: Sequence[float | None], stop: int) -> tuple[int, bool]:
    """The first round with the best area, and whether ``stop`` rounds have passed without a better one."""
    known = [a if a is not None else -1.0 for a in areas]
    best = max(range(len(known)), key=lambda i: (known[i], -i)) if known else -1
    return best + 1, bool(stop) and len(known) - 1 - best >= stop


def train(rows: DataFrame, models: list[Model], cuts: list[list[float]], groups: list[list[int]], seed: int = 8) -> list[int]:
    """Grow the trees of all models; the chosen number of rounds of each group.

    The models of a group, such as the folds of one grid point, stop together by the mean area on
    their held-out rows. Every few rounds the rows are stored with their margins.
    """
    sizes, stopped = [len(c) for c in cuts], {}
    number = 0
    while True:
        active = {m: models[m] for k, g in enumerate(groups) if k not in stopped for m in g if number < models[m].settings.rounds}
        if not active:
            break
        since: list[dict] = []
        for _ in range(STORED_ROUNDS):
            now = {m: model for m, model in active.items() if number < model.settings.rounds}
            if not now:
                break
            trees = _grow(rows, now, since, sizes, number, seed)
            for m, tree in trees.items():
                models[m].trees.append(tree)
            since.append({m: t.arrays() for m, t in trees.items()})
            number += 1
        if any(model.held is not None for model in active.values()):
            found = {(r.model, r.stage, r.held): r.auc for r in staged_areas(rows, active, since).collect()}
            for stage in range(len(since)):
                for m in since[stage]:
                    models[m].areas.append((found.get((m, stage, False)), found.get((m, stage, True))))
        for k, group in enumerate(groups):
            settings = models[group[0]].settings
            if k not in stopped and settings.stop:
                areas = mean_areas([models[m] for m in group])
                for upto in range(1, len(areas) + 1):
                    best, end = best_round([a for _, a in areas[:upto]], settings.stop)
                    if end:
                        stopped[k] = best
                        break
        rows = checkpointed(rows.mapInArrow(_moved(since), rows.schema))
    return [stopped.get(k, best_round([a for _, a in mean_areas([models[m] for m in g])], 0)[0] if models[g[0]].settings.stop else len(models[g[0]].trees))
            for k, g in enumerate(groups)]


def _moved(since: list[dict]):
    def move(batches):
        for block in blocks(batches):
            for _ in _advance(block.x, dict(enumerate(block.margin)), since):
                pass
            yield _block(block)

    return move


def mean_areas(models: list[Model]) -> list[tuple[float | None, float | None]]:
    """Mean training and held-out area per round; missing where a fold has one class only."""
    means = []
    for parts in zip(*[m.areas for m in models]):
        means.append(tuple(None if any(p[i] is None for p in parts) else sum(p[i] for p in parts) / len(parts) for i in (0, 1)))
    return means


def scorer(predictors: Sequence[str], cuts: list[list[float]], trees: list[Tree]) -> Scorer:
    """Probabilities by an ensemble, computed on Arrow batches."""
    edges, arrays = [np.array(c) for c in cuts], [t.arrays() for t in trees]

    @F.pandas_udf("double")
    def probability(*columns: pd.Series) -> pd.Series:
        x = np.stack([np.searchsorted(e, c.to_numpy()) for e, c in zip(edges, columns)])
        margin = np.zeros(x.shape[1])
        for tree in arrays:
            margin += tree[2][_nodes(tree, x)]
        return pd.Series(1 / (1 + np.exp(-margin)))

    def score(df: DataFrame) -> DataFrame:
        return df.withColumn("score", probability(*[F.col(p) for p in predictors]))

    return score


def _fit(train_rows: DataFrame, predictors: Sequence[str], settings: Settings, holdout: float) -> tuple[list[list[float]], list[Tree]]:
    check_predictors(train_rows, predictors)
    cuts = bin_cuts(train_rows, predictors)
    fold = F.when(uniform(F.col(KEY), seed=11) < F.lit(holdout), 0).otherwise(1)
    model = Model(settings, 0 if holdout else None)
    rounds, = train(binned(train_rows, predictors, cuts, 1, fold), [model], cuts, [[0]])
    return cuts, model.trees[:rounds]


def boosted(predictors: Sequence[str], holdout: float = 0.0, **settings) -> Fit:
    """Second-order boosted trees. With ``holdout`` > 0 the area on that share of the rows says when to stop.

    Of all rounds those up to the best area are kept. Predictors must not be missing.
    """
    given = Settings(**settings)
    if bool(holdout) != bool(given.stop):
        raise ValueError("stopping needs held-out rows, and held-out rows a number of rounds to stop after")

    def fit(train_rows: DataFrame) -> Scorer:
        return scorer(predictors, *_fit(train_rows, predictors, given, holdout))

    return fit


def node_table(train_rows: DataFrame, predictors: Sequence[str], holdout: float = 0.0, **settings) -> DataFrame:
    """One row per node of a fitted ensemble: ``tree``, ``node``, ``predictor``, ``cut``, ``gain``, ``cover``, ``value``."""
    cuts, trees = _fit(train_rows, predictors, Settings(**settings), holdout)
    rows = []
    for i, tree in enumerate(trees):
        for node, (_, h) in sorted(tree.sums.items()):
            split = tree.splits.get(node)
            rows.append((i, node, predictors[split[0]] if split else None, cuts[split[0]][split[1]] if split else None,
                         tree.gains.get(node), float(h), tree.values.get(node)))
    return train_rows.sparkSession.createDataFrame(
        rows, "tree int, node int, predictor string, cut double, gain double, cover double, value double")


def importance(nodes: DataFrame) -> DataFrame:
    """Shares of gain, cover and number of splits per predictor of a :func:`node_table`, largest gain first."""
    sums = nodes.where("predictor is not null").groupBy("predictor").agg(
        F.sum("gain").alias("gain"), F.sum("cover").alias("cover"), F.count(F.lit(1)).alias("frequency"))
    total = Window.partitionBy()
    return sums.select("predictor", *[(F.col(c) / F.sum(c).over(total)).alias(c) for c in ("gain", "cover", "frequency")])


def grid_search(df: DataFrame, predictors: Sequence[str], grid: Sequence[dict], folds: int) -> DataFrame:
    """For each point of a grid the common best round of all folds, with mean training and test area there.

    ``df`` has a ``fold`` column in ``0..folds-1``. All points and folds grow together, so that a
    level of all their trees is one job.
    """
    check_predictors(df, predictors)
    models = [Model(Settings(**point), f) for point in grid for f in range(folds)]
    groups = [list(range(i * folds, (i + 1) * folds)) for i in range(len(grid))]
    cuts = bin_cuts(df, predictors)
    rounds = train(binned(df, predictors, cuts, len(models), F.col("fold")), models, cuts, groups)
    rows = []
    for point, group, n in zip(grid, groups, rounds):
        areas = mean_areas([models[m] for m in group])
        rows.append((*map(float, point.values()), n, *(areas[n - 1] if n else (None, None)), len(areas)))
    columns = ", ".join(f"`{c}` double" for c in grid[0])
    return df.sparkSession.createDataFrame(rows, f"{columns}, best_round int, train_auc double, test_auc double, grown_rounds int").orderBy(
        F.desc_nulls_last("test_auc"), *grid[0])
