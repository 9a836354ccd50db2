"""Exact nearest neighbours as a keyed join.

Training points are assigned to the nearest of a few pivots. The pivots' distances bound, by
the triangle inequality, how far a row's k-th neighbour can be and which cells can hold a
nearer one, so a row visits only those cells. A first search near the own pivot gives each row a
distance within which its neighbours lie; the second goes to all parts that can hold a nearer point.
Cells are split or packed into parts of bounded size, rows into blocks, before they meet, and a
part returns only what lies within that distance. Within a part, leaves with boxes along the main
axes say which points a row is held against, so that a row that visits a part does not meet all of it.
Products of matrices say which points can be near; their distances are then computed coordinate by
coordinate.

Equal points are merged first, with their counts, so that copies cost nothing. All rows at
the distance of the k-th neighbour count as neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from acctrisk.models.base import Fit, Scorer, check_predictors
from acctrisk.session import checkpointed
from acctrisk.sources.schemas import KEY, LABEL

#: Points of a part and rows of a block; rows that are held against pivots at a time; distances held at a time.
BLOCK, ROWS, DISTANCES = 40_000, 1_000, 4_000_000
#: Points of a leaf of a part; leaves are made when there is more than one row for so many points; share of the variance left out of boxes.
LEAF, FEW, LEAST = 256, 100, 0.05
#: Room for rounding: of bounds, and of squared distances from products of matrices.
SLACK, PRODUCT_SLACK = 1e-9, 1e-12


def standardised(df: DataFrame, predictors: Sequence[str], moments: dict[str, tuple[float, float]]) -> Column:
    """The point of a row: predictors in standard deviations, to six decimals."""
    return F.array(*[
        F.round((F.col(p).cast("double") - moments[p][0]) / moments[p][1], 6) + F.lit(0.0) for p in predictors])


def moments_of(train: DataFrame, predictors: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = train.agg(*[F.avg(p).alias(f"m_{p}") for p in predictors],
                    *[F.stddev_samp(p).alias(f"s_{p}") for p in predictors]).first()
    return {p: (row[f"m_{p}"], row[f"s_{p}"] or 1.0) for p in predictors}


def _stack(points: pd.Series) -> np.ndarray:
    return np.stack(points.to_numpy()).astype("float64")


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-by-row squared distances, the coordinates added in order."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        away = a[:, j][:, None] - b[:, j][None, :]
        total += away * away
    return total


class Cells:
    """Pivots with what is known about the training points around each."""

    def __init__(self, points: DataFrame, most: int, pivots: int):
        seeds = points.orderBy(F.xxhash64("point"), "point").limit(pivots).select("point").collect()
        self.pivots = np.array([r["point"] for r in seeds], dtype="float64")
        self.assigned = checkpointed(points.withColumn("at", self._nearest()(F.col("point"))).select(
            "point", "n", "pos", "at.cell", "at.away"))
        # The nearest `most` points of a pivot; the row limit is applied before the shuffle.
        inner = Window.partitionBy("cell").orderBy("away", "point")
        near = (self.assigned.select("cell", "away", "point", "n", F.row_number().over(inner).alias("r"))
                .where(F.col("r") <= most))
        reach = near.select("cell", "away", F.sum("n").over(inner).alias("upto"))
        reach = reach.where(F.col("upto") >= most).groupBy("cell").agg(F.min("away").alias("reach"))
        summary = (self.assigned.groupBy("cell").agg(
            F.count(F.lit(1)).alias("points"), F.min("away").alias("low"), F.max("away").alias("high"))
            .join(reach, "cell", "left").collect())  # one row per pivot
        size = len(self.pivots)
        self.points, self.low = np.zeros(size, "int64"), np.full(size, np.inf)
        self.high, self.reach = np.full(size, -np.inf), np.full(size, np.inf)
        for r in summary:
            self.points[r["cell"]], self.low[r["cell"]], self.high[r["cell"]] = r["points"], r["low"], r["high"]
            self.reach[r["cell"]] = np.inf if r["reach"] is None else r["reach"]

    def _nearest(self):
        pivots = self.pivots

        @F.pandas_udf("cell int, away double")
        def nearest(points: pd.Series) -> pd.DataFrame:
            cell, least = np.zeros(len(points), "int32"), np.zeros(len(points))
            for a in range(0, len(points), ROWS):
                away = np.sqrt(squared_distances(_stack(points[a:a + ROWS]), pivots))
                cell[a:a + ROWS], least[a:a + ROWS] = away.argmin(axis=1), away.min(axis=1)
            return pd.DataFrame({"cell": cell, "away": least})

        return nearest

    def parts(self, block: int) -> tuple[list[int], list[int]]:
        """First part and number of parts of each cell: large cells are split, near ones packed together."""
        first, count, number, filled = [0] * len(self.pivots), [1] * len(self.pivots), -1, block
        for cell in _near_order(self.pivots, np.arange(len(self.pivots))):
            size = int(self.points[cell])
            if size > block:
                first[cell], count[cell] = number + 1, -(-size // block)
                number, filled = number + count[cell], block
            else:
                if filled + size > block:
                    number, filled = number + 1, 0
                first[cell], filled = number, filled + size
        return first, count

    def candidates(self, first: list[int], count: list[int]):
        """A column function: the parts that can hold one of a point's neighbours, given a squared distance within which they lie."""
        pivots, low, high, reach = self.pivots, self.low, self.high, self.reach
        apart = np.sqrt(squared_distances(pivots, pivots))
        held = [range(a, a + n) for a, n in zip(first, count)]

        @F.pandas_udf("array<int>")
        def visited(points: pd.Series, limit: pd.Series) -> pd.Series:
            out = []
            for a in range(0, len(points), ROWS):
                away = np.sqrt(squared_distances(_stack(points[a:a + ROWS]), pivots))
                bound = np.minimum((away + reach).min(axis=1), np.sqrt(limit[a:a + ROWS].to_numpy()))[:, None] * (1 + SLACK) + SLACK
                own = away.argmin(axis=1)
                nearest = away[np.arange(len(own)), own][:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (away ** 2 - nearest ** 2) / (2 * apart[own])
                plane = np.where(np.isfinite(plane), plane, 0.0)
                least = np.maximum.reduce([low - away, away - high, plane])
                out += [sorted({p for cell in np.flatnonzero(row).tolist() for p in held[cell]}) for row in least <= bound]
            return pd.Series(out, dtype=object)

        return visited


def _near_order(pivots: np.ndarray, own: np.ndarray) -> list[int]:
    """Pivots in an order in which neighbours tend to be near: halves along the widest coordinate."""
    if len(own) <= 2:
        return own.tolist()
    widest = int(np.ptp(pivots[own], axis=0).argmax())
    own = own[np.argsort(pivots[own, widest], kind="stable")]
    half = len(own) // 2
    return _near_order(pivots, own[:half]) + _near_order(pivots, own[half:])


def _leaves(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of at most ``size`` points: an order of the points, where each leaf starts in it, axes, and the box of each leaf along them.

    The axes are the main ones of the points' covariance: halves along them leave small boxes although predictors are correlated.
    """
    spread, axes = np.atleast_2d(np.cov(points.T)), np.eye(points.shape[1])
    if np.isfinite(spread).all():
        held, axes = np.linalg.eigh(spread)
        axes = axes[:, held.cumsum() > LEAST * held.sum()]
    turned, leaves, open_ = points @ axes, [], [np.arange(len(points))]
    while open_:
        own = open_.pop()
        if len(own) <= size:
            leaves.append(own)
            continue
        half, widest = len(own) // 2, turned[own].var(axis=0).argmax()
        own = own[np.argpartition(turned[own, widest], half)]
        open_ += [own[:half], own[half:]]
    starts = np.cumsum([0] + [len(own) for own in leaves])
    low, high = (np.array([side(turned[own], axis=0) for own in leaves]) for side in (np.min, np.max))
    return np.concatenate(leaves), starts, axes, low, high


def _box_distances(turned: np.ndarray, room: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """At least how far, squared, each row is from every point of each box."""
    total = np.zeros((len(turned), len(low)))
    for a in range(0, len(turned), ROWS):  # small arrays stay in the processor's cache
        some = total[a:a + ROWS]
        below, above = np.empty_like(some), np.empty_like(some)
        for j in range(turned.shape[1]):
            x = turned[a:a + ROWS, j][:, None]
            np.subtract(low[:, j] - room, x, out=below)
            np.subtract(x, high[:, j] + room, out=above)
            np.maximum(below, above, out=below)
            np.maximum(below, 0.0, out=below)
            below *= below
            some += below
    return total


def _search(asked: np.ndarray, limit: np.ndarray, points: np.ndarray, n: np.ndarray, pos: np.ndarray, most: int) -> pd.DataFrame:
    """Of each asked row the nearest points until ``most`` rows are counted, as far as they lie within its limit.

    Enough rows share leaves of the points: a row is held only against those whose boxes reach within its limit.
    """
    k, size, width, parts = min(most, len(points)) - 1, max(LEAF, 2 * most), points.shape[1], []
    if len(points) > size and len(asked) * FEW > len(points):
        order, starts, axes, low, high = _leaves(points, size)
        points, n, pos = points[order], n[order], pos[order]
    else:
        starts, axes = np.array([0, len(points)]), np.eye(width)
        low, high = np.full((1, width), -np.inf), np.full((1, width), np.inf)
    lengths = (points * points).sum(axis=1)
    right = np.column_stack([-2 * points, lengths]).T
    step = max(1, DISTANCES // max(np.diff(starts).max(), len(low)))
    for start in range(0, len(asked), step):
        some, within = asked[start:start + step], limit[start:start + step].copy()
        own = (some * some).sum(axis=1)
        largest = np.sqrt(own) + np.sqrt(lengths.max())
        slack, left = PRODUCT_SLACK * largest ** 2, np.column_stack([some, np.ones(len(some))])
        least = _box_distances(some @ axes, PRODUCT_SLACK * np.nanmax(largest, initial=0.0), low, high)
        free, home = ~np.isfinite(within), least.argmin(axis=1)
        for leaf in np.unique(home[free]):
            held = np.flatnonzero(free & (home == leaf))
            about = left[held] @ right[:, starts[leaf]:starts[leaf + 1]]
            within[held] = np.partition(about, k, axis=1)[:, k] + own[held] + slack[held]
        visits, found = least <= (within + slack)[:, None], []
        for leaf in np.flatnonzero(visits.any(axis=0)):
            held = np.flatnonzero(visits[:, leaf])
            about = left[held] @ right[:, starts[leaf]:starts[leaf + 1]]
            row, col = np.nonzero(about <= (within + slack - own)[held][:, None])
            found.append((held[row], col + starts[leaf]))
        if not found:
            continue
        row, col = (np.concatenate(a) for a in zip(*found))
        squared = np.zeros(len(row))
        for j in range(width):
            away = some[row, j] - points[col, j]
            squared += away * away
        parts.append(pd.DataFrame({"row": row + start, "squared": squared, "n": n[col], "pos": pos[col]}))
    if not parts:
        return pd.DataFrame({"row": np.zeros(0, "int64"), "squared": np.zeros(0), "n": n[:0], "pos": pos[:0]})
    near = pd.concat(parts).groupby(["row", "squared"], as_index=False).sum()
    return near[near.groupby("row")["n"].cumsum() - near["n"] < most]


def _numbers(rows: pd.DataFrame, train: pd.DataFrame) -> tuple:
    return _stack(rows["point"]), rows["limit"].to_numpy(dtype="float64"), _stack(train["point"]), train["n"].to_numpy(), train["pos"].to_numpy()


def _limits(most: int):
    """Each row with the squared distance up to which ``most`` points of the part are counted; infinite if there are fewer."""

    def search(rows: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        limit = np.full(len(rows), np.inf)
        if len(rows) and len(train):
            near = _search(*_numbers(rows, train), most)
            sums = near.groupby("row").agg({"squared": "max", "n": "sum"})
            sums = sums[sums["n"] >= most]
            limit[sums.index.to_numpy()] = sums["squared"]
        return rows[["qid", "point"]].assign(limit=limit)

    return search


def _nearest_in_part(most: int):
    """For each row of a block its nearest points of the part."""

    def search(rows: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(train):
            return pd.DataFrame({"qid": [], "squared": [], "n": [], "pos": []})
        near = _search(*_numbers(rows, train), most)
        return pd.DataFrame({"qid": rows["qid"].to_numpy()[near["row"]], "squared": near["squared"].to_numpy(),
                             "n": near["n"].to_numpy(), "pos": near["pos"].to_numpy()})

    return search


def _meet(rows: DataFrame, train: DataFrame, parts: int, block: int, search, schema: str) -> DataFrame:
    """``search`` of every block of rows and the part they visit; both have a column ``part``."""
    sizes = [1] * parts
    for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("visits")).collect():  # one row per part
        sizes[r["part"]] = -(-r["visits"] // block)
    blocks = F.array(*[F.lit(n) for n in sizes])[F.col("part")]
    left = rows.withColumn("row_block", F.pmod(F.xxhash64("point"), blocks).cast("int"))
    right = train.withColumn("row_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    on = ["part", "row_block"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(search, schema)


def neighbours(rows: DataFrame, points: DataFrame, most: int, block: int = BLOCK,
               pivots: int | None = None) -> DataFrame:
    """The nearest training rows of each point: ``qid, squared, n, pos`` per distinct distance.

    ``rows`` has ``qid`` and ``point``; ``points`` has distinct ``point`` with ``n`` rows, ``pos``
    of them positive. Distances are listed until ``most`` rows are counted.
    """
    points = checkpointed(points)
    if pivots is None:
        pivots = int(min(256, max(1, points.count() // 1000)))
    cells = Cells(points, most, pivots)
    first, count = cells.parts(block)
    total = max((a + n for a, n in zip(first, count)), default=0)
    kind = dict(rows.dtypes)["qid"]
    if not total:
        return rows.sparkSession.createDataFrame([], f"qid {kind}, squared double, n long, pos long")
    firsts, counts = (F.array(*map(F.lit, a))[F.col("cell")] for a in (first, count))
    train = cells.assigned.select("point", "n", "pos", (firsts + F.pmod(F.xxhash64("point"), counts)).cast("int").alias("part"))
    own = rows.select("qid", "point", cells._nearest()(F.col("point"))["cell"].alias("cell"), F.lit(float("inf")).alias("limit"))
    limited = checkpointed(_meet(own.select("qid", "point", "limit", firsts.alias("part")), train, total, block, _limits(most),
                                 f"qid {kind}, point array<double>, limit double"))
    spread = limited.withColumn("part", F.explode(cells.candidates(first, count)(F.col("point"), F.col("limit"))))
    found = _meet(spread, train, total, block, _nearest_in_part(most), f"qid {kind}, squared double, n long, pos long")
    return found.groupBy("qid", "squared").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def class_shares(near: DataFrame, ks: Sequence[int], weighted: bool = False) -> DataFrame:
    """Share of positives among the k nearest rows: ``qid, knn_<k>``.

    With ``weighted`` a neighbour counts with one minus its distance over that of the row ranked
    k + 1. A point has at most ``max(ks) + 1`` distances per block it visited.
    """
    upto = Window.partitionBy("qid").orderBy("squared")
    ranked = near.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn("away", F.sqrt("squared"))
    if not weighted:
        def among(k: int, c: str) -> Column:
            return F.sum(F.when(F.col("before") < k, F.col(c)))
        return ranked.groupBy("qid").agg(*[(among(k, "pos") / among(k, "n")).alias(f"knn_{k}") for k in ks])
    out = ranked
    for k in ks:
        edge = F.min(F.when(F.col("before") + F.col("n") > k, F.col("away"))).over(Window.partitionBy("qid"))
        out = out.withColumn(f"w_{k}", F.when(
            F.col("before") < k, F.coalesce(1 - F.try_divide(F.col("away"), edge), F.lit(1.0))).otherwise(0.0))
    return out.groupBy("qid").agg(*[
        F.coalesce(F.try_divide(F.sum(F.col(f"w_{k}") * F.col("pos")), F.sum(F.col(f"w_{k}") * F.col("n"))),
                   F.sum(F.when(F.col("before") < k, F.col("pos"))) / F.sum(F.when(F.col("before") < k, F.col("n"))))
        .alias(f"knn_{k}") for k in ks])


def knn_scores(train: DataFrame, df: DataFrame, predictors: Sequence[str], ks: Sequence[int],
               weighted: bool = False, block: int = BLOCK, pivots: int | None = None) -> DataFrame:
    """``df`` with a column ``knn_<k>`` for every k."""
    check_predictors(train, predictors)
    moments = moments_of(train, predictors)
    points = train.select(standardised(train, predictors, moments).alias("point"), F.col(LABEL)).groupBy("point").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(LABEL).cast("long")).alias("pos"))
    placed = df.withColumn("__point", standardised(df, predictors, moments))
    rows = placed.groupBy(F.col("__point").alias("point")).agg(F.min(KEY).alias("qid"))
    near = neighbours(rows, points, max(ks) + (1 if weighted else 0), block, pivots)
    shares = rows.join(class_shares(near, ks, weighted), "qid").withColumnRenamed("point", "__point").drop("qid")
    return placed.join(shares, "__point", "left").drop("__point")


def nearest(predictors: Sequence[str], k: int, weighted: bool = False) -> Fit:
    """k nearest neighbours as a model."""

    def fit(train: DataFrame) -> Scorer:
        def score(df: DataFrame) -> DataFrame:
            return knn_scores(train, df, predictors, [k], weighted).withColumnRenamed(f"knn_{k}", "score")

        return score

    return fit
