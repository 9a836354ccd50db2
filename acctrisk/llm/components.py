"""Connected components of a graph in a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from acctrisk.llm.common import stored

EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of some edges, and for each the smallest node that the edges join it to."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches):
    """Replace the edges of each batch by stars with the same components."""
    for batch in batches:
        nodes, least = roots(batch.column("a").to_numpy(), batch.column("b").to_numpy())
        own = nodes != least
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(least[own])], schema=EDGES)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it is joined to, for all nodes of ``a``-``b`` edges.

    Every batch of edges is first contracted to stars, which leaves at most one edge per node and
    batch. Then large-star and small-star steps alternate until nothing changes: each joins nodes
    with the smallest of their neighbours, so that a node with very many neighbours needs one number
    only. Steps are stored; two sums per step reach the driver.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    now, mark = stored(pairs.mapInArrow(_contract, "a long, b long").distinct(), "edges"), None
    while True:
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select("b", "b").distinct().toDF("node", "component"))
        mark = tuple(sums)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "edges")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        now = stored(small.where("a <> b").distinct(), "edges")
