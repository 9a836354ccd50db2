"""Near-duplicate embeddings by NN-descent."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from acctrisk.llm.common import flush, groups, stored
from acctrisk.llm.components import components

THRESHOLD = 0.9
#: Places of a neighbour list for the own component and as many for others, random trees of the first graph, vectors of a leaf,
#: bits of a leaf's code.
NEIGHBOURS, TREES, LEAF, BITS = 8, 12, 128, 24
#: Rounds of refinement at most in a row; they end with the first that joins no components.
ROUNDS = 6
#: Vectors whose links are counted against all others, and the share of them that must have been found.
AUDIT, RECALL = 1000, 0.99
#: Members of a component that are compared with each other in one task.
BLOCK = 256

PAIRS = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("cos", pa.float64())])
#: Pairs for the neighbour lists, and stars that stand for the links met (``star``).
MET = PAIRS.append(pa.field("star", pa.bool_()))
MET_DDL = "src long, dst long, cos double, star boolean"


def classes(table: DataFrame, id: str, embedding: str) -> DataFrame:
    """Distinct usable vectors: ``cid`` (smallest id), ``copies``, ``v``, ``dim``; stored."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    usable = F.coalesce(finite & F.exists(v, lambda x: x != 0) & F.col(id).isNotNull(), F.lit(False))
    rows = table.select(F.col(id).cast("long").alias("id"), v.alias("v"), usable.alias("usable")).where("usable")
    same = rows.groupBy("v").agg(F.min("id").alias("cid"), F.count_distinct("id").alias("copies"))
    return stored(same.select("cid", "copies", "v", F.size("v").alias("dim")), "vectors")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch, all of one length, scaled to a largest component of 1 against overflow."""
    column = batch.column("v")
    rows = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return rows / np.abs(rows).max(axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / np.outer(np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1)))


def _joined_labels(near: np.ndarray, component: np.ndarray, threshold: float) -> np.ndarray:
    """For each row the first row that links and known components join it to."""
    joined = (near >= threshold) | (component[:, None] == component[None, :])
    label = np.arange(len(near))
    while True:
        new = np.where(joined, label[None, :], len(near)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _local_join(keys: list[str], most: int, ids: str, threshold: float):
    """Compare all rows of a run with each other.

    Each row keeps the ``most`` nearest of its own component and the ``most`` nearest of others, so
    that near copies, however many, leave places for the rest. No link is lost to the length of a
    list: the links across components are all kept, as stars that join the same rows.
    """
    def join(batches):
        out = [[] for _ in MET]

        def put(src, dst, cos, star):
            for column, values in zip(out, (src, dst, cos, np.full(len(src), star))):
                column.append(values)

        for run in groups(batches, keys):
            n = run.num_rows
            if n < 2:
                continue
            own, component = run.column(ids).to_numpy(), run.column("component").to_numpy()
            x = _matrix(run)
            near = cosines(x, x)
            label = _joined_labels(near, component, threshold)
            first = component[label]
            new = first != component
            put(own[new], own[label[new]], near[new, label[new]], True)
            near[own[:, None] == own[None, :]] = -2
            same = label[:, None] == label[None, :]
            k = min(most, n - 1)
            for side in (np.where(same, near, -2), np.where(same, -2, near)):
                best = np.argpartition(side, n - k, axis=1)[:, n - k:]
                src, dst, cos = np.repeat(own, k), own[best].ravel(), np.take_along_axis(side, best, axis=1).ravel()
                real = cos > -2
                put(src[real], dst[real], cos[real], False)
            if sum(map(len, out[0])) > 1 << 15:
                yield flush(out, MET)
        if out[0]:
            yield flush(out, MET)
    return join


def tree_leaves(vectors: DataFrame, labels: DataFrame | None, trees: range, parts: int, threshold: float) -> DataFrame:
    """Neighbours and stars within the leaves of random-hyperplane trees.

    A vector's code in a tree is the sides of its hyperplanes that it lies on. Vectors in the order
    of their codes are cut every :data:`LEAF` rows, so a code that very many share fills many leaves.
    """
    def code(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                x = _matrix(own)
                for tree in trees:
                    planes = np.random.default_rng([tree, int(dim)]).standard_normal((int(dim), BITS))
                    sides = ((x @ planes) > 0) @ (1 << np.arange(BITS, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), tree, np.int32)), own.column("dim"), pa.array(sides), own.column("cid"), own.column("component"), own.column("v")],
                        names=["tree", "dim", "code", "cid", "component", "v"])

    coded = _with_component(vectors, labels, "cid").mapInArrow(code, "tree int, dim int, code long, cid long, component long, v array<double>")
    order = ["tree", "dim", "code", F.xxhash64("cid")]
    spread = coded.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def leaves(batches):
        join = _local_join(["leaf"], NEIGHBOURS, "cid", threshold)
        leaf = 0
        for run in groups(batches_of(batches, LEAF), ["tree", "dim", "part"]):
            leaf += 1
            numbered = run.append_column("leaf", pa.array(np.full(run.num_rows, leaf, np.int64)))
            yield from join([numbered])

    def batches_of(batches, size):
        seen = 0
        for batch in batches:
            part = (np.arange(batch.num_rows) + seen) // size
            seen += batch.num_rows
            yield batch.append_column("part", pa.array(part))

    return spread.mapInArrow(leaves, MET_DDL)


def _with_component(rows: DataFrame, labels: DataFrame | None, id: str, name: str = "component") -> DataFrame:
    """``rows`` with the component of ``id``, which is ``id`` itself as long as it has no link."""
    if labels is None:
        return rows.withColumn(name, F.col(id))
    own = labels.select(F.col("node").alias(id), F.col("component").alias("__own"))
    return rows.join(own, id, "left").withColumn(name, F.coalesce("__own", F.col(id))).drop("__own")


def _nearest(pairs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest of each vector in its component and outside it, from pairs in either direction.

    A list whose last place still holds a link is thereby enlarged: links lie inside components, so
    the places for others start again behind them, and hold no link.
    """
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cos"))
    once = both.groupBy("src", "dst").agg(F.max("cos").alias("cos"))
    placed = _with_component(_with_component(once, labels, "src", "__x"), labels, "dst")
    placed = placed.withColumn("__inside", F.col("__x") == F.col("component"))
    rank = F.row_number().over(Window.partitionBy("src", "__inside").orderBy(F.col("cos").desc(), "dst"))
    return placed.withColumn("n", rank).where(F.col("n") <= most).select("src", "dst", "cos", "component")


def _merged(labels: DataFrame | None, met: DataFrame) -> tuple[DataFrame, bool]:
    """The labels with the stars of ``met``, and whether there were any."""
    stars = met.where("star").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if labels is not None:
        if stars.isEmpty():
            return labels, False
        stars = stars.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return _labelled(stars), True


def descend(graph: DataFrame, labels: DataFrame, vectors: DataFrame, threshold: float, most: int = NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """Refine the neighbour lists until no components join any more: neighbours of a vector meet each other."""
    for _ in range(ROUNDS):
        met = graph.join(vectors.select(F.col("cid").alias("dst"), "v"), "dst").select("src", "dst", "component", "v")
        met = met.repartition("src").sortWithinPartitions("src", "dst")
        found = stored(met.mapInArrow(_local_join(["src"], most, "dst", threshold), MET_DDL), "found")
        labels, new = _merged(labels, found)
        pairs = graph.select("src", "dst", "cos").unionByName(found.where("not star").drop("star"))
        graph = stored(_nearest(pairs, labels, most), "graph")
        if not new:
            break
    return graph, labels


def audit(vectors: DataFrame, threshold: float, sample: int = AUDIT) -> DataFrame:
    """All links of ``sample`` vectors, chosen by a hash, by comparing each with every vector."""
    chosen = vectors.orderBy(F.xxhash64("cid", F.lit("audit")), "cid").limit(sample).select("cid", "v").collect()
    by_dim: dict[int, list] = {}
    for r in chosen:
        by_dim.setdefault(len(r["v"]), []).append((r["cid"], r["v"]))
    asked = {d: (np.array([c for c, _ in x]), np.array([v for _, v in x])) for d, x in by_dim.items()}

    def compare(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim, (ids, rows) in asked.items():
                own = batch.filter(pa.array(dims == dim))
                if own.num_rows:
                    cos = cosines(rows / np.abs(rows).max(axis=1, keepdims=True), _matrix(own))
                    i, j = np.nonzero(cos >= threshold)
                    other = own.column("cid").to_numpy()[j]
                    real = ids[i] != other
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i][real]), pa.array(other[real]), pa.array(cos[i, j][real])], schema=PAIRS)

    return vectors.mapInArrow(compare, "src long, dst long, cos double")


def _labelled(edges: DataFrame) -> DataFrame:
    return stored(components(edges), "labels")


def count_links(vectors: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``cid`` and ``links``: the vectors, copies included, that each class of a component is linked with.

    Every component is compared as a whole, block by block: that is the full neighbour list of a
    vector whose own component filled its places. Only counts leave a task.
    """
    members = labels.select(F.col("node").alias("cid"), "component").join(vectors, "cid")
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "copies", "v")
    keys = ["component", "dim", "i", "j"]
    met = met.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "block", "cid")

    def count(batches):
        for run in groups(batches, keys):
            x, ids, copies = _matrix(run), run.column("cid").to_numpy(), run.column("copies").to_numpy()
            block, first, last = run.column("block").to_numpy(), run.column("i")[0].as_py(), run.column("j")[0].as_py()
            near = cosines(x, x) >= threshold
            np.fill_diagonal(near, False)
            if first != last:
                near &= block[:, None] != block[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near @ copies)], names=["cid", "links"])

    return met.mapInArrow(count, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))


def near_duplicates(table: DataFrame, id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id``, ``kept``.

    Vectors with a cosine of at least ``threshold`` in double precision are linked. Missing and zero
    vectors, vectors with missing or non-finite components, and rows without id link with nothing;
    vectors of different lengths never link. Equal vectors are compared once and linked with each
    other. Repeated ids with one vector are one vector. Other columns are ignored; an empty table
    gives an empty result.

    The first graph comes from leaves of random trees; NN-descent refines it. Links met on the way
    join components at once, and lists that they fill are enlarged (:func:`_nearest`). The links of a sample
    are then counted against all vectors. As long as too few of them lie inside components, the
    graph takes in new trees and descends again (the audit's own links are kept, too). Components
    are compared as wholes for the counts.
    """
    spark = table.sparkSession
    vectors = classes(table, id, embedding)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    truth = stored(audit(vectors, threshold), "audit")
    graph, labels, tree = None, None, 0
    while True:
        leaves = stored(tree_leaves(vectors, labels, range(tree, tree + TREES), parts, threshold), "leaves")
        tree += TREES
        labels, _ = _merged(labels, leaves)
        pairs = leaves.where("not star").drop("star")
        pairs = pairs if graph is None else pairs.unionByName(graph.select("src", "dst", "cos"))
        graph, labels = descend(stored(_nearest(pairs, labels, NEIGHBOURS), "graph"), labels, vectors, threshold)
        a = labels.select(F.col("node").alias("src"), F.col("component").alias("x"))
        b = labels.select(F.col("node").alias("dst"), F.col("component").alias("y"))
        checked = truth.join(a, "src", "left").join(b, "dst", "left")
        found, asked = checked.agg(F.count(F.when(F.col("x") == F.col("y"), 1)), F.count(F.lit(1))).first()
        if found >= RECALL * asked:
            break
    if found < asked:
        labels, _ = _merged(labels, truth.withColumn("star", F.lit(True)))
    counted = count_links(vectors, labels, threshold)
    per_class = vectors.join(counted, "cid", "left").join(labels.select(F.col("node").alias("cid"), "component"), "cid", "left").select(
        F.col("v").alias("__v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "cid").alias("component_id"))
    rows = table.select(F.col(id).alias("__id"), F.col(embedding).cast("array<double>").alias("__v"))
    joined = rows.join(per_class, (rows["__v"] == per_class["__v"]) & rows["__id"].isNotNull(), "left")
    component = F.coalesce("component_id", F.col("__id").cast("long"))
    return joined.select(F.col("__id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"), F.col("__id").cast("long").eqNullSafe(component).alias("kept"))
