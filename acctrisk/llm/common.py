"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: A missing id sorts below every other id.
NO_ID = -(2 ** 63)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Where that setting is missing, a local session gets a folder of its own; a cluster must set it,
    because a machine-local folder would be lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str = "table", compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The plan is cut there: what follows reads only the columns it needs, and a lost executor
    costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = shared_folder(spark, kind)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucketed_rank(df: DataFrame, group: list[str], order: list, bucket_by: list[str], rows: int, name: str,
                  bucket: Column | None = None, per_group: DataFrame | None = None) -> DataFrame:
    """Add ``name``: a gapless number from 0 within each ``group``, whose columns are not missing.

    Rows are numbered inside hash buckets of a group, and counts of the buckets give their offsets:
    a large group is no single task. There are as many buckets as the root of the number of all
    ``rows``, so that a group has as many offsets as a bucket has rows at most. With ``bucket``, an
    integer that never falls along ``order``, the numbers follow ``order`` across buckets, too.
    The columns of ``per_group``, which has one row for each group, come along with the offsets.
    """
    buckets = math.isqrt(max(rows, 1))
    hashed = F.pmod(F.xxhash64(*bucket_by), F.lit(buckets)).cast("int") if bucket is None else bucket
    df = df.withColumn("__bucket", hashed)
    place = [*group, "__bucket"]
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*place).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(*place, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    if per_group is not None:
        offsets = offsets.join(per_group, group)
    inside = F.row_number().over(Window.partitionBy(*place).orderBy(*order)) - 1
    joined = df.join(offsets.hint("shuffle_hash"), place)
    return joined.withColumn(name, F.col("__before") + inside).drop("__bucket", "__before")


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python process, also where functions travel by value."""
    return sys.modules.setdefault("_worker_cache", types.ModuleType("_worker_cache")).__dict__


def groups(batches, keys: list[str]):
    """Runs of rows with equal keys, as record batches, from batches that are sorted by the keys.

    A run is held whole, so its size must be bounded; keys are integers without missing values.
    """
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        first = tuple(values[:, 0].tolist())
        if held and held[0][0] != first:
            yield _joined(held)
            held = []
        for a, b in zip(cuts, cuts[1:]):
            if a:
                yield _joined(held)
                held = []
            held.append((tuple(values[:, a].tolist()), batch.slice(a, b - a)))
    if held:
        yield _joined(held)


def _joined(held: list) -> pa.RecordBatch:
    return held[0][1] if len(held) == 1 else pa.concat_batches([b for _, b in held])


def flush(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(columns, schema)]
    for c in columns:
        c.clear()
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def bitset(df: DataFrame, column: str, bits: int) -> bytes:
    """A set of ``2**bits`` bits with those of the hashes in ``column``: of one size, whatever the input.

    It may hold more than was put in. The words of the set are combined where they are made; at most
    ``2**(bits - 6)`` of them reach the driver.
    """
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = df.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    out = np.zeros(1 << (bits - 6), np.int64)
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.tobytes()


def in_bitset(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in a :func:`bitset`, given as an array of 64-bit words."""
    place = hashes & np.uint64(64 * len(held) - 1)
    return (held[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
