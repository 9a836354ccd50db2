"""Shards of nearly equal bytes, by sampled splitters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from acctrisk.llm.common import or_empty, stored

#: Bytes of a record besides its text.
OVERHEAD = 16
#: A range of keys should hold so many bytes at most; a task ranks the rows of one range.
RANGE_BYTES = 1 << 30
#: Ranges per shard at least, and size-weighted draws per range.
RANGES, DRAWS = 16, 32
#: Equal texts stay in one shard if they fill no more than this share of it.
WHOLE = 0.02


def splitters(rows: DataFrame, total: int, ranges: int, draws: int = DRAWS) -> DataFrame:
    """``key`` and ``pieces`` of the boundaries between ``ranges`` ranges of equal expected bytes.

    A row is drawn with a probability in proportion to its size, large rows count for several
    draws. About ``ranges * draws`` draws are made at any input size, and only they are sorted. A
    key that fills two or more ranges is a splitter with as many ``pieces``.
    """
    rate = ranges * draws / max(total, 1)
    drawn = F.col("size") * F.lit(rate)
    chance = (F.xxhash64("id", "crc", F.lit("draw")) / F.lit(2.0 ** 64)) + 0.5
    sample = (
        rows.where(chance < drawn)
        .groupBy("key").agg(F.sum(F.greatest(drawn, F.lit(1.0))).alias("w"))
    )
    upto = F.sum("w").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("w").over(Window.partitionBy())
    step = F.lit(ranges) / F.col("whole")
    return (
        sample.select("key", "w", upto.alias("upto"), whole.alias("whole"))
        .withColumn("pieces", (F.floor(F.col("upto") * step) - F.floor((F.col("upto") - F.col("w")) * step)).cast("int"))
        .where(F.col("pieces") > 0).select("key", "pieces")
    )


def _placed(rows: DataFrame, bounds: DataFrame, ranges: int) -> DataFrame:
    """Add ``place``: (range, after a heavy splitter or not, piece), ascending with the key.

    The leading bits of a key lead to the few boundaries that share them.
    """
    bits = max(4, math.ceil(math.log2(ranges)))
    lead = F.shiftright("key", 64 - bits)
    spark = rows.sparkSession
    held = bounds.groupBy(lead.alias("lead")).agg(F.sort_array(F.collect_list(F.struct("key", "pieces"))).alias("own"))
    before = Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    index = (
        spark.range(-(1 << (bits - 1)), 1 << (bits - 1)).select(F.col("id").alias("lead")).join(held, "lead", "left")
        .select("lead", "own", F.coalesce(F.sum(F.coalesce(F.size("own"), F.lit(0)).cast("long")).over(before), F.lit(0)).alias("base"))
        .withColumn("base", F.greatest("base", F.lit(0)))
    )
    found = rows.withColumn("lead", lead).join(index, "lead").withColumn(
        "below", F.filter(F.coalesce("own", F.array().cast("array<struct<key:bigint,pieces:int>>")), lambda s: s["key"] <= F.col("key")))
    last = F.when(F.size("below") > 0, F.element_at("below", -1))
    split = F.coalesce((last["key"] == F.col("key")) & (last["pieces"] > 1), F.lit(False))
    piece = F.when(split, F.pmod(F.xxhash64("id", "crc"), last["pieces"])).otherwise(F.lit(-1))
    place = F.struct((F.col("base") + F.size("below")).alias("range"), F.when(split, 0).otherwise(1).alias("after"),
                     piece.cast("long").alias("piece"))
    return found.select("id", "size", "crc", "key", place.alias("place"))


def assign_shards(docs: DataFrame, shards: int = 40, id: str = "doc_id", text: str = "text",
                  range_bytes: int = RANGE_BYTES, whole: float = WHOLE) -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``bytes``: rows in the order of the texts' hashes are cut into ``shards`` stretches
    of equal bytes; a row goes where its middle falls, so that a shard misses its share by half a
    record or half a small group at either end. Equal texts are neighbours. They stay in one shard
    unless they fill more than ``whole`` of it; then they are cut like other rows.

    Sampled splitters make the ranges; exact totals of the ranges give each its place, and rows are
    ranked inside ranges only. A key that overfills ranges has ranges of its own, cut by a hash of
    the id. A missing text has no bytes, a missing id is an id like others (but sorts first), and
    repeated rows have a slot each. An empty table gives an empty result.
    """
    rows = stored(docs.select(
        F.col(id).alias("id"), (F.octet_length(or_empty(text)) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(or_empty(text)).alias("crc"), F.xxhash64(or_empty(text)).alias("key")), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = max(shards * RANGES, math.ceil(total / range_bytes))
    placed = _placed(rows, splitters(rows, total, ranges), ranges)
    sums = placed.groupBy("place").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("place", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                          F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("place").orderBy("key", "id", "crc")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("place", "key")
    ranked = (
        placed.join(offsets.hint("shuffle_hash"), "place")
        .withColumn("start", F.col("bytes_before") + F.sum("size").over(upto) - F.col("size"))
        .withColumn("number", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("group_bytes", F.sum("size").over(group))
        .withColumn("group_start", F.min("start").over(group))
    )
    together = F.col("group_bytes") <= F.lit(total / shards * whole)
    twice_middle = F.when(together, 2 * F.col("group_start") + F.col("group_bytes")).otherwise(2 * F.col("start") + F.col("size"))
    shard = F.least(F.lit(shards - 1), F.floor(twice_middle * F.lit(float(shards) / max(2 * total, 1)))).cast("int")
    cut = stored(ranked.select("id", "size", "crc", shard.alias("shard"), "number"), "cut")
    starts = cut.groupBy("shard").agg(F.min("number").alias("first"))  # one row per shard
    return cut.join(F.broadcast(starts), "shard").select(
        F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("number") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, id: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` with all its columns to ``path``, one folder per shard, rows in slot order per file."""
    place = assign_shards(docs, shards, id, text).select(F.col(id).alias("__id"), F.col("text_crc32").alias("__crc"), "shard", "slot")
    number = Window.partitionBy("__id", "__crc")
    left = docs.withColumns({"__id": F.col(id), "__crc": F.crc32(or_empty(text))})
    left = left.withColumn("__copy", F.row_number().over(number.orderBy(F.lit(0))))
    right = place.withColumn("__copy", F.row_number().over(number.orderBy("shard", "slot")))
    same = left["__id"].eqNullSafe(right["__id"]) & (left["__crc"] == right["__crc"]) & (left["__copy"] == right["__copy"])
    own = [left[c] for c in docs.columns]
    (left.join(right, same).select(*own, right["shard"].alias("shard"), right["slot"].alias("slot"))
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
