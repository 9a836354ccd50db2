"""Exact duplicates, with the heavy groups removed before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from acctrisk.llm.common import or_empty, stored

#: Fixed value: ASCII space, tab, line feed, vertical tab, form feed and carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
#: Digests of more than this share of all rows are heavy; at most ``1 / SUPPORT`` can be.
SUPPORT = 1 / 256


def digest(text: str) -> Column:
    """SHA-256 of the text with every run of ASCII white space replaced by one space."""
    return F.sha2(F.regexp_replace(or_empty(text), BLANKS, " "), 256)


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``__id`` and ``__sha`` of every row, stored: the texts are read once."""
    return stored(docs.select(F.col(id).alias("__id"), digest(text).alias("__sha")), "fingerprints")


def heavy_winners(prints: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``__sha``, ``__first`` (smallest id) and ``__rows`` of the heavy digests.

    Misra-Gries counters (``freqItems``) give every digest above ``support`` and at most
    ``1 / support`` in all, so the table may be broadcast whatever the input. The counters
    overrate some digests: exact counts verify them, and only real duplicates stay.
    """
    candidates = prints.stat.freqItems(["__sha"], support).select(F.explode("__sha_freqItems").alias("__sha"))
    return (
        prints.join(F.broadcast(candidates), "__sha")
        .groupBy("__sha").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__rows"))
        .where(F.col("__rows") > 1)
    )


def mark_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they are the same after :func:`digest`'s normalisation; a missing text
    counts as empty. The smallest id of a group stays. A missing id never wins against another;
    in a group without ids ``keep_id`` is missing and all rows count as kept, as do all rows that
    repeat the winning id. An empty table gives an empty result; other columns are ignored.

    Heavy digests meet their winners in a broadcast join where they are read. No other digest has
    more than ``support`` of the rows, so an ordinary shuffle spreads the rest evenly.
    """
    prints = fingerprints(docs, id, text)
    winners = F.broadcast(heavy_winners(prints, support))
    heavy = prints.join(winners, "__sha")
    light = prints.join(winners, "__sha", "left_anti")
    groups = light.groupBy("__sha").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    marked = heavy.unionByName(light.join(groups, "__sha"))
    return marked.select(
        F.col("__id").alias(id), F.col("__first").alias("keep_id"), F.col("__rows").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__first")).alias("kept"), F.col("__sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, exactly one per group, with all their columns.

    As :func:`mark_duplicates`, but of rows that repeat the winning id one stays. Losers of heavy
    groups go before the shuffle; of the others the window keeps one row per task and digest
    before it shuffles.
    """
    prints = fingerprints(docs, id, text)
    winners = heavy_winners(prints, support).select("__sha", "__first")
    rows = docs.withColumn("__sha", digest(text)).join(F.broadcast(winners), "__sha", "left")
    rows = rows.where(F.col("__first").isNull() | F.col(id).eqNullSafe(F.col("__first")))
    first = Window.partitionBy("__sha").orderBy(F.col(id).asc_nulls_last())
    return rows.withColumn("__n", F.row_number().over(first)).where(F.col("__n") == 1).select(*docs.columns)
