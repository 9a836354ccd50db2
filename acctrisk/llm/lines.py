"""Lines that many documents share, removed from all but one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from acctrisk.llm.common import NO_ID, or_empty, stored

#: ASCII space, tab, line feed, vertical tab, form feed, carriage return; the ASCII letters.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line of more than this part of all long lines is heavy. So there are fewer heavy ones than its inverse.
HEAVY = 1 / 1000


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def long_lines(docs: DataFrame, id: str, text: str, least_length: int) -> DataFrame:
    """``id``, ``mark`` (of the text), ``pos`` and ``hash`` of every line whose key is long enough, stored."""
    keys = F.transform(F.split(or_empty(text), "\n", -1), line_key)
    own = docs.select(F.coalesce(F.col(id), F.lit(NO_ID)).alias("id"), F.xxhash64(or_empty(text)).alias("mark"),
                      F.posexplode(keys).alias("pos", "key"))
    hashed = F.substring(F.unhex(F.sha2("key", 256)), 1, 16)
    return stored(own.where(F.char_length("key") >= least_length).select("id", "mark", "pos", hashed.alias("hash")), "lines")


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", least_length: int = 40,
                least_documents: int = 5) -> DataFrame:
    """The columns of ``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    Lines end at ``\\n``. A line's key is the line without ASCII white space at its ends and with
    ASCII letters in lower case. A key of at least ``least_length`` code points that occurs in at
    least ``least_documents`` documents loses all its lines but those of the largest id that holds
    it. Documents are told apart by id: rows that repeat an id count once, and each loses its lines
    by the same rule. A missing text is one empty line. Rows without id count together as one
    document below all others. Existing columns with the three names are replaced.

    Lines are counted by their hashes. Distinct documents are counted in two steps (by line and document,
    then by line). Decisions about heavy lines, at most ``1 / HEAVY``, are broadcast, so that a line of a
    third of all documents is no single task; the others meet their rows by hash. Texts shuffle in the
    last join unless few of them lose lines.
    """
    lines = long_lines(docs, id, text, least_length)
    frequent = stored(
        lines.groupBy("hash").agg(F.count_distinct("id").alias("documents"), F.max("id").alias("holder"), F.count(F.lit(1)).alias("rows"))
        .where(F.col("documents") >= least_documents).select("hash", "holder", "rows"), "frequent")
    heavy = F.col("rows") > lines.count() * HEAVY
    many = F.broadcast(frequent.where(heavy).drop("rows"))
    decided = lines.join(many, "hash").unionByName(
        lines.join(many.drop("holder"), "hash", "left_anti").join(frequent.where(~heavy).drop("rows"), "hash"))
    drops = (
        decided.where(F.col("id") != F.col("holder"))
        .groupBy("id", "mark").agg(F.collect_set("pos").alias("__drop"))  # at most the lines of one text
        .select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), "__drop")
    )
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    rows = docs.select(*columns).withColumns({"__id": F.coalesce(F.col(id), F.lit(NO_ID)), "__mark": F.xxhash64(or_empty(text))})
    split = F.split(or_empty(text), "\n", -1)
    gone = F.coalesce("__drop", F.array().cast("array<int>"))
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone))
    kept = F.when(F.size(gone) == 0, or_empty(text)).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n"))
    return rows.join(drops, ["__id", "__mark"], "left").select(
        *columns, F.size(split).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), kept.alias("kept_text"))
