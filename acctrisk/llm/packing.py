"""Documents packed into sequences of a fixed number of tokens."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from acctrisk.llm import bpe
from acctrisk.llm.common import bucketed_rank, stored

CAPACITY = 2048
#: The id behind every document.
END_ID = 0

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


#: Where a document lies in its table, for pieces in the order of the table.
PLACED = PIECES.append(pa.field("__file", pa.string())).append(pa.field("__row", pa.int64()))
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def spans(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document: whole ones, behind a shorter first one if need be."""
    rest = length % capacity
    first = [(0, rest)] if rest else []
    return first + [(start, capacity) for start in range(rest, length, capacity)]


def cut(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
        capacity: int = CAPACITY, end_id: int = END_ID, ordered: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    If ``ordered``, also the name of the file and the row in it; ``docs`` is then a table read from files.
    """
    path, schema = tokenizer or bpe.default_path(), PLACED if ordered else PIECES

    def pieces(batches):
        encode = bpe.encoder(path)
        for batch in batches:
            out = [[] for _ in schema]
            places = zip(*(c.to_pylist() for c in batch.columns[2:])) if ordered else itertools.repeat(())
            for doc, body, place in zip(batch.column(0).to_pylist(), batch.column(1), places):
                ids = encode(body.as_py())
                ids.append(end_id)
                data = memoryview(np.frombuffer(ids, "<u4")).cast("B")
                for n, (start, length) in enumerate(spans(len(ids), capacity)):
                    for column, value in zip(out, (doc, n, start, length, zlib.crc32(data[4 * start:4 * (start + length)]), *place)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    place = [F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row")] if ordered else []
    own = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), *place)
    return own.mapInArrow(pieces, PIECES_DDL + (", __file string, __row long" if ordered else ""))


def _positions(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``__pos``, the number of their document in the table, for its file's number and its row; one count per file is broadcast."""
    number = F.regexp_extract("__file", r"part-(\d+)", 1).try_cast("long")  # as text, part-100000 stands before part-99999
    before = Window.orderBy(number, "__file").rowsBetween(Window.unboundedPreceding, -1)
    files = pieces.where("piece = 0").groupBy("__file").agg(F.count(F.lit(1)).alias("n"))
    offsets = files.select("__file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    return pieces.join(F.broadcast(offsets), "__file").withColumn("__pos", F.col("__offset") + F.col("__row")).drop("__file", "__row", "__offset")


def _complement(gap: int, own: int, left: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to ``gap``; ``own`` is taken once already."""
    def enough(parts: tuple[int, ...]) -> bool:
        return all(left[x] >= n for x, n in Counter((own, *parts)).items())

    if gap and left[gap] and enough((gap,)):
        return (gap,)

    def pair(total: int, most: int) -> tuple[int, int] | None:
        """Available ``a >= b`` with that sum, ``a`` at most ``most``, the largest ``a`` first."""
        low, high = (total + 1) // 2, min(most, total - 1)
        if high < low:
            return None
        a = np.arange(high, low - 1, -1)
        both = a[(left[a] > 0) & (left[total - a] > 0)]
        return next(((int(x), total - int(x)) for x in both if enough((int(x), total - int(x)))), None)

    if found := pair(gap, gap - 1):
        return found
    for a in range(gap - 2, (gap + 2) // 3 - 1, -1):
        if left[a] and (found := pair(gap - a, min(a, gap - a - 1))) and enough((a, *found)):
            return (a, *found)
    return None


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Contents of the sequences: lengths, and how many sequences have them.

    Works on the counts of the lengths alone. From the longest length down, the gap behind it is
    looked up among the single lengths, the pairs and the triples that are still available; a
    combination that fills it is used as often as the counts allow, so that each step uses up a
    length. What fits nothing exactly goes, longest first, into the sequence with the smallest
    sufficient gap. The plan has a few times ``capacity`` entries at most, whatever the counts.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out, rest = [((capacity,), int(left[capacity]))] if left[capacity] else [], Counter()
    left[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            found = _complement(capacity - length, length, left)
            if found is None:
                rest[length], left[length] = int(left[length]), 0
                break
            used = Counter((length, *found))
            n = min(int(left[x]) // k for x, k in used.items())
            for x, k in used.items():
                left[x] -= n * k
            out.append(((length, *found), n))
    open_: dict[int, list] = {}  # gap: contents and numbers of sequences
    gaps = np.zeros(capacity + 1, bool)
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            fits = np.flatnonzero(gaps[length:])
            if len(fits):
                gap = length + int(fits[0])
                contents, m = open_[gap].pop()
                if m > n:
                    open_[gap].append((contents, m - n))
                gaps[gap] = bool(open_[gap])
                used, new = min(n, m), (*contents, length)
                n -= used
            else:
                per = min(capacity // length, n)
                used, new, gap = n // per, (length,) * per, capacity
                n -= used * per
            free = gap - (length if gap < capacity else length * len(new))
            open_.setdefault(free, []).append((new, used))
            gaps[free] = True
    return out + [x for held in open_.values() for x in held]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Only the counts of the lengths, ``capacity`` numbers at most, reach the driver. The plan that
    comes back says which of the first, second, ... pieces of each length go where; pieces are
    ranked within their length in buckets, so that a common length is no single task.

    Where :func:`cut` has kept the order of the table, it is the order of the ranks, neighbours of one
    length stay neighbours in a sequence, and sequences are numbered by their first piece in it.
    """
    ordered = "__file" in pieces.columns
    columns = [c for c in pieces.columns if not c.startswith("__")]
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    used, segments, sequence = Counter(), {}, 0
    for contents, n in plan(counts, capacity):
        offset = 0
        runs = [(length, len(list(same))) for length, same in itertools.groupby(contents)]
        for length, times in runs if ordered else [(length, 1) for length in contents]:
            segments.setdefault(length, []).append((used[length], used[length] + n * times, sequence, offset, times))
            used[length] += n * times
            offset += length * times
        sequence += n
    kind = "length long, places array<struct<first:long,stop:long,sequence:long,offset:int,times:int>>"
    places = pieces.sparkSession.createDataFrame(sorted(segments.items()), kind)
    total = sum(counts.values())
    bucket = F.floor(F.col("__pos") / max(1, math.isqrt(total)))
    ranked = (bucketed_rank(_positions(pieces), ["length"], ["__pos", "piece"], [], total, "__rank", bucket) if ordered else
              bucketed_rank(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], ["doc_id", "piece"], total, "__rank"))
    place = F.get(F.filter("places", lambda p: (p["first"] <= F.col("__rank")) & (F.col("__rank") < p["stop"])), 0)
    at, own = F.col("__rank") - F.col("__place")["first"], F.col("__place")
    placed = ranked.join(F.broadcast(places), "length").withColumn("__place", place).select(
        *columns, *(["__pos"] if ordered else []), (own["sequence"] + F.floor(at / own["times"])).alias("sequence_id"),
        (own["offset"].cast("long") + at % own["times"] * F.col("length")).alias("offset"))
    if not ordered:
        return placed
    placed = stored(placed, "placed")
    first = placed.groupBy("sequence_id").agg(F.min(F.struct("__pos", "piece")).alias("__first")).select("sequence_id", "__first.*")
    numbered = bucketed_rank(first, [], ["__pos", "piece"], [], total, "__number", bucket).select("sequence_id", "__number")
    return placed.join(numbered, "sequence_id").select(*columns, F.col("__number").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
                   capacity: int = CAPACITY, end_id: int = END_ID, ordered: bool = False) -> DataFrame:
    """All pieces of ``docs`` with their places in sequences of at most ``capacity`` tokens.

    A document is the ids of its text and ``end_id``; a missing or empty text is ``end_id`` alone.
    Documents longer than ``capacity`` are cut, and only they. Repeated rows and missing ids have
    pieces each, an empty table gives an empty result, and other columns are ignored. Texts are
    tokenised once; the narrow table of pieces is stored. If ``ordered``, ``docs`` is a table read from
    files, and sequences follow its order: files by name, rows as they stand.
    """
    return pack(stored(cut(docs, id, text, tokenizer, capacity, end_id, ordered), "pieces"), capacity)
