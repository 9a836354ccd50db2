"""Ranked lexical search without random access: impact-sorted lists read in step, with score intervals."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from acctrisk.llm import runs
from acctrisk.llm.common import shared_folder, stored

#: Entries of a list that the first round reads; each later round ends at four times as many.
FIRST = 512
#: Pairs of a query and a term that are worked on together, which bounds what is broadcast.
BLOCK_PAIRS = 100_000
#: Candidates that are broadcast; more of them are shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of terms: ASCII letters and digits, and all bytes of other characters.
TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def query_terms(queries: DataFrame) -> DataFrame:
    """``query`` and ``term`` of the queries' texts, each pair once."""
    def split(batches):
        for batch in batches:
            ids = batch.column("query").to_numpy()
            for first, data, offsets in runs.slices(batch.column("text")):
                starts, ends = runs.bounds(TERM[data], offsets)
                row = np.searchsorted(offsets, starts, "right") - 1 + first
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), runs.strings(data, starts, ends).cast(pa.string())], names=["query", "term"])

    return queries.select("query", "text").mapInArrow(split, "query long, term string").distinct()


def index(docs: DataFrame, terms: list[str]) -> DataFrame:
    """For each row: ``row``, ``doc_id``, ``n`` terms, and of the listed terms it holds ``terms`` and ``tfs``.

    Hashes rule out nearly all other terms; what is left is compared as text.
    """
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(pa.array(terms, pa.large_string()))
    kind = dict(docs.dtypes)["doc_id"]

    def look(batches):
        listed = wanted.value
        data, offsets = _flat(listed)
        held = np.sort(runs.hashes(data, offsets[:-1], offsets[1:]))
        for batch in batches:
            texts = batch.column("text")
            for first, data, offsets in runs.slices(texts):
                rows = len(offsets) - 1
                starts, ends = runs.bounds(TERM[data], offsets)
                row = np.searchsorted(offsets, starts, "right") - 1
                found = runs.hashes(data, starts, ends)
                hit = held[np.minimum(np.searchsorted(held, found), len(held) - 1)] == found
                at = pc.index_in(runs.strings(data, starts[hit], ends[hit]), value_set=listed)
                sure = at.is_valid().to_numpy(zero_copy_only=False)
                keys, counts = np.unique(row[hit][sure] * len(listed) + at.drop_null().to_numpy(), return_counts=True)
                cuts = pa.array(np.searchsorted(keys, np.arange(rows + 1) * len(listed)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(first, rows), batch.column("doc_id").slice(first, rows),
                    pa.array(np.bincount(row, minlength=rows)), pa.ListArray.from_arrays(cuts, pa.array((keys % len(listed)).astype(np.int32))),
                    pa.ListArray.from_arrays(cuts, pa.array(counts.astype(np.int64)))], names=["row", "doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(look, f"row long, doc_id {kind}, n long, terms array<int>, tfs array<long>")


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and ends."""
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]


def impact_lists(heads: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Postings by ``round``, each list's highest impacts first, a table of terms, and the last round.

    Terms have ``bounds``: the highest impact that is unread after each round. Levels of impact,
    counted per term, decide where a round ends; entries of one level are read together.
    """
    documents, length = heads.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    flat = heads.select("row", "n", F.arrays_zip("terms", "tfs").alias("z")).select("row", "n", F.inline("z")).toDF("row", "n", "term", "tf")
    weight = F.floor(1000 * F.log((F.lit(2 * documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = stored(flat.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", weight.alias("w")), "weights")
    short = F.expr(f"10 + ((90 * n * {documents}L) div {max(length, 1)}L)")
    scored = flat.withColumn("m", short).join(F.broadcast(weights), "term")  # one row per term of a block of queries
    scored = scored.select("term", "row", F.expr("w * ((1000000000 * tf) div (1000 * tf + 8 * m))").alias("impact")).where("impact > 0")
    level = F.floor(16 * F.log("impact")).cast("int")
    counts = scored.groupBy("term", level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.max("impact").alias("top"))
    above = Window.partitionBy("term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(above), F.lit(0))
    number = F.when(before < FIRST, 0).otherwise(1 + F.floor(F.log(before / FIRST) / math.log(4))).cast("int")
    levels = stored(counts.select("term", "level", "top", number.alias("round")), "levels")
    last = levels.agg(F.coalesce(F.max("round"), F.lit(0))).first()[0]
    terms = stored(levels.groupBy("term").agg(
        F.array(*[F.min(F.when(F.col("round") <= r, F.col("level"))) for r in range(last + 1)]).alias("cuts"),
        F.array(*[F.coalesce(F.max(F.when(F.col("round") > r, F.col("top"))), F.lit(0)) for r in range(last + 1)]).alias("bounds")), "terms")
    lists = scored.withColumn("level", level).join(F.broadcast(terms.select("term", "cuts")), "term")
    lists = lists.select("term", "row", "impact", F.size(F.filter("cuts", lambda c: c > F.col("level"))).alias("round"))
    folder = shared_folder(heads.sparkSession, "lists")
    lists.sortWithinPartitions("round", "term", F.desc("impact")).write.option("compression", "zstd").partitionBy("round").parquet(folder)
    return heads.sparkSession.read.schema(lists.schema).parquet(folder), terms, last


def _top(pairs: DataFrame, lists: DataFrame, terms: DataFrame, last: int, k: int) -> DataFrame:
    """``query``, ``row`` and ``lower``, the full score, of all rows that may be among the first ``k``."""
    pairs = stored(pairs.join(F.broadcast(terms.select("term", "bounds")), "term"), "pairs")
    sums = F.array(*[F.sum(F.col("bounds")[r]) for r in range(last + 1)])
    states = stored(pairs.groupBy("query").agg(sums.alias("unseen")).select("*", F.lit(False).alias("closed")), "states")
    live, finished = None, []
    for r in range(last + 1):
        read, asked = lists.where(F.col("round") <= r), pairs.join(F.broadcast(states.select("query", "closed")), "query")
        seen = read.join(F.broadcast(asked.where("not closed")), "term").select("query", "row", "impact", "bounds")
        if live is not None:  # lists of closed queries are read on for the rows that are left
            rows = live.count()
            near = read.join(_few(live.select("row").distinct(), rows), "row", "left_semi")
            more = near.join(F.broadcast(asked.where("closed")), "term").select("query", "row", "impact", "bounds")
            seen = seen.union(more.join(_few(live.select("query", "row"), rows), ["query", "row"], "left_semi"))
        known = seen.groupBy("query", "row").agg(F.sum("impact").alias("lower"), F.sum(F.col("bounds")[r]).alias("known"))
        unseen = F.broadcast(states.select("query", F.col("unseen")[r].alias("unseen")))
        scores = stored(known.join(unseen, "query").select("query", "row", "lower", (F.col("lower") + F.col("unseen") - F.col("known")).alias("upper")), "scores")
        by_lower = Window.partitionBy("query").orderBy(F.desc("lower"))
        kth = scores.withColumn("place", F.row_number().over(by_lower)).where(F.col("place") <= k)
        kth = kth.groupBy("query").agg(F.min(F.when(F.col("place") == k, F.col("lower"))).alias("least"))
        kth = stored(states.join(kth, "query", "left").select(
            "query", "unseen", "closed", F.col("unseen")[r].alias("open"), F.coalesce("least", F.lit(0)).alias("least")), "kth")
        left = scores.join(F.broadcast(kth.select("query", "least")), "query").where("upper >= least").drop("least")
        left = stored(left, "live")
        unsure = left.groupBy("query").agg(F.max(F.col("upper") > F.col("lower")).alias("unsure"))
        states = stored(kth.join(unsure, "query", "left").select(
            "query", "unseen", (F.col("closed") | (F.col("open") < F.col("least")) | (F.col("open") == 0)).alias("closed"),
            F.coalesce("unsure", F.lit(False)).alias("unsure")), "states")
        done = states.where("closed and not unsure").select("query")
        finished.append(left.join(F.broadcast(done), "query").select("query", "row", "lower"))
        states = states.where("not closed or unsure").drop("unsure")
        if not states.head(1):
            break
        live = left.join(F.broadcast(states.where("closed").select("query")), "query")
    out = finished[0]
    for part in finished[1:]:
        out = out.union(part)
    return out


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id: str = "doc_id", text: str = "text",
           query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """The ``k`` best rows of ``docs`` for each query: the query's id, ``rank``, the row's id and ``score``.

    Lists of postings lie in rounds of falling impact. After each round a row's score is known to lie
    between the sum of what was read of it and that sum plus the highest unread impacts of the other
    terms. A query takes in new rows until an unseen row's upper end is below its ``k``-th lower end;
    from then on only the rows are followed whose upper end reaches it, until each of them has one
    score. So membership, ties and scores are exact, and no list is looked up by row.

    A missing or empty text has no terms: such rows are never found, such queries find nothing. Rows
    that repeat an id are rows of their own, as are queries; equal scores stand by id, missing ids
    last. Long texts are read whole. Empty tables give an empty result; other columns are ignored.
    """
    asked = stored(queries.select(F.monotonically_increasing_id().alias("query"), F.col(query_id).alias("query_id"), F.col(query_text).cast("string").alias("text")), "queries")
    pairs = stored(query_terms(asked), "query-terms")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = -(-pairs.count() // BLOCK_PAIRS)
    parts = []
    for b in range(blocks):  # each holds whole queries
        own = pairs.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        terms = [t for t, in own.select("term").distinct().orderBy("term").collect()]
        if not terms:
            continue
        heads = stored(index(rows, terms), "heads")
        lists, bounds, last = impact_lists(heads)
        numbers = docs.sparkSession.createDataFrame(list(enumerate(terms)), "number int, term string")
        numbered = own.join(F.broadcast(numbers), "term").select("query", F.col("number").alias("term"))
        best = _top(numbered, lists, bounds, last, k)
        ids = heads.select("row", "doc_id")
        parts.append(ids.join(_few(best, best.count()), "row").select("query", "doc_id", "row", F.col("lower").alias("score")))
    kind = dict(rows.dtypes)["doc_id"]
    found = docs.sparkSession.createDataFrame([], f"query long, doc_id {kind}, row long, score long")
    for part in parts:
        found = found.union(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(asked.select("query", "query_id")), "query").select(
        F.col("query_id").alias(query_id), "rank", F.col("doc_id").alias(id), "score")
