"""Quality by importance weights: how much likelier a text is under good text than under raw text."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from acctrisk.llm import words
from acctrisk.llm.common import stored

#: Hash buckets of the n-grams, longest n-gram, and the count that every bucket starts with.
BUCKETS, ORDER, PRIOR = 1 << 16, 2, 0.5
#: Labelled rows that fit the target model and the cut, at most: those with the smallest hashes of their ids.
FIT_ROWS = 20_000
#: Share of the good labelled rows that the cut may reject at most.
LOSS = 0.002
BINS = 4096


def ngrams(own: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Buckets of all n-grams of a text's words."""
    out = [own]
    for n in range(1, order):
        if len(own) > n:
            sums = own[:-n] * words.WEIGHTS[0]
            for j in range(1, n + 1):
                sums = sums + own[j:len(own) - n + j] * words.WEIGHTS[j]
            out.append(words.mixed(sums))
    return (np.concatenate(out) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _texts(batch: pa.RecordBatch, tables: tuple):
    return words.words_of(batch.column("text"), tables, lower=False, by_kind=True)


def fitted_labels(labels: DataFrame, id: str, label: str, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Ids of good and of bad labelled rows, :data:`FIT_ROWS` in all at most."""
    rows = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull())
    rows = rows.select(F.col(id).cast("long").alias("id"), (F.col(label) > 0).alias("good"))
    taken = rows.groupBy("id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(fit_rows).collect()
    ids = {g: np.array(sorted(r["id"] for r in taken if r["good"] == g), np.int64) for g in (True, False)}
    return ids[True], ids[False]


def models(docs: DataFrame, good: np.ndarray) -> np.ndarray:
    """The log ratio of every bucket's probability in the target's texts and in all texts.

    Counts of the raw model cover every document. Each task adds up its batches; one row per bucket
    reaches the driver.
    """
    schema = pa.schema([("bucket", pa.int64()), ("target", pa.int64()), ("raw", pa.int64())])

    def count(batches):
        tables, target, raw = words.powers(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            is_good = np.isin(batch.column("id").fill_null(-(2 ** 63)).to_numpy(), good)
            for own, g in zip(_texts(batch, tables), is_good.tolist()):
                found = ngrams(own)
                np.add.at(raw, found, 1)
                if g:
                    np.add.at(target, found, 1)
        held = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(target[held]), pa.array(raw[held])], schema=schema)

    sums = docs.mapInArrow(count, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()
    target, raw = np.full(BUCKETS, PRIOR), np.full(BUCKETS, PRIOR)
    target[sums["bucket"].to_numpy()] += sums["target"].to_numpy()
    raw[sums["bucket"].to_numpy()] += sums["raw"].to_numpy()
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def scores(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``id``, ``text_hash``, ``log_weight`` (sum over the text's n-grams) and ``n_grams``, per row."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)  # one number per bucket
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("log_weight", pa.float64()), ("n_grams", pa.int64())])

    def score(batches):
        tables = words.powers()
        for batch in batches:
            found = [ngrams(own) for own in _texts(batch, tables)]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("text_hash"), pa.array([float(held.value[f].sum()) for f in found], pa.float64()),
                pa.array([len(f) for f in found], pa.int64())], schema=schema)

    hashed = docs.select("id", "text", F.xxhash64("text").alias("text_hash"))
    return hashed.mapInArrow(score, "id long, text_hash long, log_weight double, n_grams long")


def mean_weight() -> Column:
    return F.col("log_weight") / F.greatest(F.col("n_grams"), F.lit(1))


def best_cut(scored: DataFrame, good: np.ndarray, bad: np.ndarray, loss: float = LOSS) -> float:
    """The mean weight below which texts are rejected, from the scores of the labelled rows.

    It has the most bad rows below it, less good ones, of the cuts that reject at most ``loss`` of
    the good rows. Without both kinds of labels nothing is rejected.
    """
    if not len(good) or not len(bad):
        return -math.inf
    fit = docs_in(scored, np.concatenate([good, bad]))
    rows = fit.select("id", mean_weight().alias("w")).collect()
    is_good = np.isin(np.array([r["id"] for r in rows]), good)
    w = np.array([r["w"] for r in rows])
    order = np.argsort(w, kind="stable")
    w, is_good = w[order], is_good[order]
    lost = np.concatenate([[0], np.cumsum(is_good)])
    gain = np.concatenate([[0], np.cumsum(~is_good)]) - lost
    allowed = lost <= loss * max(1, is_good.sum())
    allowed[1:-1] &= w[1:] > w[:-1]  # rows with equal weights stay together
    at = int(np.argmax(np.where(allowed, gain, -len(w))))
    return -math.inf if at == 0 else math.inf if at == len(w) else float(w[at - 1] + w[at]) / 2


def docs_in(rows: DataFrame, ids: np.ndarray) -> DataFrame:
    """The rows with one of these ids, whose number is bounded by a parameter."""
    wanted = rows.sparkSession.createDataFrame([(int(i),) for i in ids], "id long")
    return rows.join(F.broadcast(wanted), "id", "left_semi")


def gumbel(id: Column, seed: int) -> Column:
    """Repeatable Gumbel noise from the id."""
    u = (F.xxhash64(id, F.lit(seed)) / F.lit(2.0 ** 64)) + 0.5
    return -F.log(-F.log(F.greatest(F.lit(1e-18), F.least(u, F.lit(1 - 1e-16)))))


def top_k(rows: DataFrame, key: str, k: int) -> DataFrame:
    """``rows`` with ``selected``: whether a row is one of the ``k`` with the largest keys; ties by id.

    The k-th largest key is closed in by histograms: each pass counts the rows of the current interval
    in :data:`BINS` bins. Only counts reach the driver, and the rows of the last, tiny interval are
    ranked exactly.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None or k <= 0:
        return rows.withColumn("selected", F.lit(False))
    left = k
    while high > low:
        width = (high - low) / BINS
        if width == 0 or low + width == low or high - width == high:
            break
        inside = rows.where(F.col(key).between(low, high))
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col(key) - F.lit(low)) / F.lit(width))).cast("int")
        counts = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)), F.min(key), F.max(key)).collect()}
        for b in sorted(counts, reverse=True):
            n, lowest, highest = counts[b]
            if n >= left:
                low, high = lowest, highest
                break
            left -= n
        else:
            return rows.withColumn("selected", F.lit(True))
        if n == left:
            return rows.withColumn("selected", F.col(key) >= F.lit(low))
    # All rows in the interval have the same key: the smallest ids win.
    ties = rows.where(F.col(key).between(low, high)).select("id").orderBy(F.col("id").asc_nulls_last()).limit(left)
    last = ties.agg(F.max("id"), F.count(F.lit(1)), F.count("id")).first()
    among = F.col("id").isNull() | (F.col("id") <= F.lit(last[0])) if last[1] > last[2] else F.col("id") <= F.lit(last[0])
    return rows.withColumn("selected", (F.col(key) > F.lit(high)) | (F.col(key).between(low, high) & F.coalesce(among, F.lit(False))))


def weighed(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
            fit_rows: int = FIT_ROWS, loss: float = LOSS) -> DataFrame:
    """One row per input row: id, ``text_hash``, ``log_weight``, ``n_grams``, ``mean_weight``, ``accepted``; stored.

    Hashed unigrams and bigrams of words, numbers and runs of signs have probabilities in the target
    (the labelled good texts) and in all texts; a text's log weight is the sum of the logs of their
    ratios. A text is accepted if the weight per n-gram reaches the cut fitted on labelled rows.
    Missing and empty texts have no n-grams and weight 0. Labels without id or value are left out; an
    id with different labels counts as bad. Missing and repeated ids are scored like others. Without
    labels of both kinds everything is accepted. An empty table gives an empty result.
    """
    own = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    good, bad = fitted_labels(labels, "doc_id", label, fit_rows)
    scored = stored(scores(own, models(own, good)), "weights")
    cut = best_cut(scored, good, bad, loss)
    accepted = (mean_weight() >= F.lit(cut)) | (F.col("n_grams") == 0) if math.isfinite(cut) else F.lit(cut < 0) | (F.col("n_grams") == 0)
    return scored.select("id", "text_hash", "log_weight", "n_grams", mean_weight().alias("mean_weight"), accepted.alias("accepted"))


def resample(docs: DataFrame, labels: DataFrame, share: float = 0.5, seed: int = 0, id: str = "doc_id", text: str = "text",
             label: str = "quality", **options) -> DataFrame:
    """:func:`weighed` with ``gumbel_key`` and ``selected``: ``share`` of the rows, drawn by importance.

    The rows with the largest sums of log weight and Gumbel noise are a sample without replacement
    with probabilities in proportion to the weights.
    """
    rows = weighed(docs, labels, id, text, label, **options)
    keyed = stored(rows.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("id"), seed)), "keys")
    k = math.floor(share * keyed.count() + 0.5)
    return top_k(keyed, "gumbel_key", k).withColumnRenamed("id", id)


def accepted_documents(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`weighed` accepts, with all their columns; nothing is sampled.

    A row is judged by its own text, also where its id is missing or repeated.
    """
    gone = weighed(docs, labels, id, text, label, **options).where("not accepted")
    gone = gone.select(F.col("id").alias("__gone"), F.col("text_hash").alias("__hash")).distinct()
    same = F.col(id).cast("long").eqNullSafe(F.col("__gone")) & (F.xxhash64(F.col(text).cast("string")) == F.col("__hash"))
    return docs.join(gone, same, "left_anti")
