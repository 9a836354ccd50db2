"""Mixes of more sources than a schedule by source may have."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from acctrisk.llm import mixing


def test_class_frame_meets_all_deadlines(spark):
    rng = np.random.default_rng(3)
    for _ in range(6):
        weights = sorted(set(rng.integers(1, 30, 3).tolist()))
        classes = [(w, int(rng.integers(1, 40))) for w in weights]
        slots = sum(w * c for w, c in classes)
        column = F.array(*[F.struct(F.lit(w).cast("long").alias("w"), F.lit(c).cast("long").alias("c")) for w, c in classes])
        runs = spark.range(1).select(mixing.class_frame(column)).first()[0]
        assert len(runs) <= 2 * sum(weights)
        count, at = dict(classes), 0
        done = collections.Counter()
        for r in runs:
            assert r.slot == at and r.first == done[r.w]
            for k in range(r.n):
                block = (r.first + k) // count[r.w]
                assert block * slots // r.w <= r.slot + k < -(-(block + 1) * slots // r.w)
            at, done[r.w] = at + r.n, done[r.w] + r.n
        assert at == slots and done == {w: w * c for w, c in classes}


def law(rows, weights, default, block):
    """Places are gapless, and in whole blocks of a phase every source is less than one block from its share."""
    rows = sorted(rows, key=lambda r: r.mix_position)
    assert [r.mix_position for r in rows] == list(range(len(rows)))
    assert [r.mix_phase for r in rows] == sorted(r.mix_phase for r in rows)
    total = collections.Counter(r.source for r in rows)
    blocks = collections.defaultdict(list)
    for r in rows:
        blocks[r.source].append(r.mix_block)
    for s, found in blocks.items():
        assert found == [i // block for i in range(total[s])]
    first = [r for r in rows if r.mix_phase == 0]
    w = {s: weights.get(s, default) for s in total}
    slots, seen = sum(w.values()), collections.Counter()
    frames = min(-(-(-(-n // block)) // w[s]) for s, n in total.items())
    whole = (frames - 1) * slots * block  # the last frame may have short blocks
    for p, r in enumerate(first[:whole]):
        seen[r.source] += 1
        if (p + 1) % block == 0:
            for s, v in w.items():
                assert abs(seen[s] / block - (p + 1) / block * v / slots) < 1


@pytest.mark.parametrize("many", [False, True])
def test_same_law_by_source_and_by_class(spark, monkeypatch, many):
    if many:
        monkeypatch.setattr(mixing, "MOST_SLOTS", 1)
    source = ["a"] * 300 + ["b"] * 220 + ["c"] * 100 + [None] * 90 + ["d"] * 3
    docs = spark.createDataFrame([(i if i % 50 else None, s, i) for i, s in enumerate(source)], "doc_id long, source string, mix_phase int")
    weights = {"a": 5, "b": 3, None: 2}
    got = mixing.mix(docs, weights, block_rows=4).collect()
    assert collections.Counter(r.source for r in got) == collections.Counter(source)
    law(got, weights, 1, 4)
    # a needs 15 frames of 5 blocks, b 19 of 3, c 25 of 1, the missing source 12 of 2, d one.
    assert max(r.mix_phase for r in got) == 4


def test_no_rows_and_clashing_names(spark, monkeypatch):
    docs = spark.createDataFrame([], "doc_id long, source string")
    assert mixing.mix(docs).count() == 0
    named = docs.withColumn("__source", F.struct(F.col("source").alias("s")))
    assert mixing._mix_many(named, docs.columns, named.groupBy("__source").agg(F.count(F.lit(1)).alias("n")), {}, 1, 16, "doc_id").count() == 0
    monkeypatch.setattr(mixing, "MOST_SLOTS", 1)
    names = ["w", "j", "f", "n", "phase", "from", "slots", "past", "classes", "runs", "s", "lists", "mix_block"]
    docs = spark.range(50).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("source"), *[F.lit("x").alias(c) for c in names])
    got = mixing.mix(docs, block_rows=2)
    assert got.columns == ["doc_id", "source", *names[:-1], "mix_position", "mix_phase", "mix_block"]
    assert {r.w + r.runs for r in got.collect()} == {"xx"}
    law(got.collect(), {}, 1, 2)


def test_three_thousand_sources(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("s"), (F.col("id") * F.col("id") + F.col("id") % 7) % 3001)).alias("source"))
    got = mixing.mix(docs, {"hot": 40}, block_rows=2).collect()
    assert len(got) == 30_000 and len({r.doc_id for r in got}) == 30_000 and len({r.source for r in got}) > 1000
    law(got, {"hot": 40}, 1, 2)
    by_phase = collections.Counter(r.mix_phase for r in got if r.source == "hot")
    assert by_phase[0] and max(by_phase) > 2
