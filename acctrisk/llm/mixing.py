"""Sources interleaved to target weights by Pfair scheduling."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from acctrisk.llm.common import bucketed_rank, stored

#: The sum of all weights times the number of sources, at most, for a schedule by source, which is broadcast.
MOST_SLOTS = 1_000_000

#: The sum of the distinct weights, at most: a schedule of classes has up to twice as many runs in a frame.
MOST_RUNS = 10_000


def edf_frame(weights: Column) -> Column:
    """The sources (indexes into ``weights``) of the slots of one frame, earliest deadline first.

    A frame has as many slots as the integer weights sum to. Block ``i`` of a source of weight
    ``w`` is released at ``floor(i * slots / w)`` and due at ``ceil((i + 1) * slots / w)``. Every
    slot goes to the released block with the earliest deadline, which meets all deadlines, so that
    at any slot a source is less than one block away from its share.
    """
    slots = F.aggregate(weights, F.lit(0).cast("long"), lambda a, w: a + w)

    def step(done: Column, slot: Column) -> Column:
        def bid(taken: Column, j: Column) -> Column:
            weight = F.get(weights, j)
            open_ = (taken < weight) & (F.floor(taken * slots / weight) <= slot)
            return F.when(open_, F.struct(F.ceil((taken + 1) * slots / weight).alias("due"), j.alias("source")))

        bids = F.filter(F.transform(done["taken"], bid), lambda b: b.isNotNull())
        # An array of one element binds the winner, which is then computed once.
        return F.get(F.transform(F.array(F.array_min(bids)), lambda b: F.struct(
            F.transform(done["taken"], lambda t, j: F.when(j == b["source"], t + 1).otherwise(t)).alias("taken"),
            F.concat(done["out"], F.array(b["source"])).alias("out"))), 0)

    start = F.struct(F.transform(weights, lambda w: F.lit(0).cast("long")).alias("taken"),
                     F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), slots - 1), start, step, lambda done: done["out"])


def phases(rows: Mapping[str | None, int], weights: Mapping[str | None, int], block_rows: int) -> list[dict]:
    """The stretches between the points where a source runs dry.

    In each, the sources that have rows left share the slots by their weights, in whole frames.
    """
    left = {s: n for s, n in rows.items() if n}
    taken = dict.fromkeys(left, 0)
    out, offset = [], 0
    while left:
        frames = min(math.ceil(math.ceil(n / block_rows) / weights[s]) for s, n in left.items())
        out.append({"phase": len(out), "frames": frames, "offset": offset, "sources": [
            {"source": s, "weight": weights[s], "first": taken[s], "left": n}
            for s, n in sorted(left.items(), key=lambda x: (x[0] is not None, x[0]))]})
        for s in list(left):
            used = min(left[s], frames * weights[s] * block_rows)
            offset, left[s] = offset + used, left[s] - used
            taken[s] += frames * weights[s]
            if not left[s]:
                del left[s]
    return out


def _schedule(spark, plan: list[dict], block_rows: int) -> DataFrame:
    """One row per source: the phases it takes part in, each with the first rows of its blocks in a frame."""
    kind = ("phase int, frames long, offset long, sources array<struct<source:string,weight:long,first:long,left:long>>")
    rows = [(p["phase"], p["frames"], p["offset"], [(s["source"], s["weight"], s["first"], s["left"]) for s in p["sources"]]) for p in plan]
    slots = (
        spark.createDataFrame(rows, kind)
        .withColumn("order", edf_frame(F.transform("sources", lambda s: s["weight"])))
        .select("*", F.posexplode("order").alias("slot", "who"))
        .select("phase", "frames", "offset", "slot", F.size("order").alias("slots"), F.get("sources", F.col("who")).alias("s"))
        .select("phase", "frames", "offset", "slot", "slots", "s.*")
    )
    k = F.row_number().over(Window.partitionBy("phase", "source").orderBy("slot")) - 1
    last_rows = F.greatest(F.lit(0), F.least(F.lit(block_rows), F.col("left") - ((F.col("frames") - 1) * F.col("weight") + F.col("k")) * block_rows))
    upto = Window.partitionBy("phase").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    starts = (
        slots.withColumn("k", k).withColumn("n", last_rows)
        .withColumn("last", F.sum("n").over(upto) - F.col("n"))
        .withColumn("usual", F.col("slot").cast("long") * block_rows)
    )
    per_phase = starts.groupBy("source", "phase", "frames", "offset", "slots", "weight", "first").agg(
        F.sort_array(F.collect_list(F.struct("k", "usual", "last"))).alias("blocks"))
    return per_phase.groupBy("source").agg(F.collect_list(F.struct(
        "phase", "frames", "offset", "slots", "weight", "first",
        F.transform("blocks", lambda b: b["usual"]).alias("usual"),
        F.transform("blocks", lambda b: b["last"]).alias("last"))).alias("__phases"))


def class_frame(classes: Column) -> Column:
    """The runs of one frame, earliest deadline first, of classes of ``c`` sources of weight ``w`` each.

    All sources of a class have the same releases and deadlines, so their blocks stand in one
    queue: job ``q`` is block ``q div c`` of source ``q % c``. A run is ``n`` jobs of one class, from
    ``first`` on, in the slots from ``slot`` on. It ends where the jobs of a block end or another
    class has a release. So there are at most twice as many runs as the distinct weights sum to, whatever the
    number of sources, and the slots are those of :func:`edf_frame` but for the order of equal deadlines.
    """
    slots = F.aggregate(classes, F.lit(0).cast("long"), lambda a, x: a + x["w"] * x["c"])
    runs = F.aggregate(classes, F.lit(0).cast("long"), lambda a, x: a + 2 * x["w"])

    def step(state: Column, _: Column) -> Column:
        def bid(x: Column, i: Column) -> Column:
            q = F.get(state["done"], i)
            block = F.floor(q / x["c"])
            return F.struct(
                F.when(q < x["w"] * x["c"], F.ceil((block + 1) * slots / x["w"])).alias("due"), i.alias("i"), x["w"].alias("w"),
                q.alias("first"), F.floor(block * slots / x["w"]).alias("release"), ((block + 1) * x["c"] - q).alias("left"))

        def run(bids: Column) -> Column:
            live = F.filter(bids, lambda b: b["due"].isNotNull())
            waiting = F.array_min(F.transform(F.filter(live, lambda b: b["release"] > state["slot"]), lambda b: b["release"]))
            best = F.array_min(F.filter(live, lambda b: b["release"] <= state["slot"]))
            n = F.least(best["left"], waiting - state["slot"])  # a missing value is left out
            return F.struct(best["w"].alias("w"), best["first"].alias("first"), state["slot"].alias("slot"), n.alias("n"), best["i"].alias("i"))

        def after(r: Column) -> Column:
            return F.when(r["i"].isNull(), state).otherwise(F.struct(
                F.transform(state["done"], lambda q, i: F.when(i == r["i"], q + r["n"]).otherwise(q)).alias("done"),
                (state["slot"] + r["n"]).alias("slot"),
                F.concat(state["out"], F.array(F.struct(*[r[c].alias(c) for c in ("w", "first", "slot", "n")]))).alias("out")))

        # Arrays of one element bind what is used more than once.
        bound = F.transform(F.array(F.transform(classes, bid)), run)
        return F.get(F.transform(bound, after), 0)

    start = F.struct(F.transform(classes, lambda x: F.lit(0).cast("long")).alias("done"), F.lit(0).cast("long").alias("slot"),
                     F.array().cast("array<struct<w:bigint,first:bigint,slot:bigint,n:bigint>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), runs), start, step, lambda state: state["out"])


def class_phases(sources: DataFrame, weights: list[int]) -> DataFrame:
    """One row per phase: its number, first frame, frames, slots of a frame, slots before it, classes and runs.

    ``sources`` has the weight ``w`` and the number of frames ``f`` of each source. A phase ends
    where sources run dry. With ``n`` blocks in all there are at most ``sqrt(2 * n)`` phases, because each
    ends with another number of blocks of some source.
    """
    ended = sources.groupBy("f").agg(*[F.count(F.when(F.col("w") == w, 1)).alias(f"c{i}") for i, w in enumerate(weights)])
    later = Window.orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, 0)
    by_end = Window.orderBy("f")
    classes = F.filter(F.array(*[F.struct(F.lit(w).cast("long").alias("w"), F.sum(f"c{i}").over(later).alias("c")) for i, w in enumerate(weights)]),
                       lambda x: x["c"] > 0)
    rows = ended.select("f", classes.alias("classes")).withColumn("from", F.lag("f", 1, 0).over(by_end))
    rows = rows.withColumn("slots", F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x["w"] * x["c"]))
    past = F.coalesce(F.sum((F.col("f") - F.col("from")) * F.col("slots")).over(by_end.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.select((F.row_number().over(by_end) - 1).alias("phase"), "from", "f", "slots", past.alias("past"), "classes")
    return numbered.repartition("phase").withColumn("runs", class_frame(F.col("classes")))


def _mix_many(named: DataFrame, columns: list[str], counts: DataFrame, weights: Mapping[str | None, int], default_weight: int, block_rows: int, id: str) -> DataFrame:
    """The mix of any number of sources: nothing of their number reaches the driver or is broadcast.

    Rows have places in a schedule whose last blocks may be short; ranks by place close the gaps.
    """
    distinct = sorted({*weights.values(), default_weight})
    if sum(distinct) > MOST_RUNS:
        raise ValueError(f"the distinct weights sum to more than {MOST_RUNS}")
    weight = F.lit(default_weight)
    for w in distinct:
        names = [s for s, v in weights.items() if v == w]
        own = F.col("__source")["s"].isin([s for s in names if s is not None])
        weight = F.when(F.coalesce(own, F.lit(None in names)), w).otherwise(weight)
    sources = stored(counts.withColumn("w", weight.cast("long")).withColumn(
        "f", F.ceil(F.ceil(F.col("n") / block_rows) / F.col("w"))), "mix-sources")
    totals = sources.agg(F.sum("n"), F.count(F.lit(1))).first()
    # Sources of a class by falling number of frames: those left in a phase are always the first.
    hashed = F.xxhash64("__source")
    places = bucketed_rank(sources, ["w"], [F.desc("f"), hashed, F.col("__source")], [], totals[1] or 0, "j", F.shiftright(hashed, 54) - F.col("f") * 1024)
    places = places.select("__source", F.struct("w", "j").alias("__place"))
    plan = stored(class_phases(sources, distinct), "mix-phases")
    # Phases by their first frames, in lists of 256: a row looks through the lists, and then through one of them.
    lists = plan.groupBy(F.floor(F.col("phase") / 256).alias("list")).agg(F.sort_array(F.collect_list("from")).alias("froms"))
    lists = lists.agg(F.sort_array(F.collect_list(F.struct("list", "froms"))).alias("lists"))
    ranked = bucketed_rank(named, ["__source"], [F.xxhash64(F.col(id)), F.col(id)], [id], totals[0] or 0, "__row", per_group=places)
    w, j = F.col("__place")["w"], F.col("__place")["j"]
    ranked = ranked.withColumn("mix_block", F.floor(F.col("__row") / block_rows).cast("long"))
    ranked = ranked.withColumn("__frame", F.floor(F.col("mix_block") / w).cast("long")).withColumn("__lists", lists.scalar())
    ranked = ranked.withColumn("__list", F.element_at(F.filter("__lists", lambda x: F.get(x["froms"], 0) <= F.col("__frame")), -1))
    phase = F.col("__list")["list"] * 256 + F.size(F.filter(F.col("__list")["froms"], lambda x: x <= F.col("__frame"))) - 1
    # Spark broadcasts the plan where its size allows; beyond that, adaptive execution splits phases of many rows.
    plan = plan.select(F.col("phase").alias("mix_phase"), F.struct("from", "slots", "past", "classes", "runs").alias("__plan"))
    placed = ranked.drop("__lists").withColumn("mix_phase", phase.cast("int")).join(plan, "mix_phase")
    of = F.col("__plan")
    c = F.get(F.filter(of["classes"], lambda x: x["w"] == w), 0)["c"]
    placed = placed.withColumn("__job", (F.col("mix_block") % w) * c + j)
    run = F.get(F.filter(of["runs"], lambda r: (r["w"] == w) & (r["first"] <= F.col("__job")) & (F.col("__job") < r["first"] + r["n"])), 0)
    slot = of["past"] + (F.col("__frame") - of["from"]) * of["slots"] + run["slot"] + F.col("__job") - run["first"]
    placed = placed.select(*columns, "mix_phase", "mix_block", (slot * block_rows + F.col("__row") % block_rows).alias("__at"))
    width = max(1, math.isqrt(totals[0] or 0))
    out = bucketed_rank(placed, [], [F.col("__at")], [], totals[0] or 0, "__position", F.floor(F.col("__at") / width))
    return out.select(*columns, F.col("__position").cast("long").alias("mix_position"), "mix_phase", "mix_block")


def mix(docs: DataFrame, weights: Mapping[str | None, int] | None = None, default_weight: int = 1,
        block_rows: int = 16, id: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with ``mix_position`` (gapless from 0), ``mix_phase`` and ``mix_block`` (of its source).

    Each source's rows, in the order of a hash of their ids, form blocks of ``block_rows`` rows.
    The blocks are interleaved by :func:`edf_frame` to integer ``weights`` (``default_weight`` for
    sources not named). No row is dropped or repeated: once a source has run dry, the others
    share its slots by their weights, from the next frame on.

    A missing source is a source of its own, missing ids and repeated rows have a position each,
    texts are not looked at, and an empty table gives an empty result. Existing columns with the
    three names are replaced.

    Ranks are taken within buckets of a source, so that a large source is no single task; counts of
    the buckets give their offsets. The schedule is one frame per phase, whatever the number of rows. Up to
    :data:`MOST_SLOTS` it is made from one count per source and broadcast; beyond that sources of
    equal weight are scheduled as a class, by the same law, and their counts stay distributed.
    """
    spark, columns = docs.sparkSession, [c for c in docs.columns if not c.startswith("mix_")]
    docs = docs.select(*columns)
    named = docs.withColumn("__source", F.struct(F.col(source).cast("string").alias("s")))
    counts = named.groupBy("__source").agg(F.count(F.lit(1)).alias("n"))
    weights = {s: int(w) for s, w in (weights or {}).items()}
    if min(default_weight, *weights.values(), default_weight) < 1:
        raise ValueError("weights are integers of at least 1")
    rows = {r[0]["s"]: r[1] for r in counts.limit(math.isqrt(MOST_SLOTS) + 1).collect()}
    parts = {s: weights.get(s, default_weight) for s in rows}
    if sum(parts.values()) * max(1, len(parts)) > MOST_SLOTS:
        return _mix_many(named, columns, counts, weights, default_weight, block_rows, id)
    plan = phases(rows, parts, block_rows)
    schedule = _schedule(spark, plan, block_rows).select(F.struct(F.col("source").alias("s")).alias("__source"), "__phases")
    ranked = (
        bucketed_rank(named, ["__source"], [F.xxhash64(F.col(id)), F.col(id)], [id], sum(rows.values()), "__row")
        .join(F.broadcast(schedule), "__source")
        .withColumn("mix_block", F.floor(F.col("__row") / block_rows).cast("long"))
    )
    own = F.get(F.filter("__phases", lambda p: (F.col("mix_block") >= p["first"]) & (
        F.col("mix_block") < p["first"] + p["frames"] * p["weight"])), 0)
    at = F.col("mix_block") - F.col("__own")["first"]
    frame, k = F.floor(at / F.col("__own")["weight"]).cast("long"), (at % F.col("__own")["weight"]).cast("int")
    start = F.when(frame == F.col("__own")["frames"] - 1, F.get(F.col("__own")["last"], k)).otherwise(F.get(F.col("__own")["usual"], k))
    position = F.col("__own")["offset"] + frame * F.col("__own")["slots"] * block_rows + start + F.col("__row") % block_rows
    return ranked.withColumn("__own", own).select(
        *columns, position.cast("long").alias("mix_position"), F.col("__own")["phase"].alias("mix_phase"), "mix_block")


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The rows and columns of ``docs`` in the order of the mix: files written from it, taken by number, hold it."""
    return mix(docs, **options).orderBy("mix_position").select(*docs.columns)
