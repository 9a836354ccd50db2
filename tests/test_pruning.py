"""Cost-complexity pruning, codes of many levels and statistics of many groups."""

from itertools import chain, combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from acctrisk.models import pruning
from acctrisk.models.boosting import Tree
from acctrisk.operators import coding
from acctrisk.plans import profile
from acctrisk.sources.schemas import KEY, LABEL


def sums(zeros, ones):
    return (zeros - ones) / 2, (zeros + ones) / 4


def hand_made():
    tree = Tree({0: (0, 1), 1: (1, 0), 2: (1, 2), 5: (0, 3)})
    tree.sums = {0: sums(60, 40), 1: sums(40, 5), 2: sums(20, 35), 3: sums(38, 0), 4: sums(2, 5), 5: sums(15, 8), 6: sums(5, 27), 11: sums(14, 1), 12: sums(1, 7)}
    return tree


def test_sequence_of_a_hand_made_tree():
    # Errors: root 40, node 1 5, its leaves 0 and 2, node 2 20, node 5 8, its leaves 1 and 1, node 6 5. First links:
    # 1 saves 3, 5 saves 6, 2 saves 13 / 2, the root 31 / 4. Without 5, 2 saves 7 and the root 11; at last the root 15.
    steps = pruning.sequence(hand_made())
    assert [(a, sorted(s)) for a, s in steps] == [(0.0, [0, 1, 2, 5]), (3.0, [0, 2, 5]), (6.0, [0, 2]), (7.0, [0]), (15.0, [])]


def test_each_subtree_is_the_best_at_its_complexity():
    tree = hand_made()
    nested = [s for s in map(frozenset, chain.from_iterable(combinations(tree.splits, k) for k in range(5)))
              if all(n == 0 or (n - 1) // 2 in s for n in s)]

    def cost(splits, alpha):
        leaves = [c for n in splits for c in (2 * n + 1, 2 * n + 2) if c not in splits] or [0]
        return sum(min(pruning.counts(tree, c)) for c in leaves) + alpha * len(leaves)

    for alpha in np.arange(0.25, 20, 0.5):
        best = min(nested, key=lambda s: (round(cost(s, alpha), 9), len(s)))
        assert pruning.at_complexity(pruning.sequence(tree), alpha) == best


@pytest.fixture(scope="module")
def rows(spark):
    random = np.random.default_rng(6)
    x = random.integers(0, 20, (900, 3)).astype(float)
    wanted = (x[:, 0] > 9) ^ (x[:, 1] > 14)
    y = np.where(random.uniform(size=900) < 0.12, ~wanted, wanted).astype(float)
    data = [(i, float(y[i]), i % 5, *map(float, x[i])) for i in range(900)]
    return spark.createDataFrame(data, f"{KEY} long, `{LABEL}` double, fold int, x0 double, x1 double, x2 double").persist()


def test_complexity_table_and_tree(rows):
    table = sorted(pruning.complexity_table(rows, ["x0", "x1", "x2"], 5, min_split=40, max_depth=5).collect(), key=lambda r: r.n_splits)
    assert table[0].n_splits == 0 and table[0].rel_error == 1
    assert all(a.cp > b.cp and a.rel_error > b.rel_error for a, b in zip(table, table[1:]))
    assert min(r.xerror for r in table) < 0.45 and all(r.xerror >= r.rel_error - 0.1 for r in table)
    scored = pruning.pruned_tree(["x0", "x1", "x2"], cp=0.02, min_split=40, max_depth=5)(rows)(rows).toPandas()
    assert ((scored["score"] > 0.5) == (scored[LABEL] == 1)).mean() > 0.8
    assert 2 <= scored["score"].nunique() <= 8
    flat = pruning.pruned_tree(["x2"], min_split=5000)(rows)(rows).toPandas()
    assert flat["score"].nunique() == 1


def test_codes_of_many_levels(spark):
    df = spark.range(50_000).select(F.concat(F.lit("v"), F.col("id") % 9973).alias("v"), "id")
    df = df.union(spark.createDataFrame([(None, -1), ("", -2)], "v string, id long"))
    out = coding.categorical_code(df, "v").toPandas()
    levels = {v: i for i, v in enumerate(sorted(out["v"].dropna().unique()))}
    assert len(out) == 50_002
    assert out["code"][out["v"].isna()].isna().all()
    known = out.dropna()
    assert (known["code"] == known["v"].map(levels)).all()


def test_statistics_of_many_groups(spark):
    df = spark.range(300_000).select((F.col("id") % 100_000).alias("g"), ((F.col("id") * 7919) % 1000).cast("double").alias("x")).persist()
    found = profile.describe_by(df, "g", "x").toPandas()
    assert len(found) == 100_000
    own = df.where("g = 77").toPandas()["x"]
    row = found[found["g"] == 77].iloc[0]
    assert row["median"] == own.median()
    assert row["mad"] == pytest.approx((own - own.median()).abs().median() * profile.MAD_SCALE)
