"""Models on the account table. Fits without a SQL twin are checked in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from acctrisk.catalog.features import account_table, rounded
from acctrisk.catalog.registry import query
from acctrisk.models import bayes, boosting, kernel_bayes, knn, linear, networks, oob, pruning, splines, stacking, stepwise, trees
from acctrisk.models.base import Fit, settled
from acctrisk.operators import splits
from acctrisk.plans import mart
from acctrisk.session import checkpointed
from acctrisk.sources import views
from acctrisk.sources.schemas import KEY, LABEL

FULL24, NET16 = mart.FULL24, mart.NET16


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account table with complete predictors, stored once: every fit reads it many times."""
    return checkpointed(settled(mart.model_table(account_table(spark, sf_dir), FULL24)))


def fitted(spark: SparkSession, sf_dir: str, fit: Fit) -> DataFrame:
    """Scores of the test accounts by a model of the training accounts."""
    rows = model_rows(spark, sf_dir)
    train, test = rows.where(views.is_train()), rows.where(~views.is_train())
    return fit(train)(test).select(KEY, "score", LABEL)


def _register(name: str, make) -> None:
    query(name)(lambda spark, sf_dir: fitted(spark, sf_dir, make()))


_register("fit_tree", lambda: trees.tree(FULL24))
_register("fit_pruned_tree", lambda: pruning.pruned_tree(FULL24))
_register("fit_logit", lambda: linear.logistic(FULL24))
_register("fit_logit_interactions", lambda: linear.logistic_formula(
    linear.formula(NET16, linear.LOGISTIC_INTERACTIONS)))
_register("fit_step_aic", lambda: stepwise.stepwise(FULL24))
_register("fit_forest", lambda: trees.forest(FULL24))
_register("fit_forest_tuned", lambda: oob.tuned_forest(FULL24))
_register("fit_gbt", lambda: trees.boosted(FULL24, rounds=10, max_depth=5, min_rows=20, min_gain=0.0))
STOPPED = dict(holdout=0.2, rounds=500, step=0.1, max_depth=3, min_loss=5.0, min_hessian=1.0, stop=5)
_register("fit_boosted", lambda: boosting.boosted(FULL24))
_register("fit_gbt_early_stop", lambda: boosting.boosted(FULL24, **STOPPED))
_register("fit_gbt_var1", lambda: trees.boosted(
    mart.BILLING13, rounds=100, step=0.3, max_depth=2, min_gain=0.0, min_rows=1, rows=0.5))
_register("fit_gbt_var2", lambda: trees.boosted(
    mart.PAYMENTS11, rounds=100, step=0.3, max_depth=3, min_gain=0.0, min_rows=1, rows=0.5))
_register("fit_svm_linear", lambda: linear.svm_linear(FULL24))
_register("fit_svm_rff", lambda: linear.svm_radial(FULL24))
_register("fit_gam_spline", lambda: splines.additive(FULL24))
_register("fit_mlp_avg", lambda: networks.network_average(NET16))
_register("nb_kernel", lambda: kernel_bayes.kernel(FULL24))
_register("adaboost", lambda: trees.adaptive(FULL24, rounds=5))
_register("bagged_adaboost", lambda: trees.bagged_adaptive(FULL24, bags=2, rounds=3))
_register("knn_weighted", lambda: knn.nearest(FULL24, 8, weighted=True))

BAYES = FULL24
_FILLED = ", ".join(f"coalesce(CAST({p} AS DOUBLE), 0) AS {p}" for p in FULL24)
_MODEL = f'SELECT ID_CPTE, CAST("Default" AS DOUBLE) AS "Default", {_FILLED} FROM mart'


def _bayes_sql(train: str, test: str, group: str = "") -> str:
    """Gaussian naive Bayes as SQL: class statistics of ``train`` joined to the rows of ``test``."""
    same = f" AND s.{group} = t.{group}" if group else ""
    by = f', {group}' if group else ""
    stats = ", ".join(f"avg({p}) AS m_{p}, greatest(var_samp({p}), CAST(0.000001 AS DOUBLE)) AS v_{p}" for p in BAYES)
    density = " + ".join(
        f"(-ln(2 * pi() * v_{p}) / 2 - ({p} - m_{p}) * ({p} - m_{p}) / (2 * v_{p}))" for p in BAYES)
    return f"""
    stats AS (SELECT "Default" AS c, count(*) AS n, {stats}{by} FROM {train} GROUP BY "Default"{by}),
    logs AS (SELECT t.ID_CPTE, t."Default", s.c, ln(n) + {density} AS l FROM {test} t JOIN stats s ON true{same})
    SELECT ID_CPTE, "Default", round(1 / (1 + exp(max(l) FILTER (WHERE c = 0) - max(l) FILTER (WHERE c = 1))), 6)
           AS score
    FROM logs GROUP BY ID_CPTE, "Default" """


@query("nb_gaussian", f"""
    WITH m AS ({_MODEL}), train AS (SELECT * FROM m WHERE ID_CPTE % 10 < 7),
    test AS (SELECT * FROM m WHERE ID_CPTE % 10 >= 7), {_bayes_sql('train', 'test')}""")
def nb_gaussian(spark, sf_dir):
    return rounded(fitted(spark, sf_dir, bayes.gaussian(BAYES)), "score", digits=6)


_STATS = " UNION ALL ".join(
    f"""SELECT '{p}' AS p, "Default" AS c, count(*) AS n, avg({p}) AS m, greatest(var_samp({p}), CAST(0.000001 AS DOUBLE)) AS v FROM train GROUP BY "Default" """
    for p in mart.BAYES14)
_TEST = " UNION ALL ".join(f"""SELECT ID_CPTE, "Default", '{p}' AS p, {p} AS x FROM test""" for p in mart.BAYES14)
_DENSITY = "(-ln(2 * pi() * {v}) / 2 - (x - {m}) * (x - {m}) / (2 * {v}))"


@query("nb_model_avg", f"""
    WITH m AS ({_MODEL}), train AS (SELECT * FROM m WHERE ID_CPTE % 10 < 7), test AS (SELECT * FROM m WHERE ID_CPTE % 10 >= 7),
    stats AS ({_STATS}),
    means AS (SELECT p, sum(n) AS n, sum(n * m) / sum(n) AS m, -0.5 * sum(n * ln(v)) AS apart FROM stats GROUP BY p),
    pooled AS (SELECT a.p, a.n, a.m, a.apart, greatest(sum((s.n - 1) * s.v + s.n * (s.m - a.m) * (s.m - a.m)) / (a.n - 1), CAST(0.000001 AS DOUBLE)) AS v
               FROM means a JOIN stats s ON a.p = s.p GROUP BY a.p, a.n, a.m, a.apart),
    odds AS (SELECT *, greatest(least(apart + 0.5 * n * ln(v) - ln(n), 700.0), -700.0) AS o FROM pooled),
    terms AS (SELECT t.ID_CPTE, t."Default", s.c, s.n,
                     {_DENSITY.format(m="s.m", v="s.v")} + ln(1 / (1 + exp(-o))) AS a,
                     {_DENSITY.format(m="o.m", v="o.v")} + ln(greatest(1 - 1 / (1 + exp(-o)), 1e-300)) AS b
              FROM ({_TEST}) t JOIN stats s ON t.p = s.p JOIN odds o ON t.p = o.p),
    logs AS (SELECT ID_CPTE, "Default", c, ln(max(n)) + sum(greatest(a, b) + ln(1 + exp(-abs(a - b)))) AS l
             FROM terms GROUP BY ID_CPTE, "Default", c)
    SELECT ID_CPTE, "Default", round(1 / (1 + exp(max(l) FILTER (WHERE c = 0) - max(l) FILTER (WHERE c = 1))), 6) AS score
    FROM logs GROUP BY ID_CPTE, "Default" """)
def nb_model_avg(spark, sf_dir):
    return rounded(fitted(spark, sf_dir, bayes.model_averaged(mart.BAYES14)), "score", digits=6)


@query("oof_nb", f"""
    WITH m AS ({_MODEL}), folded AS (SELECT m.*, h % 10 AS fold FROM m JOIN hashed x ON m.ID_CPTE = x.ID_CPTE
                                     WHERE seed = 0),
    train AS (SELECT a.* EXCLUDE (fold), f.fold FROM folded a JOIN (SELECT unnest(range(10)) AS fold) f
              ON a.fold <> f.fold), {_bayes_sql('train', 'folded', 'fold')}""")
def oof_nb(spark, sf_dir):
    rows = splits.hashed_folds(model_rows(spark, sf_dir), 10)
    return rounded(stacking.out_of_fold(rows, bayes.gaussian(BAYES), 10), "score", digits=6)


NEAR = FULL24
#: As in ``knn.moments_of``, a predictor that does not vary is divided by one.
_MOMENTS = ", ".join(f"avg({p}) AS m_{p}, coalesce(nullif(stddev_samp({p}), 0), 1) AS s_{p}" for p in NEAR)
_POINT = ", ".join(f"round(({p} - m_{p}) / s_{p}, 6) AS {p}" for p in NEAR)
_SQUARED = " + ".join(f"(a.{p} - b.{p}) * (a.{p} - b.{p})" for p in NEAR)
_KS = (2, 4, 8, 16)


@query("knn_exact", f"""
    WITH m AS ({_MODEL}), moments AS (SELECT {_MOMENTS} FROM m WHERE ID_CPTE % 10 < 7),
    z AS (SELECT ID_CPTE, "Default", {_POINT} FROM m, moments),
    d AS (SELECT a.ID_CPTE, a."Default", b."Default" AS y, {_SQUARED} AS squared
          FROM z a JOIN z b ON a.ID_CPTE % 10 >= 7 AND b.ID_CPTE % 10 < 7),
    r AS (SELECT *, rank() OVER (PARTITION BY ID_CPTE ORDER BY squared) AS r FROM d)
    SELECT ID_CPTE, "Default", {", ".join(f"avg(y) FILTER (WHERE r <= {k}) AS knn_{k}" for k in _KS)}
    FROM r GROUP BY ID_CPTE, "Default" """)
def knn_exact(spark, sf_dir):
    rows = model_rows(spark, sf_dir).select(KEY, LABEL, *NEAR)
    train, test = rows.where(views.is_train()), rows.where(~views.is_train())
    return knn.knn_scores(train, test, NEAR, _KS).select(KEY, LABEL, *[f"knn_{k}" for k in _KS])


@query("feature_importance")
def feature_importance(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    nodes = boosting.node_table(rows.where(views.is_train()), FULL24, **STOPPED | dict(min_loss=1.0))
    return boosting.importance(nodes)


#: Cuts of equal width, which SQL can repeat to the last digit.
_EQUAL = "(SELECT min({p}) AS low, max({p}) AS high FROM train)"
_LEFT = """SELECT '{p}' AS predictor, cut, sum(0.5 - "Default") FILTER (WHERE {p} <= cut) AS gl, 0.25 * count(*) FILTER (WHERE {p} <= cut) AS hl,
           sum(0.5 - "Default") AS g, 0.25 * count(*) AS h
    FROM train, (SELECT DISTINCT low + (high - low) * k / 64 AS cut, high FROM """ + _EQUAL + """, (SELECT unnest(range(1, 64)) AS k))
    WHERE cut < high GROUP BY cut"""


@query("boost_first_gains", f"""
    WITH m AS ({_MODEL}), train AS (SELECT * FROM m WHERE ID_CPTE % 10 < 7),
    cuts AS ({" UNION ALL ".join(_LEFT.format(p=p) for p in FULL24)}),
    filled AS (SELECT predictor, cut, coalesce(gl, 0) AS gl, hl, g, h FROM cuts)
    SELECT predictor, cut, CAST(gl AS DOUBLE) AS gl, CAST(hl AS DOUBLE) AS hl,
           round(gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1), 6) AS gain FROM filled""")
def boost_first_gains(spark, sf_dir):
    train = model_rows(spark, sf_dir).where(views.is_train())
    spans = train.agg(*[F.struct(F.min(p), F.max(p)) for p in FULL24]).first()
    cuts = [sorted({low + (high - low) * k / 64 for k in range(1, 64)} - {high}) if low < high else [] for low, high in spans]
    return rounded(boosting.first_gains(train, FULL24, cuts), "gain", digits=6)


@query("complexity_table")
def complexity_table(spark, sf_dir):
    rows = splits.hashed_folds(model_rows(spark, sf_dir).where(views.is_train()), 10)
    return pruning.complexity_table(rows, FULL24, 10)


@query("forest_oob")
def forest_oob(spark, sf_dir):
    return oob.oob_table(model_rows(spark, sf_dir).where(views.is_train()), FULL24)


@query("step_path")
def step_path(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    return stepwise.step_table(rows.where(views.is_train()), FULL24)


LEVEL_1 = {
    "boosted": lambda: trees.boosted(FULL24, rounds=5, max_depth=3, min_rows=20, min_gain=0.0),
    "logit": lambda: linear.logistic(FULL24),
    "forest": lambda: trees.forest(FULL24, trees=10, max_depth=5),
    "bayes": lambda: bayes.gaussian(BAYES),
    "bayes_averaged": lambda: bayes.model_averaged(mart.BAYES14),
}


def level_1(spark: SparkSession, sf_dir: str, folds: int = 2) -> DataFrame:
    rows = splits.hashed_folds(model_rows(spark, sf_dir), folds)
    return stacking.out_of_fold_table(rows, {n: make() for n, make in LEVEL_1.items()}, folds)


@query("oof_scores")
def oof_scores(spark, sf_dir):
    return level_1(spark, sf_dir)


@query("level2_scores")
def level2_scores(spark, sf_dir):
    return stacking.votes(level_1(spark, sf_dir), list(LEVEL_1), {"logit": 0.4})


@query("level2_blend")
def level2_blend(spark, sf_dir):
    scores = checkpointed(level_1(spark, sf_dir).withColumnsRenamed(
        {n: f"v{i}" for i, n in enumerate(LEVEL_1, 1)}))
    train, test = scores.where(views.is_train()), scores.where(~views.is_train())
    return stacking.blender()(train)(test).select(KEY, "score", LABEL)


@query("first_stage_feature")
def first_stage_feature(spark, sf_dir):
    predictors = mart.REVISED8
    rows = splits.hashed_folds(model_rows(spark, sf_dir), 2)
    staged = checkpointed(stacking.first_stage_feature(rows, linear.logistic(predictors), 2, "first_score"))
    return stacking.out_of_fold(staged, linear.logistic((*predictors, "first_score")), 2)


@query("grid_search")
def grid_search(spark, sf_dir):
    rows = splits.hashed_folds(model_rows(spark, sf_dir), 3)
    grid = stacking.expand_grid(
        rows=[0.8], columns=[0.8], max_depth=[3], min_hessian=[1.0, 20.0, 50.0], step=[0.05, 0.1, 0.2], min_loss=[0.0, 1.0, 5.0],
        rounds=[500], stop=[10])
    return boosting.grid_search(rows, mart.REVISED8, grid, 3)


@query("network_grid")
def network_grid(spark, sf_dir):
    rows = splits.hashed_folds(model_rows(spark, sf_dir).where(views.is_train()), 3)
    return networks.network_grid(rows, mart.BAYES14, (3, 5, 7), (0.1, 0.15, 0.2), 3)


@query("cross_validation")
def cross_validation(spark, sf_dir):
    rows = splits.hashed_folds(model_rows(spark, sf_dir), 2)
    return stacking.cross_validated_logistic(rows, FULL24, [0.0, 0.1], 2)
