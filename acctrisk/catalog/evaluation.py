"""Model-comparison tables over the scored rows."""

from __future__ import annotations

from acctrisk.catalog.registry import query
from acctrisk.plans import evaluate as E
from acctrisk.sources import views

MODELS = ("mod1", "mod2")


def _both(select: str) -> str:
    return " UNION ALL ".join(select.replace("{m}", m) for m in MODELS)


@query("score_totals", "SELECT CAST(sum(obs) AS BIGINT) AS total_observed, count(*) AS total_exposure FROM scored")
def score_totals(spark, sf_dir):
    return E.totals(views.scored(spark, sf_dir), "obs")


LORENZ = """
    SELECT '{m}' AS model, key, {m} AS score, row_number() OVER (ORDER BY {m}, key) AS exposure,
           CAST(sum(obs) OVER (ORDER BY {m}, key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS observed,
           count(*) OVER () AS exposure_total, CAST(sum(obs) OVER () AS BIGINT) AS observed_total FROM scored"""


@query("lorenz_points", f"""
    SELECT *, CAST(exposure AS DOUBLE) / exposure_total AS exposure_share,
           CAST(observed AS DOUBLE) / observed_total AS observed_share FROM ({_both(LORENZ)})""")
def lorenz_points(spark, sf_dir):
    return E.lorenz_points(views.scored(spark, sf_dir), "obs", MODELS, "key")


@query("gini", f"""
    WITH p AS (SELECT model, exposure, CAST(exposure AS DOUBLE) / exposure_total AS x,
                      CAST(observed AS DOUBLE) / observed_total AS y FROM ({_both(LORENZ)})),
    s AS (SELECT model, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS area
          FROM p WINDOW w AS (PARTITION BY model ORDER BY exposure))
    SELECT model, round(1 - 2 * sum(area), 9) AS gini FROM s GROUP BY model""")
def gini(spark, sf_dir):
    from acctrisk.catalog.features import rounded
    return rounded(E.gini(views.scored(spark, sf_dir), "obs", MODELS, "key"), "gini")


ROC = """
    SELECT '{m}' AS model, {m} AS threshold,
           CAST(sum(count(*) FILTER (WHERE obs = 0)) OVER w AS DOUBLE) / (SELECT count(*) FROM scored WHERE obs = 0) AS fpr,
           CAST(sum(count(*) FILTER (WHERE obs = 1)) OVER w AS DOUBLE) / (SELECT count(*) FROM scored WHERE obs = 1) AS tpr
    FROM scored GROUP BY {m} WINDOW w AS (ORDER BY {m} DESC)"""


@query("roc_points", _both(f"SELECT * FROM ({ROC})"))
def roc_points(spark, sf_dir):
    return E.roc_points(views.scored(spark, sf_dir), "obs", MODELS)


AUC = """
    SELECT '{m}' AS model,
           (sum(r) FILTER (WHERE obs = 1) - CAST(count(*) FILTER (WHERE obs = 1) AS DOUBLE)
                                            * (count(*) FILTER (WHERE obs = 1) + 1) / 2)
           / (CAST(count(*) FILTER (WHERE obs = 1) AS DOUBLE) * count(*) FILTER (WHERE obs = 0)) AS auc
    FROM (SELECT obs, CAST(rank() OVER (ORDER BY {m}) AS DOUBLE)
                      + CAST(count(*) OVER (PARTITION BY {m}) - 1 AS DOUBLE) / 2 AS r FROM scored)"""


@query("roc_auc", _both(AUC))
def roc_auc(spark, sf_dir):
    return E.roc_auc(views.scored(spark, sf_dir), "obs", MODELS)


MEASURES = """avg(obs) AS observed_mean, CAST(sum(obs) AS BIGINT) AS observed_sum, avg(mod1) AS model_1_mean,
           avg(mod2) AS model_2_mean, count(*) AS exposure"""


def _breaks(value: str, bins: int) -> str:
    steps = ", ".join(repr(i / bins) for i in range(bins + 1))
    return f"SELECT list_distinct(quantile_cont({value}, [{steps}])) AS b"


@query("obs_vs_pred_binned", f"""
    WITH breaks AS ({_breaks('var', 20)} FROM scored)
    SELECT nullif(len(list_filter(b, lambda x: x < var)), 0) AS bin, {MEASURES} FROM scored, breaks GROUP BY 1""")
def obs_vs_pred_binned(spark, sf_dir):
    return E.observed_by_bin(views.scored(spark, sf_dir), "obs", "mod1", "mod2", "var", 20)


@query("obs_vs_pred_by_value", f"SELECT var_cat, {MEASURES} FROM scored GROUP BY var_cat")
def obs_vs_pred_by_value(spark, sf_dir):
    return E.observed_by_value(views.scored(spark, sf_dir), "obs", "mod1", "mod2", "var_cat")


@query("obs_vs_pred_tied_bins", f"""
    WITH breaks AS ({_breaks('mod2', 20)} FROM scored)
    SELECT nullif(len(list_filter(b, lambda x: x < mod2)), 0) AS bin, {MEASURES} FROM scored, breaks GROUP BY 1""")
def obs_vs_pred_tied_bins(spark, sf_dir):
    return E.observed_vs_predicted(views.scored(spark, sf_dir), "obs", "mod1", "mod2", "mod2", 20)


@query("double_lift", f"""
    WITH r AS (SELECT *, mod2 / mod1 AS sort_ratio FROM scored),
    breaks AS ({_breaks('sort_ratio', 10)} FROM r)
    SELECT nullif(len(list_filter(b, lambda x: x < sort_ratio)), 0) AS bin,
           CAST(sum(obs) AS BIGINT) AS observed_sum, avg(mod1) / nullif(avg(obs), 0) AS model_1_lift,
           avg(mod2) / nullif(avg(obs), 0) AS model_2_lift, count(*) AS exposure
    FROM r, breaks GROUP BY 1""")
def double_lift(spark, sf_dir):
    return E.double_lift(views.scored(spark, sf_dir), "obs", "mod1", "mod2", 10)


@query("confusion_at_threshold", """
    SELECT obs, count(*) FILTER (WHERE mod2 < CAST(0.257 AS DOUBLE)) AS predicted_0,
           count(*) FILTER (WHERE mod2 >= CAST(0.257 AS DOUBLE)) AS predicted_1 FROM scored GROUP BY obs""")
def confusion_at_threshold(spark, sf_dir):
    return E.confusion(views.scored(spark, sf_dir), "obs", "mod2", 0.257)
