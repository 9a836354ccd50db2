"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from acctrisk import catalog
from acctrisk.session import local_session

HEADLINE = (
    "default_by_overlimit", "billing_features", "trx_features", "payment_features", "mart_train", "mart_filled",
    "impute_group_mean", "pair_count", "freq_table", "column_summary", "corr_matrix", "statement_payment_interval",
    "payback_share", "trend_score", "recency_weighted", "rolling_trends", "lorenz_points", "gini", "roc_points",
    "roc_auc", "obs_vs_pred_binned", "double_lift", "stratified_split", "kfold_assign", "nb_gaussian", "fit_logit",
    "fit_gbt", "knn_exact",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="16g", name="acctrisk-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
