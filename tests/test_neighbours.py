"""Neighbours by parts of bounded size against all distances."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import oracle
from acctrisk.catalog.modelling import model_rows
from acctrisk.models import knn
from acctrisk.plans import mart


@pytest.mark.parametrize("block,pivots,width", [(40_000, 6, 3), (60, 6, 3), (150, 1, 8)])
def test_all_distances_up_to_the_kth(spark, block, pivots, width):
    random = np.random.default_rng(6)
    points = np.unique(random.normal(size=(500, width)).round(2 if width == 8 else 1), axis=0)
    n, asked = random.integers(1, 4, len(points)), random.normal(size=(90, width)).round(1)
    train = spark.createDataFrame([([*map(float, p)], int(c), 0) for p, c in zip(points, n)], "point array<double>, n long, pos long")
    rows = spark.createDataFrame([(i, [*map(float, q)]) for i, q in enumerate(asked)], "qid long, point array<double>").repartition(3)
    got: dict = {}
    for r in knn.neighbours(rows, train, 7, block, pivots).collect():
        got.setdefault(r.qid, {})[r.squared] = r.n
    for i, q in enumerate(asked):
        squared = knn.squared_distances(q[None, :], points)[0]
        seen = 0
        for d in np.unique(squared):
            if seen >= 7:
                break
            assert got[i][d] == n[squared == d].sum()
            seen += got[i][d]


def test_parts_give_away_only_what_can_be_near(spark, monkeypatch):
    random = np.random.default_rng(7)
    train = spark.createDataFrame([([*map(float, p)], 1, 0) for p in random.normal(size=(4000, 10))], "point array<double>, n long, pos long")
    rows = spark.createDataFrame([(i, [*map(float, q)]) for i, q in enumerate(random.normal(size=(100, 10)))], "qid long, point array<double>")
    found = knn.neighbours(rows, train, 5, block=100, pivots=40)
    assert found.count() < 100 * 5 * 20  # all cells gave 5 each: 100 * 5 * 40
    assert found.groupBy("qid").agg(F.sum("n").alias("n")).where("n < 5").count() == 0


@pytest.fixture
def accounts(tmp_path):
    """Tables of 58 accounts; the last six are copies of six others, and no balance is over its limit."""
    random, keys = np.random.default_rng(8), np.delete(np.arange(60), [0, 50])
    days = pd.Timestamp("1996-01-01") + pd.to_timedelta(np.arange(0, 1000, 20), unit="D")
    order = pd.DataFrame({"o_custkey": np.repeat(np.arange(54), 5)})
    order["o_orderstatus"], order["o_totalprice"] = random.choice(["F", "O"], len(order)), random.integers(100, 40_000, len(order)) / 2
    order["o_orderdate"], order["o_orderpriority"] = random.choice(days, len(order)), random.choice(["1-URGENT", "5-LOW"], len(order))
    order = pd.concat([order, order[order["o_custkey"].between(1, 6)].eval("o_custkey = o_custkey + 53")], ignore_index=True)
    paid = pd.DataFrame({"account": np.repeat(np.arange(54), 3)})
    paid["event_type"], paid["value"] = random.choice(["error", "view", "click"], len(paid)), random.integers(1, 500, len(paid)) / 4
    paid = pd.concat([paid, paid[paid["account"].between(1, 6)].eval("account = account + 53")], ignore_index=True)
    tables = {
        "customer": pd.DataFrame({"c_custkey": keys, "c_nationkey": 1, "c_acctbal": random.choice([-1.0, 1.0], len(keys))}),
        "supplier": pd.DataFrame({"s_suppkey": [1], "s_nationkey": [1]}),
        "orders": order.assign(o_orderkey=np.arange(len(order))),
        "events": pd.DataFrame({"event_id": 10 * np.arange(len(paid)) + paid["account"] % 10, "user_id": paid["account"] // 10,
                                "ts": days[0], "event_type": paid["event_type"], "value": paid["value"]}),
        "lineitem": pd.DataFrame({"l_orderkey": np.arange(30), "l_partkey": 1, "l_suppkey": 1, "l_linenumber": 1, "l_extendedprice": 9.0,
                                  "l_discount": 0.0, "l_returnflag": "A", "l_linestatus": "F", "l_shipdate": days[0]})}
    for name, rows in tables.items():
        rows.astype({c: "datetime64[us]" for c in rows.select_dtypes("datetime")}).to_parquet(tmp_path / f"{name}.parquet")
    return tables, str(tmp_path)


def test_query_measures_all_24_predictors(spark, accounts):
    rows = model_rows(spark, accounts[1]).toPandas().sort_values("ID_CPTE")
    train, test = rows[rows["ID_CPTE"] % 10 < 7], rows[rows["ID_CPTE"] % 10 >= 7]
    assert len(train) == 40 and len(test) == 18 and (train["TotalBalanceOL_ind"] == 0).all()
    predictors = list(mart.FULL24)
    mean, deviation = train[predictors].mean(), train[predictors].std().replace(0.0, 1.0)
    a, b = (((part[predictors] - mean) / deviation).round(6).to_numpy() for part in (test, train))
    got = {r["ID_CPTE"]: r for r in entry.queries()["knn_exact"](spark, accounts[1]).collect()}
    assert set(got) == set(test["ID_CPTE"])
    for key, squared in zip(test["ID_CPTE"], knn.squared_distances(a, b)):
        for k in (2, 4, 8, 16):
            assert got[key][f"knn_{k}"] == pytest.approx(train["Default"].to_numpy()[squared <= np.sort(squared)[k - 1]].mean())


def test_query_agrees_with_sql_where_a_predictor_does_not_vary(spark, accounts):
    tables, folder = accounts
    db = duckdb.connect()
    for name in tables:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    assert oracle.compare(spark, db, "knn_exact", folder) == ""


@pytest.mark.parametrize("width,most", [(24, 17), (2, 17), (1, 5), (3, 300)])
def test_leaves_keep_every_near_point(width, most):
    random = np.random.default_rng(9)
    mixed = random.normal(size=(width, width))
    points = random.permutation(np.unique((random.normal(size=(3000, width)) @ mixed).round(1), axis=0))
    asked = np.concatenate([(random.normal(size=(100, width)) @ mixed).round(1), points[:20], np.full((1, width), np.nan)])
    n = random.integers(1, 4, len(points))
    limit = np.where(np.arange(len(asked)) % 3 == 0, np.inf, 0.5 * width)
    got = knn._search(asked, limit, points, n, n, most).set_index(["row", "squared"])["n"].to_dict()
    for i, q in enumerate(asked[:-1]):
        squared, seen = knn.squared_distances(q[None, :], points)[0], 0
        for d in np.unique(squared[squared <= limit[i]]):
            if seen >= most:
                break
            assert got[i, d] == n[squared == d].sum()
            seen += got[i, d]
    order, starts, axes, low, high = knn._leaves(points, 256)
    assert sorted(order) == [*range(len(points))] and np.diff(starts).max() <= 256
    away = knn._box_distances(asked[:120] @ axes, 0.0, low, high)
    for a, b, least in zip(starts, starts[1:], away.T):
        assert (least <= knn.squared_distances(asked[:120], points[order[a:b]]).min(axis=1) + 1e-9).all()
