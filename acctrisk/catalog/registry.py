"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``name``; ``sql`` may use the common table expressions of :data:`CTES`."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = with_ctes(sql)
        return function

    return add


def with_ctes(sql: str) -> str:
    """Put the definitions a statement uses in front of it, dependencies first."""
    needed = _closure(sql)
    if not needed:
        return sql.strip()
    parts = [f"{name} AS ({CTES[name].strip()})" for name in CTES if name in needed]
    body = sql.strip()
    if re.match(r"(?i)with\s", body):
        return "WITH " + ",\n".join(parts) + ",\n" + re.sub(r"(?i)^with\s+", "", body)
    return "WITH " + ",\n".join(parts) + "\n" + body


def _closure(sql: str) -> set[str]:
    found: set[str] = set()
    queue = [sql]
    while queue:
        text = queue.pop()
        for name in CTES:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                queue.append(CTES[name])
    return found


_LIMIT = "CAST(CASE WHEN {key} % 50 = 0 THEN 0 ELSE 10007000 + 2002000 * (year({day}) % 3) END AS BIGINT)"


def _strict(function: str, column: str) -> str:
    return f"CASE WHEN count({column}) = count(*) THEN {function}({column}) END"


def _payment_features(rows: str) -> str:
    return f"""
        SELECT ID_CPTE, coalesce({_strict('avg', 'TRANSACTION_AMT')}, 0) AS mean_payment,
               coalesce({_strict('max', 'TRANSACTION_AMT')}, 0) AS max_payment,
               coalesce({_strict('min', 'TRANSACTION_AMT')}, 0) AS min_payment,
               coalesce({_strict('median', 'TRANSACTION_AMT')}, 0) AS median_payment,
               count(*) AS number_payments,
               coalesce({_strict('bool_or', "PAYMENT_REVERSAL_XFLG = 'N'")}, false) AS reversedPayment,
               coalesce({_strict('bool_or', "PAYMENT_REVERSAL_XFLG = ''")}, false) AS noPayments
        FROM {rows} GROUP BY ID_CPTE"""


# Listed so that every definition comes after the ones it uses.
CTES: dict[str, str] = {
    "performance": """
        SELECT c_custkey AS ID_CPTE, make_date(2001, CAST(c_custkey % 12 + 1 AS INTEGER), 1) AS PERIODID_MY,
               CAST(c_acctbal < 0 AS INTEGER) AS "Default"
        FROM customer""",
    "billing": f"""
        SELECT ID_CPTE, PERIODID_MY, CAST(sum(amount) AS BIGINT) AS CurrentTotalBalance,
               CAST(sum(CASE WHEN o_orderstatus = 'F' THEN amount ELSE 0 END) AS BIGINT) AS CashBalance,
               CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS INTEGER) AS DelqCycle,
               {_LIMIT.format(key='ID_CPTE', day='PERIODID_MY')} AS CreditLimit
        FROM (SELECT o_custkey AS ID_CPTE, CAST(date_trunc('month', o_orderdate) AS DATE) AS PERIODID_MY,
                     CAST(round(o_totalprice * 100) AS BIGINT) AS amount, o_orderstatus, o_orderpriority
              FROM orders)
        GROUP BY ID_CPTE, PERIODID_MY""",
    "transactions": f"""
        SELECT CASE WHEN o_custkey % 10 = 3 THEN o_custkey - 1 ELSE o_custkey END AS ID_CPTE,
               CAST(round(l_extendedprice * (CAST(1 AS DOUBLE) - l_discount) * 100) AS BIGINT) AS TRANSACTION_AMT,
               l_shipdate AS TRANSACTION_DTTM,
               {_LIMIT.format(key='o_custkey', day='l_shipdate')} AS PRIOR_CREDIT_LIMIT_AMT,
               CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'A' WHEN 'AO' THEN 'B' WHEN 'NF' THEN 'C'
                    WHEN 'NO' THEN 'D' WHEN 'RF' THEN 'E' WHEN 'RO' THEN 'F' END AS TRANSACTION_TYPE_XCD,
               CASE WHEN l_linenumber = 7 AND l_partkey % 10 = 0 THEN NULL
                    ELSE translate(substr(o_orderpriority, 1, 1), '12345', 'ABCDE') END AS TRANSACTION_CATEGORY_XCD,
               CASE WHEN s_nationkey = c_nationkey THEN 'DP' ELSE 'N' || s_nationkey END AS MERCHANT_COUNTRY_XCD,
               'M' || (l_partkey % 25) AS MERCHANT_CATEGORY_XCD, 'CITY' || l_suppkey AS MERCHANT_CITY_NAME
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN supplier ON l_suppkey = s_suppkey""",
    "payments": """
        SELECT user_id * 10 + event_id % 10 AS ID_CPTE,
               CASE WHEN event_id % 97 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS TRANSACTION_AMT,
               ts AS TRANSACTION_DTTM,
               CASE event_type WHEN 'error' THEN 'N' WHEN 'view' THEN '' ELSE 'Y' END AS PAYMENT_REVERSAL_XFLG
        FROM events WHERE event_type <> 'signup'""",
    "statement_payments": """
        SELECT o_custkey AS ID_CPTE, CAST(round(l_extendedprice * 100) AS BIGINT) AS TRANSACTION_AMT,
               l_shipdate AS TRANSACTION_DTTM
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "scored": """
        SELECT o_orderkey AS key, CAST(o_orderstatus = 'F' AS INTEGER) AS obs,
               CAST(o_orderkey * 48271 % 786431 + CASE WHEN o_orderstatus = 'F' THEN 262144 ELSE 0 END + 1 AS DOUBLE)
                   / CAST(1048576 AS DOUBLE) AS mod1,
               CAST((o_orderkey * 7 + o_custkey * 31) % 800 + CASE WHEN o_orderstatus = 'F' THEN 100 ELSE 0 END + 1
                   AS DOUBLE) / CAST(1024 AS DOUBLE) AS mod2,
               CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) AS var, o_orderpriority AS var_cat
        FROM orders""",
    "billing_derived": """
        SELECT *, CAST(CurrentTotalBalance AS DOUBLE) / nullif(CreditLimit, 0) AS TotalBalanceOL_perc,
               CAST(CurrentTotalBalance > CreditLimit AS INTEGER) AS TotalBalanceOL_ind,
               CAST(CashBalance AS DOUBLE) / nullif(CreditLimit, 0) AS CB_limit_perc,
               CAST(CashBalance > CreditLimit AS INTEGER) AS CBOL_ind,
               CAST(CashBalance > 0 AS INTEGER) AS CB_ind,
               CurrentTotalBalance - CashBalance AS Spending,
               CAST(CurrentTotalBalance - CashBalance AS DOUBLE) / nullif(CreditLimit, 0) AS SpendingOL_perc,
               CAST(CurrentTotalBalance - CashBalance > CreditLimit AS INTEGER) AS SpendingOL_ind,
               DelqCycle AS Num_CMP, CAST(DelqCycle <> 0 AS INTEGER) AS Delinquent
        FROM billing""",
    "billing_features": f"""
        SELECT ID_CPTE, {_strict('avg', 'CurrentTotalBalance')} AS mean_balance,
               {_strict('avg', 'CashBalance')} AS mean_cash_balance,
               {_strict('max', 'CurrentTotalBalance')} AS max_balance,
               {_strict('max', 'CashBalance')} AS max_cash_balance,
               {_strict('max', 'Num_CMP')} AS max_num_cmp,
               CAST({_strict('sum', 'Delinquent')} AS BIGINT) AS count_num_cmp,
               {_strict('max', 'CreditLimit')} <> {_strict('min', 'CreditLimit')} AS credit_change,
               {_strict('max', 'TotalBalanceOL_perc')} AS TotalBalanceOL_perc_max,
               {_strict('avg', 'TotalBalanceOL_perc')} AS TotalBalanceOL_perc_mean,
               {_strict('max', 'TotalBalanceOL_ind')} AS TotalBalanceOL_ind,
               {_strict('max', 'CB_ind')} AS CB_ind,
               {_strict('max', 'CB_limit_perc')} AS CB_limit_perc_max,
               {_strict('avg', 'CB_limit_perc')} AS CB_limit_perc_mean,
               {_strict('avg', 'Spending')} AS Spending_mean,
               {_strict('max', 'SpendingOL_perc')} AS SpendingOL_perc_max,
               {_strict('avg', 'SpendingOL_perc')} AS SpendingOL_perc_mean,
               {_strict('max', 'SpendingOL_ind')} AS SpendingOL_ind
        FROM billing_derived GROUP BY ID_CPTE""",
    "trx_derived": """
        SELECT *, CAST(MERCHANT_COUNTRY_XCD = 'DP' AS INTEGER) AS isLocal,
               """ + ",\n               ".join(
                   [f"CAST(TRANSACTION_TYPE_XCD = '{v}' AS INTEGER) AS trx_type_{v}" for v in "ABCDEFG"]
                   + [f"CAST(TRANSACTION_CATEGORY_XCD = '{v}' AS INTEGER) AS trx_cat_{v}" for v in "ABCDE"]) + """,
               CASE WHEN PRIOR_CREDIT_LIMIT_AMT = 0 THEN CAST(0 AS DOUBLE)
                    ELSE CAST(TRANSACTION_AMT AS DOUBLE) / PRIOR_CREDIT_LIMIT_AMT END AS trxpctused
        FROM transactions""",
    "type_mode": """
        SELECT ID_CPTE, TRANSACTION_TYPE_XCD AS trx_type_mode
        FROM (SELECT ID_CPTE, TRANSACTION_TYPE_XCD,
                     row_number() OVER (PARTITION BY ID_CPTE ORDER BY count(*) DESC, TRANSACTION_TYPE_XCD) AS r
              FROM transactions WHERE TRANSACTION_TYPE_XCD IS NOT NULL GROUP BY ID_CPTE, TRANSACTION_TYPE_XCD)
        WHERE r = 1""",
    "category_mode": """
        SELECT ID_CPTE, TRANSACTION_CATEGORY_XCD AS trx_cat_mode
        FROM (SELECT ID_CPTE, TRANSACTION_CATEGORY_XCD,
                     row_number() OVER (PARTITION BY ID_CPTE ORDER BY count(*) DESC, TRANSACTION_CATEGORY_XCD) AS r
              FROM transactions WHERE TRANSACTION_CATEGORY_XCD IS NOT NULL
              GROUP BY ID_CPTE, TRANSACTION_CATEGORY_XCD)
        WHERE r = 1""",
    "trx_features": f"""
        SELECT a.*, t.trx_type_mode, c.trx_cat_mode
        FROM (SELECT ID_CPTE, count(*) AS number_transactions,
                     CAST(count(*) = {_strict('sum', 'isLocal')} AS INTEGER) AS traveller_ind,
                     {_strict('avg', 'TRANSACTION_AMT')} AS mean_trx_amt,
                     {_strict('avg', 'trxpctused')} AS mean_trx_pct,
                     """ + ", ".join(
                         [f"{_strict('avg', 'trx_type_' + v)} AS trx_type_{v}_perc" for v in "ABCDEFG"]
                         + [f"{_strict('avg', 'trx_cat_' + v)} AS trx_cat_{v}_perc" for v in "ABCDE"]) + """
              FROM trx_derived GROUP BY ID_CPTE) a
        LEFT JOIN type_mode t ON a.ID_CPTE = t.ID_CPTE
        LEFT JOIN category_mode c ON a.ID_CPTE = c.ID_CPTE""",
    "payments_imputed": """
        SELECT * REPLACE (coalesce(CAST(TRANSACTION_AMT AS DOUBLE), (SELECT avg(TRANSACTION_AMT) FROM payments))
                          AS TRANSACTION_AMT)
        FROM payments""",
    "payment_features": _payment_features("payments"),
    "payment_features_imputed": _payment_features("payments_imputed"),
    "mart": """
        SELECT p.ID_CPTE, mean_payment, max_payment, min_payment, median_payment, number_payments,
               CAST(reversedPayment AS INTEGER) AS reversedPayment, CAST(noPayments AS INTEGER) AS noPayments,
               b.* EXCLUDE (ID_CPTE, credit_change), CAST(credit_change AS INTEGER) AS credit_change,
               f."Default", t.* EXCLUDE (ID_CPTE)
        FROM payment_features_imputed p JOIN billing_features b ON p.ID_CPTE = b.ID_CPTE
             JOIN performance f ON p.ID_CPTE = f.ID_CPTE LEFT JOIN trx_features t ON p.ID_CPTE = t.ID_CPTE""",
    "mart_filled": """
        SELECT * REPLACE (
            coalesce(CAST(mean_trx_amt AS DOUBLE), (SELECT avg(mean_trx_amt) FROM trx_features)) AS mean_trx_amt,
            coalesce(CAST(mean_trx_pct AS DOUBLE), (SELECT avg(mean_trx_pct) FROM trx_features)) AS mean_trx_pct,
            coalesce(CAST(number_transactions AS DOUBLE), (SELECT avg(number_transactions) FROM trx_features))
                AS number_transactions)
        FROM mart""",
    "lagged": """
        SELECT *, lag(PERIODID_MY) OVER (PARTITION BY ID_CPTE ORDER BY PERIODID_MY) AS lag_period FROM billing""",
    "paid_by_statement": """
        SELECT s.ID_CPTE, s.PERIODID_MY, s.CurrentTotalBalance,
               CAST(coalesce(sum(p.TRANSACTION_AMT), 0) AS BIGINT) AS paid
        FROM lagged s LEFT JOIN statement_payments p
             ON s.ID_CPTE = p.ID_CPTE AND p.TRANSACTION_DTTM >= s.lag_period AND p.TRANSACTION_DTTM < s.PERIODID_MY
        WHERE s.lag_period IS NOT NULL
        GROUP BY s.ID_CPTE, s.PERIODID_MY, s.CurrentTotalBalance""",
    "hashed": """
        SELECT *, (swapped * 1103515245 + 12345) % 2147483648 AS h
        FROM (SELECT *, (b >> 16) + (b % 65536) * 32768 AS swapped
              FROM (SELECT *, (xor((a >> 16) + (a % 65536) * 32768, (seed * 1103515245 + 12345) % 2147483648)
                               * 1103515245 + 12345) % 2147483648 AS b
                    FROM (SELECT *, ((ID_CPTE % 2147483648) * 1103515245 + 12345) % 2147483648 AS a
                          FROM performance,
                               (SELECT CAST(unnest([0, 8, 1000, 2000, 7919, 15838]) AS BIGINT) AS seed))))""",
}
