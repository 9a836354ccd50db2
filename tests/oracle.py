"""Run registered queries against their SQL: ``python tests/oracle.py [sf] [query ...]``."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as entry
from acctrisk.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def database(sf_dir: str):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def plain(v):
    """A value as compared: exact, but numbers compare across widths."""
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        if math.isnan(v):
            return (2, "nan")
        return (2, repr(int(v)) if v == int(v) and abs(v) < 1e17 else repr(v))
    if isinstance(v, int):
        return (2, repr(v))
    if isinstance(v, datetime.datetime):
        return (3, v.replace(tzinfo=None).isoformat())
    return (3, str(v))


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, db, name: str, sf_dir: str) -> str:
    """Empty when the query and its SQL agree, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    got_columns, got = table(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "" if got else "no rows"
    result = db.execute(sql)
    want_columns, want = table([c[0] for c in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    different = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(different)} of {len(got)} rows differ, first {different[0]}" if different else ""


def main() -> int:
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    db = database(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, db, name, sf_dir)
        except Exception as error:  # reported, and the other queries still run
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        checked = "sql " if name in entry.oracle_sql() else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {checked} {time.time() - start:6.2f}s {name} {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
